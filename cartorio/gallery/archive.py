"""Documents, products, policies and logs derived from orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.gallery.base import Tables, values
from cartorio.operators.lifecycle import STATUSES

PRODUCTS = [
    ("P0", "CRED-0", "Credit cards", True, "R1"),
    ("P1", "LOAN-1", "Personal loans", False, None),
    ("P2", "INS_2", "Insurance 50%", True, "R2"),
    ("P3", "PENS-3", "Pensions", False, "R9"),
    ("P4", "ACC-4", "Accounts", True, None),
]
PRODUCT_COLUMNS = "product_id string, code string, name string, active boolean, repository_id string"
POLICIES = [
    ("G", None, None, 365),
    ("T1", "1-URGENT", None, 1825),
    ("T2", "2-HIGH", None, 900),
    ("PR0", None, "P0", 30),
    ("PR1", None, "P1", 730),
    ("B1", "1-URGENT", "P0", 10),
    ("B2", "3-MEDIUM", "P2", 60),
    ("B3", "2-HIGH", "P1", 3650),
]
POLICY_COLUMNS = "policy_id string, document_type string, product_id string, days int"
REPOSITORIES = [
    ("R0", "main", "FILE_SYSTEM", True, True),
    ("R1", "cards", "DATABASE", True, False),
    ("R2", "cold", "AWS_S3", False, False),
    ("R3", "lake", "AZURE_BLOB_STORAGE", True, False),
]
REPOSITORY_COLUMNS = "repository_id string, code string, provider string, active boolean, is_default boolean"
SUBSCRIPTIONS = [
    (1, ["document.completed", "document.failed"], None, True),
    (2, ["document.purged"], "P0", True),
    (3, ["document.completed"], "P2", True),
    (4, ["document.completed"], None, False),
    (5, ["document.failed", "document.purged"], None, True),
]
SUBSCRIPTION_COLUMNS = "subscription_id int, events array<string>, product_id string, active boolean"
JOB = "00000000-0000-4000-8000-000000000001"
OTHER_JOB = "00000000-0000-4000-8000-000000000002"

_STATUS_LIST = ", ".join(f"'{s}'" for s in STATUSES)


def _docs_columns(spark: bool) -> list[str]:
    status = f"element_at(array({_STATUS_LIST}), cast(o_orderkey % 11 as int) + 1)" if spark else f"([{_STATUS_LIST}])[(o_orderkey % 11) + 1]"
    days = (lambda n: f"make_dt_interval({n})") if spark else (lambda n: f"to_days(CAST({n} AS INTEGER))")
    stored = "CASE o_orderkey % 3 WHEN 0 THEN 365 WHEN 1 THEN 900 ELSE 30 END"
    return [
        "o_orderkey AS doc_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN concat('rel%100_', CAST(o_orderkey AS STRING), '.PDF') ELSE concat('order_', CAST(o_orderkey AS STRING), '.pdf') END AS file_name",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('P', CAST(o_custkey % 5 AS STRING)) END AS product_id",
        "CASE WHEN o_orderkey % 11 = 3 THEN 'UNKNOWN' WHEN o_orderkey % 11 = 4 THEN NULL ELSE o_orderpriority END AS detected_type",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS expected_type",
        "o_orderstatus AS channel",
        f"{status} AS status",
        "o_orderdate AS uploaded_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('REF-', CAST(o_custkey % 50 AS STRING)) END AS external_reference",
        "concat('R', CAST(o_orderkey % 5 AS STRING)) AS repository_id",
        "concat('k/', CAST(o_orderkey AS STRING)) AS storage_key",
        "CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'G' WHEN o_orderkey % 3 = 1 THEN 'T2' ELSE 'PR0' END AS policy_id",
        f"CAST(CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 10 = 0 THEN 100 ELSE {stored} END AS INT) AS retention_days",
        f"CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_orderdate + {days('100')} ELSE o_orderdate + {days(stored)} END AS expires_at",
        "CAST(CASE WHEN o_orderkey % 11 = 10 THEN o_orderdate END AS TIMESTAMP" + ("_NTZ" if spark else "") + ") AS purged_at",
        "o_totalprice AS amount",
        "o_custkey AS owner_id",
    ]


def documents(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*_docs_columns(True))


DOCS = "docs AS (SELECT " + ", ".join(_docs_columns(False)) + " FROM orders)"
PRODUCTS_SQL = "products AS " + values(PRODUCTS, "product_id, code, name, active, repository_id")
POLICIES_SQL = "policies AS " + values(POLICIES, "policy_id, document_type, product_id, days")
REPOSITORIES_SQL = "repositories AS " + values(REPOSITORIES, "repository_id, code, provider, active, is_default")
SUBSCRIPTIONS_SQL = "subscriptions AS " + values(SUBSCRIPTIONS, "subscription_id, events, product_id, active")


def products(t: Tables) -> DataFrame:
    return t.literal(PRODUCTS, PRODUCT_COLUMNS)


def policies(t: Tables) -> DataFrame:
    return t.literal(POLICIES, POLICY_COLUMNS)


def repositories(t: Tables) -> DataFrame:
    return t.literal(REPOSITORIES, REPOSITORY_COLUMNS)


def subscriptions(t: Tables) -> DataFrame:
    return t.literal(SUBSCRIPTIONS, SUBSCRIPTION_COLUMNS)


def extractions(t: Tables) -> DataFrame:
    """One extraction per order and line number; every other one without structured content."""
    return t.lineitem.selectExpr(
        "l_orderkey AS doc_id",
        "l_orderkey * 10 + l_linenumber AS extraction_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN '{}' END AS structured",
        "concat('text ', CAST(l_orderkey AS STRING)) AS raw_text",
    ).distinct()


EXTRACTIONS = (
    "extractions AS (SELECT DISTINCT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS extraction_id, "
    "CASE WHEN l_linenumber % 2 = 0 THEN '{}' END AS structured, concat('text ', CAST(l_orderkey AS VARCHAR)) AS raw_text FROM lineitem)"
)


def fields(t: Tables) -> DataFrame:
    """One field per part of an extraction, for the extractions with a line number of three or more."""
    return (
        t.lineitem.filter("l_linenumber >= 3")
        .selectExpr("l_orderkey * 10 + l_linenumber AS extraction_id", "concat('part', CAST(l_partkey AS STRING)) AS field_path")
        .distinct()
    )


FIELDS = (
    "fields AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS extraction_id, concat('part', CAST(l_partkey AS VARCHAR)) AS field_path "
    "FROM lineitem WHERE l_linenumber >= 3)"
)

_STAGE_OF = {"signup": "QUEUED", "view": "OCR_RUNNING", "click": "EXTRACTING", "purchase": "COMPLETED", "error": "FAILED"}
_STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE_OF.items()) + " END"


def log(t: Tables) -> DataFrame:
    """The event table as a document log: user = document; the clock is coarsened so that ties occur."""
    return t.events.selectExpr(
        "user_id AS doc_id",
        "event_id",
        "upper(event_type) AS event_type",
        f"{_STAGE_SQL} AS stage",
        "concat('k=', get_json_object(props, '$.k'), ' kind=', event_type) AS details",
        "date_trunc('HOUR', ts) AS occurred_at",
    )


LOG = (
    "log AS (SELECT user_id AS doc_id, event_id, upper(event_type) AS event_type, "
    f"{_STAGE_SQL} AS stage, concat('k=', json_extract_string(props, '$.k'), ' kind=', event_type) AS details, "
    "date_trunc('hour', ts) AS occurred_at FROM events)"
)
RANK_SQL = "list_position([" + _STATUS_LIST + "], stage)"


def text_of(column: str):
    return F.col(column).cast("string").alias(column)
