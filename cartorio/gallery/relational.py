"""Listing, lookup, join and counting queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cartorio.gallery import archive as a
from cartorio.gallery.base import query, values
from cartorio.operators import listing as ops
from cartorio.operators.counters import with_counters
from cartorio.operators.lifecycle import STATUSES

D, P, PO, R = a.DOCS, a.PRODUCTS_SQL, a.POLICIES_SQL, a.REPOSITORIES_SQL


def _numbered(t):
    return ops.daily_numbers(a.documents(t))


NUMBERED = (
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY CAST(uploaded_at AS DATE) ORDER BY uploaded_at, doc_id) AS number FROM docs), "
    "protocols AS (SELECT *, 'DOC-' || strftime(uploaded_at, '%Y%m%d') || '-' || CASE WHEN length(CAST(number AS VARCHAR)) >= 6 "
    "THEN CAST(number AS VARCHAR) ELSE lpad(CAST(number AS VARCHAR), 6, '0') END AS protocol FROM numbered)"
)


@query(
    "document_listing",
    f"WITH {D}, {P}, kept AS (SELECT d.* , p.code AS product_code FROM docs d LEFT JOIN products p USING (product_id) "
    "WHERE d.file_name ILIKE '%rel\\%100\\_%' ESCAPE '\\' AND (detected_type = '1-URGENT' OR expected_type = '1-URGENT') "
    "AND uploaded_at >= TIMESTAMP '1996-01-01' AND uploaded_at <= TIMESTAMP '2000-12-31') "
    "SELECT doc_id, file_name, status, product_code, (SELECT count(*) FROM kept) AS total FROM kept "
    "ORDER BY uploaded_at DESC, doc_id DESC LIMIT 20 OFFSET 20",
)
def document_listing(t):
    """Second page of a filtered listing with the size of the whole set."""
    docs = ops.enrich(a.documents(t), a.products(t), a.policies(t)).withColumn("protocol", F.lit(None).cast("string"))
    wanted = ops.DocumentFilter(
        file_name="REL%100_", document_type="1-URGENT", uploaded_from=datetime(1996, 1, 1), uploaded_to=datetime(2000, 12, 31)
    )
    paged = ops.page_with_total(ops.list_documents(docs, wanted), ops.newest_first(), 2, 20)
    return paged.select("doc_id", "file_name", "status", "product_code", "total")


@query(
    "product_listing",
    f"WITH {D}, {P} SELECT d.doc_id, d.channel, d.status FROM docs d JOIN products p USING (product_id) "
    "WHERE p.code = 'INS_2' AND d.channel = 'P' AND d.status = 'COMPLETED' AND d.external_reference ILIKE '%ref-1%'",
)
def product_listing(t):
    docs = ops.enrich(a.documents(t), a.products(t), a.policies(t)).withColumn("protocol", F.lit(None).cast("string"))
    wanted = ops.DocumentFilter(product_code="ins_2", channel="P", status="COMPLETED", external_reference="ref-1")
    return ops.list_documents(docs, wanted).select("doc_id", "channel", "status")


@query(
    "audit_listing",
    "SELECT event_id, user_id, event_type AS action FROM events WHERE event_type = 'error' "
    "AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50",
)
def audit_listing(t):
    rows = t.events.select("event_id", "user_id", F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))
    kept = ops.list_audit(rows, action="error", since=datetime(2024, 1, 5), until=datetime(2024, 1, 20))
    return ops.page(kept, ops.newest_first("occurred_at", "event_id"), 2, 50).select("event_id", "user_id", "action")


@query(
    "catalog_listing",
    "SELECT 'part' AS catalog, p_name AS name, p_brand AS code, CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_name ILIKE '%ring%' AND p_type = 'ECONOMY' "
    "UNION ALL SELECT 'supplier', s_name, 'S' || CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier WHERE s_name ILIKE '%#00000000%' AND s_nationkey = 15 "
    f"UNION ALL SELECT 'policy', coalesce(document_type, '*'), policy_id, days FROM {values(a.POLICIES, 'policy_id, document_type, product_id, days')} WHERE product_id = 'P0'",
)
def catalog_listing(t):
    """One generic filter over three catalogues; policies most general first."""
    parts = ops.list_catalog(t.part, {"p_name": "RING"}, {"p_type": "ECONOMY"}, [F.col("p_name"), F.col("p_partkey")])
    suppliers = ops.list_catalog(t.supplier, {"s_name": "#00000000"}, {"s_nationkey": 15}, [F.col("s_name")])
    rank = ops.scope_rank(F.col("document_type"), F.col("product_id"))
    policies = ops.list_catalog(a.policies(t), {}, {"product_id": "P0"}, [rank, F.col("document_type")])
    return (
        parts.select(F.lit("part").alias("catalog"), F.col("p_name").alias("name"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("id"))
        .unionByName(suppliers.select(F.lit("supplier").alias("catalog"), F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_nationkey")).alias("code"), F.col("s_suppkey").alias("id")))
        .unionByName(policies.select(F.lit("policy").alias("catalog"), F.coalesce("document_type", F.lit("*")).alias("name"), F.col("policy_id").alias("code"), F.col("days").cast("bigint").alias("id")))
    )


@query(
    "keyed_lookup",
    f"WITH {D}, {NUMBERED} SELECT doc_id, protocol FROM protocols WHERE doc_id % 97 = 0 AND doc_id % 2 = 0",
)
def keyed_lookup(t):
    """Documents by protocol; malformed protocols are ignored."""
    numbered = _numbered(t)
    spoiled = F.when(F.col("doc_id") % 2 == 0, F.col("protocol")).otherwise(F.replace(F.col("protocol"), F.lit("DOC-"), F.lit("DOX-")))
    keys = numbered.filter("doc_id % 97 = 0").select(spoiled.alias("protocol"))
    return ops.lookup_protocol(numbered, keys).select("doc_id", "protocol")


@query(
    "latest_reference",
    f"WITH {D} SELECT external_reference, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY external_reference ORDER BY uploaded_at DESC, doc_id DESC) AS rn "
    "FROM docs WHERE external_reference IS NOT NULL) WHERE rn = 1",
)
def latest_reference(t):
    keys = t.customer.select(F.concat(F.lit("  REF-"), (F.col("c_custkey") % 50).cast("string"), F.lit(" ")).alias("external_reference"))
    keys = keys.unionByName(t.customer.select(F.lit("   ").alias("external_reference")))
    return ops.lookup_latest_reference(a.documents(t), keys).select("external_reference", "doc_id")


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def latest_per_key(t):
    return ops.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("daily_numbering", f"WITH {D}, {NUMBERED} SELECT doc_id, number, protocol FROM protocols")
def daily_numbering(t):
    return _numbered(t).select("doc_id", "number", "protocol")


@query(
    "daily_numbering_continued",
    f"WITH {D}, late AS (SELECT * FROM docs WHERE doc_id % 2 = 1), taken AS (SELECT CAST(uploaded_at AS DATE) AS day, count(*) AS n FROM docs WHERE doc_id % 2 = 0 GROUP BY 1) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY CAST(uploaded_at AS DATE) ORDER BY uploaded_at, doc_id) + coalesce(n, 0) AS BIGINT) AS number "
    "FROM late LEFT JOIN taken ON CAST(uploaded_at AS DATE) = day",
)
def daily_numbering_continued(t):
    """An increment numbered after the last numbers of its days."""
    docs = a.documents(t)
    taken = docs.filter("doc_id % 2 = 0").groupBy(F.to_date("uploaded_at").alias("day")).agg(F.count(F.lit(1)).alias("last_number"))
    return ops.daily_numbers(docs.filter("doc_id % 2 = 1"), taken).select("doc_id", "number")


@query(
    "visible_documents",
    f"WITH {D}, {a.EXTRACTIONS} SELECT e.doc_id, e.extraction_id, e.raw_text FROM extractions e WHERE e.doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'PURGED')",
)
def visible_documents(t):
    return ops.visible(a.extractions(t), a.documents(t)).select("doc_id", "extraction_id", "raw_text")


@query(
    "excluded_documents",
    f"WITH {D} SELECT doc_id, status FROM docs WHERE doc_id NOT IN (SELECT c_custkey FROM customer)",
)
def excluded_documents(t):
    return ops.exclude(a.documents(t), t.customer.select(F.col("c_custkey").alias("doc_id"))).select("doc_id", "status")


@query(
    "extraction_summaries",
    f"WITH {a.EXTRACTIONS} SELECT doc_id, count(*) AS extractions, max(extraction_id) AS latest_id FROM extractions GROUP BY doc_id",
)
def extraction_summaries(t):
    summaries = ops.extraction_summaries(a.extractions(t))
    return summaries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("extractions"), F.max("extraction_id").alias("latest_id"))


@query(
    "enriched_documents",
    f"WITH {D}, {P}, {PO} SELECT d.doc_id, p.code AS product_code, p.name AS product_name, o.days AS policy_days, o.document_type AS policy_type, s.code AS policy_product_code "
    "FROM docs d LEFT JOIN products p USING (product_id) LEFT JOIN policies o ON d.policy_id = o.policy_id LEFT JOIN products s ON o.product_id = s.product_id",
)
def enriched_documents(t):
    enriched = ops.enrich(a.documents(t), a.products(t), a.policies(t))
    return enriched.select("doc_id", "product_code", "product_name", "policy_days", "policy_type", "policy_product_code")


@query(
    "reference_guard",
    "SELECT n_nationkey, n_name, CAST((n_nationkey IN (SELECT c_nationkey FROM customer)) AS BIGINT) + CAST((n_nationkey IN (SELECT s_nationkey FROM supplier)) AS BIGINT) AS referenced_by "
    "FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) OR n_nationkey IN (SELECT s_nationkey FROM supplier)",
)
def reference_guard(t):
    children = {"customer": (t.customer, "c_nationkey"), "supplier": (t.supplier, "s_nationkey")}
    return ops.referenced(t.nation.select("n_nationkey", "n_name"), children, "n_nationkey")


@query(
    "missing_keys",
    f"WITH {D} SELECT count(*) AS missing FROM (SELECT DISTINCT l_orderkey + (l_orderkey % 2) * 1000000 AS doc_id FROM lineitem) m WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = m.doc_id)",
)
def missing_keys(t):
    listed = t.lineitem.selectExpr("l_orderkey + (l_orderkey % 2) * 1000000 AS doc_id").distinct()
    return ops.missing_keys(listed, a.documents(t)).agg(F.count(F.lit(1)).alias("missing"))


@query(
    "manifest",
    f"WITH {D}, {R} SELECT d.doc_id, d.repository_id, d.storage_key, r.provider, coalesce(r.provider IN ('FILE_SYSTEM', 'DATABASE'), false) AS stored_locally "
    "FROM docs d LEFT JOIN repositories r USING (repository_id) WHERE d.status <> 'PURGED'",
)
def manifest(t):
    return ops.manifest(a.documents(t), a.repositories(t)).select("doc_id", "repository_id", "storage_key", "provider", "stored_locally")


@query(
    "checksum_verify",
    "WITH listed AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 1), "
    "actual AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 10 <> 2) "
    "SELECT outcome, count(*) AS paths, min(path) AS first_path FROM (SELECT coalesce(l.path, c.path) AS path, CASE WHEN c.digest IS NULL THEN 'MISSING' WHEN l.digest IS NULL THEN 'UNLISTED' "
    "WHEN l.digest <> c.digest THEN 'MISMATCH' ELSE 'OK' END AS outcome FROM listed l FULL OUTER JOIN actual c ON l.path = c.path) GROUP BY outcome",
)
def checksum_verify(t):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    listed = t.documents.filter("doc_id % 10 <> 1").select(path.alias("path"), F.sha2("text", 256).alias("digest"))
    actual = t.documents.filter("doc_id % 10 <> 2").select(path.alias("path"), F.sha2(changed, 256).alias("digest"))
    checked = ops.verify_checksums(listed, actual)
    return checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path"))


@query(
    "resolve_location",
    f"WITH {D}, {P}, {R}, placed AS (SELECT d.doc_id, p.repository_id AS own, coalesce(p.repository_id, (SELECT min(repository_id) FROM repositories WHERE is_default)) AS repository_id FROM docs d LEFT JOIN products p USING (product_id)) "
    "SELECT doc_id, placed.repository_id, CASE WHEN r.active IS NULL AND own IS NULL THEN 'NO_DEFAULT_REPOSITORY' WHEN r.active IS NULL THEN 'REPOSITORY_NOT_FOUND' WHEN NOT r.active THEN 'STORAGE_REPOSITORY_INACTIVE' END AS reject_reason "
    "FROM placed LEFT JOIN repositories r ON placed.repository_id = r.repository_id",
)
def resolve_location(t):
    located = ops.resolve_location(a.documents(t).drop("repository_id"), a.products(t), a.repositories(t))
    return located.select("doc_id", "repository_id", "reject_reason")


@query(
    "status_depth",
    "SELECT s AS status, CAST(count(e.event_id) AS BIGINT) AS jobs FROM (SELECT unnest(['SIGNUP', 'VIEW', 'CLICK', 'PURCHASE', 'ERROR', 'CANCELLED']) AS s) LEFT JOIN events e ON upper(e.event_type) = s GROUP BY s",
)
def status_depth(t):
    jobs = t.events.select(F.upper("event_type").alias("status"))
    return ops.status_depth(jobs, ["SIGNUP", "VIEW", "CLICK", "PURCHASE", "ERROR", "CANCELLED"])


@query("due_batch", f"WITH {D} SELECT doc_id, CAST(uploaded_at AS VARCHAR) AS uploaded_at FROM docs ORDER BY docs.uploaded_at, doc_id LIMIT 100")
def due_batch(t):
    return ops.oldest_due(a.documents(t), "uploaded_at", "doc_id", 100).select("doc_id", a.text_of("uploaded_at"))


STATUS_COUNT = len(STATUSES)


# ---------------------------------------------------------------- pages of catalogues

REPOSITORIES = "repositories AS (SELECT s_suppkey AS repository_id, s_name AS code, CASE s_nationkey % 3 WHEN 0 THEN 'S3' WHEN 1 THEN 'AZURE' ELSE 'LOCAL' END AS provider, s_suppkey % 2 = 0 AS active, s_suppkey = 8 AS is_default FROM supplier)"


@query("repository_listing", f"WITH {REPOSITORIES}, f AS (SELECT * FROM repositories WHERE contains(lower(code), 'supplier') AND active), n AS (SELECT count(*) AS total FROM f) SELECT repository_id, code, is_default, total FROM f, n ORDER BY is_default DESC, code LIMIT 50")
def repository_listing(t):
    """First page of active storage repositories, the default one before all others."""
    rows = t.supplier.selectExpr(
        "s_suppkey AS repository_id", "s_name AS code", "CASE s_nationkey % 3 WHEN 0 THEN 'S3' WHEN 1 THEN 'AZURE' ELSE 'LOCAL' END AS provider", "s_suppkey % 2 = 0 AS active", "s_suppkey = 8 AS is_default"
    )
    return ops.list_repositories(rows, code="SUPPLIER", active=True, size=50).select("repository_id", "code", "is_default", "total")


@query("subscription_listing", "WITH s AS (SELECT user_id AS subscription_id, min(ts) AS created_at, min(event_type) AS product_id, user_id % 3 <> 0 AS active FROM events GROUP BY user_id), f AS (SELECT * FROM s WHERE active AND product_id = 'click'), n AS (SELECT count(*) AS total FROM f) SELECT subscription_id, total FROM f, n ORDER BY created_at DESC, subscription_id DESC LIMIT 20")
def subscription_listing(t):
    """First page of the active subscriptions of a product, newest first."""
    rows = t.events.groupBy(F.col("user_id").alias("subscription_id")).agg(F.min("ts").alias("created_at"), F.min("event_type").alias("product_id")).withColumn("active", F.col("subscription_id") % 3 != 0)
    return ops.list_subscriptions(rows, active=True, product_id="click").select("subscription_id", "total")


@query("delivery_listing", "WITH f AS (SELECT event_id AS delivery_id, ts FROM events WHERE user_id % 10 = 3), n AS (SELECT count(*) AS total FROM f) SELECT delivery_id, total FROM f, n ORDER BY ts DESC, delivery_id DESC LIMIT 20")
def delivery_listing(t):
    """First page of the deliveries of one subscription, newest first."""
    rows = t.events.select(F.col("event_id").alias("delivery_id"), (F.col("user_id") % 10).alias("subscription_id"), F.col("ts").alias("created_at"))
    return ops.list_deliveries(rows, 3).select("delivery_id", "total")


@query("run_counters", "SELECT count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS updated, count(*) FILTER (event_type = 'error') AS failed FROM events")
def run_counters(t):
    """Counters of a run, taken while its rows are written."""
    counted, seen = with_counters(t.events, "run", {"updated": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"})
    counted.write.format("noop").mode("overwrite").save()
    return t.literal([tuple(seen.get[c] for c in ("rows", "updated", "failed"))], "rows bigint, updated bigint, failed bigint")
