"""Listings, keyed lookups and the relational base: filters, pages, joins on dimensions, latest per key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import hint_small, literal_table
from cartorio.functions.expressions import all_of
from cartorio.functions.expressions import equals_if as equals
from cartorio.operators.ordering import ordered_positions

# Page size defaults and limits of key lengths.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
MAX_REFERENCE_KEY = 256


def contains_ci(column: Column, text: str | None) -> Column | None:
    """Literal, case-insensitive containment: LIKE wildcards in ``text`` stand for themselves."""
    if text is None or not text.strip():
        return None
    literal = text.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{literal}%")


def at_least(column: Column, value) -> Column | None:
    return None if value is None else column >= F.lit(value)


def at_most(column: Column, value) -> Column | None:
    return None if value is None else column <= F.lit(value)


@dataclass(frozen=True)
class DocumentFilter:
    """Optional predicates of the document listing; an absent one restricts nothing."""

    protocol: str | None = None
    external_reference: str | None = None
    file_name: str | None = None
    product_code: str | None = None
    document_type: str | None = None
    channel: str | None = None
    status: str | None = None
    uploaded_from: datetime | None = None
    uploaded_to: datetime | None = None


def list_documents(docs: DataFrame, wanted: DocumentFilter) -> DataFrame:
    product = wanted.product_code.strip().upper() if wanted.product_code else None
    typed = None
    if wanted.document_type is not None:
        typed = (F.col("detected_type") == wanted.document_type) | (F.col("expected_type") == wanted.document_type)
    return docs.filter(
        all_of(
            [
                contains_ci(F.col("protocol"), wanted.protocol),
                contains_ci(F.col("external_reference"), wanted.external_reference),
                contains_ci(F.col("file_name"), wanted.file_name),
                equals(F.col("product_code"), product),
                typed,
                equals(F.col("channel"), wanted.channel),
                equals(F.col("status"), wanted.status),
                at_least(F.col("uploaded_at"), wanted.uploaded_from),
                at_most(F.col("uploaded_at"), wanted.uploaded_to),
            ]
        )
    )


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One stable page (1-based) of ``MAX_PAGE_SIZE`` rows at most; another size raises. Planned as a per-task top-k, not as a full sort."""
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE_SIZE} rows, not {size}")
    skipped = (max(number, 1) - 1) * size
    return df.orderBy(*order).offset(skipped).limit(size)


def newest_first(time: str = "uploaded_at", key: str = "doc_id") -> list[Column]:
    return [F.col(time).desc(), F.col(key).desc()]


def page_with_total(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page with the size of the whole filtered set beside it (a one-row aggregate, no window)."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page(df, order, number, size).withColumn("total", total)


def list_audit(df: DataFrame, user_id=None, action=None, since=None, until=None) -> DataFrame:
    return df.filter(
        all_of(
            [
                equals(F.col("user_id"), user_id),
                equals(F.col("action"), action),
                at_least(F.col("occurred_at"), since),
                at_most(F.col("occurred_at"), until),
            ]
        )
    )


def list_catalog(
    df: DataFrame,
    contains: Mapping[str, str | None] | None = None,
    equal: Mapping[str, object] | None = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Any catalogue: substring filters, equality filters, an order."""
    tests = [contains_ci(F.col(c), v) for c, v in (contains or {}).items()]
    tests += [equals(F.col(c), v) for c, v in (equal or {}).items()]
    kept = df.filter(all_of(tests))
    return kept.orderBy(*order) if order else kept


def list_repositories(df: DataFrame, code: str | None = None, provider: str | None = None, active: bool | None = None, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of storage repositories, the default one first, then by code. Columns read: code, provider, active, is_default."""
    kept = list_catalog(df, {"code": code}, {"provider": provider, "active": active})
    return page_with_total(kept, [F.col("is_default").desc(), F.col("code").asc()], number, size)


def list_subscriptions(df: DataFrame, active: bool | None = None, product_id: str | None = None, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of subscriptions, newest first. Columns read: subscription_id, active, product_id, created_at."""
    kept = list_catalog(df, equal={"active": active, "product_id": product_id})
    return page_with_total(kept, newest_first("created_at", "subscription_id"), number, size)


def list_deliveries(df: DataFrame, subscription_id, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of the deliveries of one subscription, newest first. Columns read: delivery_id, subscription_id, created_at."""
    kept = df.filter(F.col("subscription_id") == F.lit(subscription_id))
    return page_with_total(kept, newest_first("created_at", "delivery_id"), number, size)


def scope_rank(document_type: Column, product: Column) -> Column:
    """Most general policy first: none, type, product, both."""
    return document_type.isNotNull().cast("int") + product.isNotNull().cast("int") * 2


def well_formed_protocol(value: Column) -> Column:
    """``DOC-yyyyMMdd-`` and six digits or more, the day being a real one."""
    shaped = value.rlike(r"^DOC-[0-9]{8}-[0-9]{6,}\z")
    return F.coalesce(shaped & F.try_to_date(F.substring(value, 5, 8), "yyyyMMdd").isNotNull(), F.lit(False))


def lookup_protocol(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of the well-formed protocols asked for."""
    wanted = keys.filter(well_formed_protocol(F.col("protocol"))).select("protocol").distinct()
    return docs.join(hint_small(wanted), "protocol", "left_semi")


def lookup_latest_reference(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest document per exact, trimmed external reference; blank or over-long keys find nothing."""
    wanted = (
        keys.select(F.trim("external_reference").alias("external_reference"))
        .filter(F.length("external_reference").between(1, MAX_REFERENCE_KEY))
        .distinct()
    )
    return latest(docs.join(hint_small(wanted), "external_reference", "left_semi"), ["external_reference"],
                  ["uploaded_at", "doc_id"])


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key: a partial aggregate, so a hot key costs no sort."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    newest = F.max(F.struct(*order, *rest)) if _orderable(df, rest) else F.max_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*key).agg(newest.alias("_newest")).select(*key, "_newest.*").select(*df.columns)


def _orderable(df: DataFrame, columns: Iterable[str]) -> bool:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return all(kinds[c] not in ("map", "variant") for c in columns)


def visible(children: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that may be shown: those of purged documents are left out."""
    return children.join(docs.filter(F.col("status") == "PURGED").select(key), key, "left_anti")


def exclude(df: DataFrame, excluded: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(hint_small(excluded.select(key)), key, "left_anti")


def extraction_summaries(extractions: DataFrame) -> DataFrame:
    """Everything but the payload columns, which the scan then never reads."""
    payload = {"raw_text", "page_texts", "blocks", "structured"}
    return extractions.select(*[c for c in extractions.columns if c not in payload])


def enrich(docs: DataFrame, products: DataFrame, policies: DataFrame) -> DataFrame:
    """Document, its product, its policy and the policy's own product."""
    product = hint_small(products.select(F.col("product_id"), F.col("code").alias("product_code"), F.col("name").alias("product_name")))
    scope = products.select(F.col("product_id").alias("scope_product_id"), F.col("code").alias("policy_product_code"))
    policy = (
        policies.select(
            "policy_id",
            F.col("days").alias("policy_days"),
            F.col("document_type").alias("policy_type"),
            F.col("product_id").alias("scope_product_id"),
        )
        .join(hint_small(scope), "scope_product_id", "left")
        .drop("scope_product_id")
    )
    return docs.join(product, "product_id", "left").join(hint_small(policy), "policy_id", "left")


def missing_keys(manifest: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return manifest.join(docs.select(key), key, "left_anti")


def referenced(keys: DataFrame, children: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Keys some child still points at, with the number of child tables that do."""
    parts = [
        child.select(F.col(column).alias(key), F.lit(name).alias("child")).filter(F.col(key).isNotNull()).distinct()
        for name, (child, column) in children.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    counted = every.groupBy(key).agg(F.count(F.lit(1)).alias("referenced_by"))
    return keys.join(counted, key, "inner")


def manifest(docs: DataFrame, repositories: DataFrame, local_providers: Sequence[str] = ("FILE_SYSTEM", "DATABASE")) -> DataFrame:
    """Unpurged documents, where their bytes are, and whether that place is part of this installation."""
    provider = hint_small(repositories.select("repository_id", "provider"))
    kept = docs.filter(F.col("status") != "PURGED").select("doc_id", "repository_id", "storage_key")
    joined = kept.join(provider, "repository_id", "left")
    return joined.withColumn("stored_locally", F.coalesce(F.col("provider").isin(*local_providers), F.lit(False)))


def verify_checksums(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Full comparison of a digest listing with content: OK, MISSING, UNLISTED or MISMATCH per path."""
    left = listed.select("path", F.col("digest").alias("listed_digest"))
    right = actual.select("path", F.col("digest").alias("actual_digest"))
    joined = left.join(right, "path", "full_outer")
    return joined.select(
        "path",
        F.when(F.col("actual_digest").isNull(), "MISSING")
        .when(F.col("listed_digest").isNull(), "UNLISTED")
        .when(F.col("listed_digest") != F.col("actual_digest"), "MISMATCH")
        .otherwise("OK")
        .alias("outcome"),
    )


def resolve_location(docs: DataFrame, products: DataFrame, repositories: DataFrame) -> DataFrame:
    """The product's repository, else the default one; a reason where neither can take the document."""
    default_id = repositories.filter(F.col("is_default")).agg(F.min("repository_id").alias("id")).scalar()
    owners = hint_small(products.select("product_id", F.col("repository_id").alias("own_repository_id")))
    places = hint_small(repositories.select("repository_id", F.col("active").alias("repository_active")))
    placed = (
        docs.join(owners, "product_id", "left")
        .withColumn("repository_id", F.coalesce(F.col("own_repository_id"), default_id))
        .join(places, "repository_id", "left")
    )
    reason = (
        F.when(F.col("repository_active").isNull() & F.col("own_repository_id").isNull(), "NO_DEFAULT_REPOSITORY")
        .when(F.col("repository_active").isNull(), "REPOSITORY_NOT_FOUND")
        .when(~F.col("repository_active"), "STORAGE_REPOSITORY_INACTIVE")
    )
    return placed.withColumn("reject_reason", reason).drop("own_repository_id", "repository_active")


def status_depth(jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Jobs per status, every known status present. Counting starts from the fixed list, so the
    result has its rows without a join."""
    zero = literal_table(jobs.sparkSession, [(s, 0) for s in statuses], "status string, n bigint")
    counted = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = counted.filter(F.col("status").isin(*statuses))
    return zero.unionByName(known).groupBy("status").agg(F.sum("n").alias("jobs"))


def oldest_due(df: DataFrame, due: str, key: str, size: int) -> DataFrame:
    """The ``size`` rows due longest, ties by key."""
    return df.orderBy(F.col(due), F.col(key)).limit(size)


def _key_slice(df: DataFrame, key: str) -> Column:
    """A coarse, order-keeping slice of a unique key: a million whole numbers, or a four-letter prefix."""
    kind = df.schema[key].dataType.typeName()
    return F.floor(F.col(key) / 1_000_000) if kind in ("long", "integer") else F.substring(key, 1, 4)


def daily_numbers(docs: DataFrame, last_numbers: DataFrame | None = None, key: str = "doc_id", time: str = "uploaded_at") -> DataFrame:
    """Numbers 1.. per UTC day (continuing after the last number of a day), as a protocol text."""
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    numbered = ordered_positions(
        docs.withColumn("_day", F.to_date(time)), ["_day"], {"second": second, "keys": _key_slice(docs, key)}, [time, key], "number"
    )
    if last_numbers is not None:
        known = last_numbers.select(F.col("day").alias("_day"), F.col("last_number").alias("_last"))
        numbered = numbered.join(hint_small(known), "_day", "left")
        numbered = numbered.withColumn("number", F.col("number") + F.coalesce("_last", F.lit(0))).drop("_last")
    return numbered.withColumn("protocol", format_protocol(F.col("_day"), F.col("number"))).drop("_day")


def format_protocol(day: Column, number: Column) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.concat(F.lit("DOC-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), padded)
