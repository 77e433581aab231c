"""Field rows of extractions: value policy, confidence, coverage, sinks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.functions.expressions import round_even

# Fixed values of the field policy.
DEFAULT_CONFIDENCE = Decimal("0.80")
WEAK_PENALTY = Decimal("0.30")
NO_LABEL_NEARBY = "NO_LABEL_NEARBY"
CONFIDENCE = "decimal(5,4)"


def policy(confidence: Column, penalty: Column, status: Column, messages: Column, found: Column) -> dict[str, Column]:
    """Confidence, status and messages of a value read with a penalty.

    ``found`` marks values reported as found: from the weak penalty on they carry the missing-label
    code, and a valid one becomes uncertain.
    """
    left = F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)) - penalty
    clamped = F.least(F.greatest(left, F.lit(Decimal("0.01"))), F.lit(Decimal("1.00")))
    weak = found & (penalty >= F.lit(WEAK_PENALTY))
    return {
        "confidence": round_even(clamped.cast("decimal(12,8)"), 4).cast(CONFIDENCE),
        "status": F.when(weak & (status == "VALID"), "UNCERTAIN").otherwise(status),
        "messages": F.when(weak, F.concat(messages, F.array(F.lit(NO_LABEL_NEARBY)))).otherwise(messages),
    }


def field_policy(values: DataFrame) -> DataFrame:
    """The policy over columns line_confidence, penalty, status, messages, found."""
    return values.withColumns(
        policy(F.col("line_confidence"), F.col("penalty"), F.col("status"), F.col("messages"), F.col("found"))
    )


def mean_confidence(confidence: Column) -> Column:
    """Aggregate: mean of the confidences, half-even at four decimals; null when there is none."""
    total = F.sum(confidence.cast("decimal(24,8)")).cast("decimal(30,12)")
    return round_even((total / F.count(confidence)).cast("decimal(30,12)"), 4).cast(CONFIDENCE)


def overall_confidence(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    return fields.groupBy(key).agg(mean_confidence(F.col("confidence")).alias("overall_confidence"))


def coverage(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields, extracted ones and valid ones per extraction; repeated partner fields are left out."""
    counted = fields.filter(~F.col("field_path").startswith("partners["))
    return counted.groupBy(key).agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(F.col("status") != "NOT_FOUND").alias("extracted"),
        F.count_if(F.col("status") == "VALID").alias("valid"),
    )


def rollup_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page flags per document: native text, first rotation, deskewed, second engine, and the page lists.

    Columns read: page, native, rotation, deskewed, structured, native_rejected_reason.
    """
    def listed(flag: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col(flag), F.col("page")))).cast("array<string>"), ",")

    turned = F.min(F.when(F.col("rotation") != 0, F.struct("page", "rotation")))
    reason = F.when(
        F.col("native_rejected_reason").isNotNull(),
        F.struct("page", F.concat(F.lit("page="), F.col("page").cast("string"), F.lit(" reason="), F.col("native_rejected_reason")).alias("t")),
    )
    summed = pages.groupBy(key).agg(
        F.bool_or("native").alias("has_native_text"),
        turned.alias("turn"),
        F.bool_or("deskewed").alias("deskewed"),
        F.bool_or("structured").alias("used_second_engine"),
        listed("native").alias("native_pages"),
        listed("deskewed").alias("deskewed_pages"),
        listed("structured").alias("structured_pages"),
        F.sort_array(F.collect_set(reason)).alias("rejected"),
    )
    return summed.select(
        key, "has_native_text", F.col("turn.rotation").alias("rotation"), F.col("turn.page").alias("rotated_page"), "deskewed",
        "used_second_engine", "native_pages", "deskewed_pages", "structured_pages",
        F.array_join(F.transform("rejected", lambda r: r["t"]), "; ").alias("native_rejections"),
    )


def preprocessing_events(rolled: DataFrame, key: str = "doc_id") -> DataFrame:
    """Timeline rows of a page roll-up, in the order they are written."""
    pages = lambda c: F.concat(F.lit("pages="), F.col(c))
    entries = [
        ("TEXT_EXTRACTED_FROM_PDF_NATIVE_LAYER", F.col("has_native_text"), pages("native_pages")),
        ("NATIVE_TEXT_LAYER_REJECTED", F.col("native_rejections") != "", F.col("native_rejections")),
        ("DOCUMENT_ROTATED", F.col("rotation").isNotNull(), F.concat(F.lit("page="), F.col("rotated_page").cast("string"), F.lit(" degrees="), F.col("rotation").cast("string"))),
        ("DOCUMENT_DESKEWED", F.col("deskewed"), pages("deskewed_pages")),
        ("OCR_REPROCESSED_WITH_PP_STRUCTUREV3", F.col("used_second_engine"), pages("structured_pages")),
    ]
    rows = F.array(*[F.when(when, F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("event_type"), text.alias("details"))) for n, (name, when, text) in enumerate(entries)])
    return rolled.select(key, F.explode_outer(F.array_compact(rows)).alias("e")).filter("e IS NOT NULL").select(key, "e.*")


# ---------------------------------------------------------------- sinks


def build_extraction(lines: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: raw text (pages apart by a blank line), page texts, map of normalized values, confidence.

    Lines become page texts first and pages a document second, so the large step is split by page.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    pages = lines.groupBy(key, "page").agg(text.alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    texts = pages.groupBy(key).agg(ordered.alias("page_texts")).withColumn(
        "raw_text", F.array_join(F.transform("page_texts", lambda p: p["text"]), "\n\n")
    )
    pairs = F.sort_array(F.collect_list(F.struct(F.col("field_path").alias("key"), F.col("normalized").alias("value"))))
    values = fields.groupBy(key).agg(
        F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("structured"),
        mean_confidence(F.col("confidence")).alias("overall_confidence"),
    )
    return texts.join(values, key, "left")


def canonical_result(docs: DataFrame, fields: DataFrame, events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nested result per document: classification, fields by path, retention and timeline."""
    from cartorio.operators.lifecycle import timeline_arrays

    entry = F.struct(F.col("field_path").alias("key"), F.struct("raw", "normalized", "confidence", "status", "messages").alias("value"))
    mapped = fields.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("fields"))
    shaped = docs.select(
        key, "status",
        F.struct("detected_type", "expected_type").alias("classification"),
        F.struct("policy_id", "retention_days", "expires_at", "purged_at").alias("retention"),
    )
    return shaped.join(mapped, key, "left").join(timeline_arrays(events), key, "left")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is published again give way to the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_extractions(df: DataFrame, path: str, partition: str = "document_type") -> None:
    """Publish by partition: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def protect(df: DataFrame, columns: list[str], key: Column | str) -> DataFrame:
    """Columns encrypted (AES-GCM, base64); nulls stay null."""
    secret = F.lit(key) if isinstance(key, str) else key
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c), secret, F.lit("GCM"))) for c in columns})


def unprotect(df: DataFrame, columns: list[str], key: Column | str) -> tuple[DataFrame, DataFrame]:
    """(readable rows, rejects): a row with a value that does not decrypt goes to the rejects."""
    secret = F.lit(key) if isinstance(key, str) else key
    plain = {f"_{c}": F.try_aes_decrypt(F.unbase64(F.col(c)), secret, F.lit("GCM")).cast("string") for c in columns}
    opened = df.withColumns(plain)
    broken = F.lit(False)
    for c in columns:
        broken = broken | (F.col(c).isNotNull() & F.col(f"_{c}").isNull())
    marked = opened.withColumn("_broken", broken)
    good = marked.filter(~F.col("_broken")).withColumns({c: F.col(f"_{c}") for c in columns})
    extra = [*plain, "_broken"]
    return good.drop(*extra), marked.filter("_broken").drop(*extra)
