"""Intake: file triage, request checks, digests and replay protection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartorio.functions.expressions import first_case
from cartorio.session import cut_lineage

HEADER_BYTES = 1024

# Leading bytes (hexadecimal) that are refused, with the name they are reported under.
BLOCKED_SIGNATURES = (
    ("4D5A", "dos-pe-executable"),
    ("7F454C46", "elf-executable"),
    ("CAFEBABE", "mach-o-or-java-class"),
    ("FEEDFACE", "mach-o-executable"),
    ("CFFAEDFE", "mach-o-executable"),
    ("504B0304", "zip-container"),
    ("504B0506", "zip-container"),
    ("504B0708", "zip-container"),
    ("52617221", "rar-archive"),
    ("377ABCAF", "7z-archive"),
    ("1F8B", "gzip-archive"),
    ("4D534346", "cab-archive"),
    ("D0CF11E0", "ole-compound-file"),
    ("2321", "script-shebang"),
)
# Leading bytes that are accepted: (hexadecimal, media type, extension, name).
SUPPORTED_SIGNATURES = (
    ("89504E470D0A1A0A", "image/png", ".png", "png"),
    ("FFD8FF", "image/jpeg", ".jpg", "jpeg"),
    ("49492A00", "image/tiff", ".tif", "tiff"),
    ("4D4D002A", "image/tiff", ".tif", "tiff"),
    ("49492B00", "image/tiff", ".tif", "tiff"),
    ("4D4D002B", "image/tiff", ".tif", "tiff"),
)
# Other spellings of a media type that count as the same one.
ALIASES = {
    "image/jpeg": ("image/jpg", "image/pjpeg"),
    "image/tiff": ("image/tif", "image/x-tiff"),
    "image/png": ("image/x-png",),
}
PDF = ("application/pdf", ".pdf", "pdf")
MARKUP_LEAD = ("20", "09", "0D", "0A", "EF", "BB", "BF")


def triage_files(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """Adds outcome SUPPORTED, BLOCKED, UNSUPPORTED or EMPTY, the media type, extension and signature name.

    Only the first bytes are looked at; the comparison works on their hexadecimal spelling.
    """
    head = df.withColumn("_head", F.hex(F.substring(F.col(content), 1, HEADER_BYTES)))
    value = F.col("_head")
    leading = "|".join(MARKUP_LEAD)
    markup = F.substring(value, 1, 128).rlike(f"^(?:{leading})*3C")
    pdf = value.rlike("^(?:..)*?255044462D")
    shape = lambda outcome, mime=None, ext=None, name=None: F.struct(
        F.lit(outcome).alias("outcome"),
        F.lit(mime).cast("string").alias("mime_type"),
        F.lit(ext).cast("string").alias("extension"),
        F.lit(name).cast("string").alias("signature"),
    )
    verdict = first_case(
        [
            (F.coalesce(value == "", F.lit(True)), shape("EMPTY")),
            *[(value.startswith(magic), shape("BLOCKED", name=name)) for magic, name in BLOCKED_SIGNATURES],
            *[(value.startswith(magic), shape("SUPPORTED", *found)) for magic, *found in SUPPORTED_SIGNATURES],
            (pdf, shape("SUPPORTED", *PDF)),
            (markup, shape("BLOCKED", name="html-or-xml-markup")),
        ],
        shape("UNSUPPORTED"),
    )
    judged = head.withColumn("_v", verdict).select(*df.columns, "_v.*")
    if declared is None:
        return judged
    return judged.withColumn("declared_consistent", declared_consistent(F.col(declared), F.col("mime_type")))


def declared_consistent(declared: Column, detected: Column) -> Column:
    """A missing or generic declaration agrees with anything; otherwise equal or a known alias."""
    said = F.lower(F.trim(F.substring_index(declared, ";", 1)))
    aliases = first_case([(detected == mime, said.isin(*names)) for mime, names in ALIASES.items()], F.lit(False))
    free = F.coalesce(F.trim(declared) == "", F.lit(True)) | said.isin("application/octet-stream", "*/*")
    return F.when(free, True).otherwise(F.coalesce((said == F.lower(detected)) | aliases, F.lit(False)))


@dataclass(frozen=True)
class IntakeLimits:
    """Default limits of an upload."""

    max_bytes: int = 26_214_400
    max_pages: int = 50
    max_reference: int = 128
    max_expected_type: int = 64
    max_file_name: int = 255
    max_key: int = 200


CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def clean_file_name(name: Column, limit: int = 255) -> Column:
    """Last path segment without control characters and leading dots, cut at the limit."""
    segment = F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1)
    cleaned = F.ltrim(F.trim(F.regexp_replace(segment, CONTROL, "")), F.lit("."))
    return F.when(cleaned == "", "upload").otherwise(F.substring(cleaned, 1, limit))


def validate_intake(df: DataFrame, limits: IntakeLimits = IntakeLimits()) -> DataFrame:
    """Adds the cleaned file name and the first reason to refuse the row (null when accepted).

    Columns read: file_name, size_bytes, page_count, external_reference, expected_type, idempotency_key.
    """
    def too_long(column: str, limit: int) -> Column:
        return F.coalesce(F.length(F.trim(column)) > limit, F.lit(False))

    key = F.trim("idempotency_key")
    return df.withColumns(
        {
            "clean_name": clean_file_name(F.col("file_name"), limits.max_file_name),
            "reject_reason": first_case(
                [
                    (too_long("expected_type", limits.max_expected_type), "INVALID_FIELD"),
                    (too_long("external_reference", limits.max_reference), "INVALID_FIELD"),
                    (too_long("idempotency_key", limits.max_key), "INVALID_IDEMPOTENCY_KEY"),
                    (F.coalesce(key.rlike(CONTROL), F.lit(False)), "INVALID_IDEMPOTENCY_KEY"),
                    (F.col("size_bytes") == 0, "EMPTY_FILE"),
                    (F.col("size_bytes") > limits.max_bytes, "FILE_TOO_LARGE"),
                    (F.col("page_count") > limits.max_pages, "PAGE_LIMIT_EXCEEDED"),
                ]
            ).cast("string"),
        }
    )


def content_digest(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def duplicate_groups(digested: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests shared by several documents, with their number and the smallest id."""
    groups = digested.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
    return groups.filter(F.col("copies") > 1)


#: A key's uploads are looked through in this many parts of its life time, so that no key is sorted as a whole.
PARTS_OF_LIFE = 96


def _micros(moment: Column) -> Column:
    """Microseconds of the calendar, so that no time zone has a say."""
    minutes = (F.unix_date(F.to_date(moment)) * 24 + F.hour(moment)) * 60 + F.minute(moment)
    return minutes.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def _next_openings(nodes: DataFrame, life: int) -> DataFrame:
    """(key, node, next): the first upload of the key at or after a node's time and its life.

    ``nodes``: key, at (microseconds), node (struct that begins with at). The answer is in the part of time that the end of
    the life falls into, or is the first upload of the next part that has any.
    """
    width = max(life // PARTS_OF_LIFE, 1)
    part = lambda at: F.floor(at / width)
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    there = nodes.select("key", part(F.col("at")).alias("part"), "at", F.col("node").alias("upload"), none.alias("asks"))
    ends = nodes.select("key", part(F.col("at") + life).alias("part"), (F.col("at") + life).alias("at"), none.alias("upload"), F.col("node").alias("asks"))
    # From the latest on, all uploads so far are at or after a row.
    later = Window.partitionBy("key", "part").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = there.unionByName(ends).withColumn("found", F.min("upload").over(later)).filter("asks IS NOT NULL").select("key", "part", "asks", "found")
    asked = cut_lineage(asked)
    firsts = there.groupBy("key", "part").agg(F.min("upload").alias("first"))
    open_parts = asked.filter("found IS NULL").select("key", "part").distinct().withColumn("first", none)
    onward = Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    marked = firsts.unionByName(open_parts).groupBy("key", "part").agg(F.max("first").alias("first"))
    after = marked.select("key", "part", F.min("first").over(onward).alias("after"))
    placed = asked.join(after, ["key", "part"], "left")
    return placed.select("key", F.col("asks").alias("node"), F.coalesce("found", "after").alias("next")).filter("next IS NOT NULL")


def replay_guard(uploads: DataFrame, ttl_hours: int = 24, live: DataFrame | None = None) -> DataFrame:
    """NEW, REPLAY or CONFLICT per upload with an idempotency key, and the upload it is answered from.

    A key is live for the whole time after the upload that opened it; a later upload under a live
    key replays it (same digest) or conflicts (other digest); under an expired key it opens a new
    record. Every upload points to the one that would open the key after it, had it opened it itself. The
    openings are what can be reached from a key's first upload; pointers to the 2nd, 4th, 8th ... opening find them in
    as many rounds as their number has digits in base two, however long the log is. Openings are a life apart, so each
    upload is answered by the one of its own slice of time or of the slice before, by equality joins.

    Columns read: key, upload_id, digest, uploaded_at. ``live``: key, opened_at, opened_by, opened_digest.
    Uploads without a key are left out; repeated rows are answered alike.
    """
    life = ttl_hours * 3_600_000_000
    keyed = uploads.filter(F.col("key").isNotNull())
    at = _micros(F.col("uploaded_at"))
    node = F.struct(at.alias("at"), F.col("upload_id").alias("by"), F.col("digest").alias("digest"))
    nodes = keyed.select("key", at.alias("at"), node.alias("node")).distinct()
    if live is not None:
        old = live.select("key", F.struct(_micros(F.col("opened_at")).alias("at"), F.col("opened_by").alias("by"), F.col("opened_digest").alias("digest")).alias("live"))
        old = old.groupBy("key").agg(F.max("live").alias("live"))
        nodes = nodes.join(old, "key", "left")
    else:
        nodes = nodes.withColumn("live", F.lit(None).cast(nodes.schema["node"].dataType))
    nodes = cut_lineage(nodes)
    span = nodes.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    rounds = ((span["high"] - span["low"]) // life).bit_length() if span["low"] is not None else 0

    free = nodes.filter(F.col("live").isNull() | (F.col("at") >= F.col("live.at") + life))
    opened = cut_lineage(free.groupBy("key").agg(F.min("node").alias("node")))
    jumps = cut_lineage(_next_openings(free.select("key", "at", "node"), life)) if rounds else None
    for turn in range(rounds):
        reached = opened.join(jumps, ["key", "node"]).select("key", F.col("next").alias("node"))
        opened = cut_lineage(opened.unionByName(reached))
        if turn + 1 < rounds:
            ahead = jumps.select("key", F.col("node").alias("next"), F.col("next").alias("further"))
            jumps = cut_lineage(jumps.join(ahead, ["key", "next"]).select("key", "node", F.col("further").alias("next")))

    slice_of = lambda moment: F.floor(moment / life)
    records = opened.unionByName(nodes.filter("live IS NOT NULL").select("key", F.col("live").alias("node")).distinct())
    records = records.withColumn("_slice", slice_of(F.col("node.at")))
    # A slice of time is as long as a life, so it has one opening of a key, and a live record before it at most.
    own = records.groupBy("key", "_slice").agg(F.max("node").alias("_late"), F.min("node").alias("_early"))
    before = own.select("key", (F.col("_slice") + 1).alias("_slice"), F.col("_late").alias("_before"))
    asked = keyed.withColumns({"_node": node, "_slice": slice_of(at)}).join(own, ["key", "_slice"], "left").join(before, ["key", "_slice"], "left")
    place = lambda record: F.struct(record["at"], record["by"])
    holds = lambda record: F.when(record.isNotNull() & (place(record) <= place(F.col("_node"))), record)
    record = F.coalesce(*[holds(F.col(c)) for c in ("_late", "_early", "_before")])
    outcome = F.when(F.col("_r.by") == F.col("upload_id"), "NEW").when(F.col("_r.digest") == F.col("digest"), "REPLAY").otherwise("CONFLICT")
    return asked.withColumn("_r", record).select(*uploads.columns, outcome.alias("outcome"), F.col("_r.by").alias("answered_by"))
