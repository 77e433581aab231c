"""Text lines: from whole texts, from files, from captured page blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartorio.functions.expressions import bind
from cartorio.functions.folding import fold
from cartorio.functions.geometry import with_box
from cartorio.operators.ordering import ordered_positions

BLOCK = "struct<text:string,confidence:decimal(5,4),boundingBox:array<double>>"
PAGE = f"struct<page:int,imageWidth:int,imageHeight:int,durationMs:bigint,blocks:array<{BLOCK}>>"
CAPTURE_SCHEMA = f"source string, modelVersion string, pages array<{PAGE}>"
PAGE_TEXTS = "array<struct<pageNumber:int,text:string>>"
BLANK = r"^[\t-\r \x{85}\p{Z}]*\z"

# The separators at which a text is cut into lines.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def to_lines(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no from 1, line) of every text; a trailing break adds no empty line."""
    # What stands behind a trailing break is the last part, and empty: cheaper than looking for that break in the whole text.
    whole = lambda parts: F.slice(parts, 1, F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))
    parts = F.when(F.col(text) != "", bind(F.split(F.col(text), LINE_BREAK), whole))
    # Conditions stand behind the generator: in front of it they would evaluate the text twice.
    cut = df.select(key, *keep, F.posexplode_outer(parts).alias("line_no", "line"))
    return cut.filter(F.col("line").isNotNull()).withColumn("line_no", F.col("line_no") + 1)


# Suffixes of files that are never read as text.
BINARY_SUFFIXES = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "pdf", "woff", "woff2", "ttf", "eot",
    "zip", "gz", "tar", "7z", "dll", "exe", "so", "dylib", "pyc", "class", "otf",
)


def read_text_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files as (path, text); those with a binary suffix, with a NUL near the start or not in UTF-8 are left out."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    text_like = files.filter(~F.lower("path").rlike(rf"\.(?:{'|'.join(BINARY_SUFFIXES)})\z"))
    clean = text_like.filter(F.position(F.lit(b"\x00"), F.substring("content", 1, 4096)) == 0)
    decoded = clean.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return decoded.filter(F.col("text").isNotNull())


def read_captures(spark: SparkSession, path: str, **options) -> DataFrame:
    """Capture JSON files as (path, source, model, pages), schema declared."""
    raw = spark.read.schema(CAPTURE_SCHEMA).option("multiLine", True).options(**options).json(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), "source", F.col("modelVersion").alias("model"), "pages")


def rebuild_blocks(df: DataFrame, raw: str = "raw_json", page_texts: str = "page_texts", key: str = "doc_id") -> DataFrame:
    """Blocks of stored captures, one row each; a capture that does not read falls back to page text.

    The fallback has a block per text line, without confidence and coordinates. ``input`` says
    which of the two (BLOCKS or PAGE_TEXT) the row came from.
    """
    schema = f"struct<pages:array<{PAGE}>,_corrupt:string>"
    read = F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = df.withColumn("_c", read)
    pages = F.col("_c.pages")
    broken = lambda p: p["blocks"].isNull() | p["page"].isNull() | F.exists(
        p["blocks"], lambda b: b["boundingBox"].isNull()
    )
    usable = F.coalesce(F.col("_c._corrupt").isNull() & (F.size(pages) > 0) & ~F.exists(pages, broken), F.lit(False))
    stored = F.from_json(page_texts, PAGE_TEXTS)
    blank = F.struct(F.lit(None).cast("decimal(5,4)").alias("confidence"), F.array().cast("array<double>").alias("boundingBox"))
    plain = F.transform(
        stored,
        lambda p: F.struct(
            p["pageNumber"].alias("page"),
            F.transform(
                F.split(p["text"], "\n"),
                lambda t: F.struct(t.alias("text"), blank["confidence"].alias("confidence"), blank["boundingBox"].alias("boundingBox")),
            ).alias("blocks"),
        ),
    )
    full = F.transform(
        pages,
        lambda p: F.struct(
            p["page"].alias("page"),
            F.transform(
                p["blocks"],
                lambda b: F.struct(F.coalesce(b["text"], F.lit("")).alias("text"), b["confidence"].alias("confidence"), b["boundingBox"].alias("boundingBox")),
            ).alias("blocks"),
        ),
    )
    chosen = parsed.select(
        key,
        F.when(usable, "BLOCKS").otherwise("PAGE_TEXT").alias("input"),
        F.posexplode_outer(F.when(usable, full).otherwise(plain)).alias("page_no", "p"),
    ).filter("p IS NOT NULL")
    return chosen.select(key, "input", "page_no", F.col("p.page").alias("page"), F.posexplode_outer("p.blocks").alias("block_no", "b")).filter("b IS NOT NULL").select(
        key, "input", "page_no", "page", "block_no", "b.text", "b.confidence", F.col("b.boundingBox").alias("bbox")
    )


def flatten_lines(blocks: DataFrame, key: str = "doc_id", page: str = "page_no", block: str = "block_no") -> DataFrame:
    """Non-blank blocks in reading order, trimmed and numbered from 0 across pages, with folded text and box."""
    kept = blocks.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(BLANK)).withColumn("text", trim_blank(F.col("text")))
    numbered = ordered_positions(kept, [key], {"page": F.col(page)}, [block], "line_no").withColumn("line_no", F.col("line_no") - 1)
    folded = numbered.withColumn("folded", fold(F.col("text")))
    return with_box(folded) if "bbox" in blocks.columns else folded


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+\z", "")
