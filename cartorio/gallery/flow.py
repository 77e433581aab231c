"""Queries over time-driven rules, SQL functions and intake readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartorio.functions import approximate, offsets
from cartorio.functions.folding import compact_of, fold
from cartorio.gallery.base import query
from cartorio.gallery.texts import SEARCH
from cartorio.sources.lines import rebuild_blocks
from cartorio.session import shared_folder
from cartorio.streaming import incremental
from cartorio.streaming.states import depth_per_minute as per_minute


@query(
    "depth_per_minute",
    "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type AS status, count(*) AS jobs FROM events GROUP BY 1, 2",
)
def depth_per_minute(t):
    jobs = t.events.select(F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return per_minute(jobs).select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "status", "jobs")


@query(
    "fuzzy_sql_function",
    f"WITH {SEARCH}, p AS (SELECT doc_id, compact, concat(substr(compact, 11, 6), '#', substr(compact, 18, 6)) AS pattern FROM search WHERE length(compact) >= 40) SELECT doc_id, 1 AS edits FROM p",
)
def fuzzy_sql_function(t):
    """The approximate matcher from SQL: a piece of each text with one letter spoiled is one edit away."""
    approximate.register_sql(t.spark)
    texts = t.documents.select("doc_id", compact_of(fold(F.col("text"))).alias("compact"))
    spoiled = texts.withColumn("pattern", F.concat(F.substring("compact", 11, 6), F.lit("#"), F.substring("compact", 18, 6)))
    spoiled.createOrReplaceTempView("spoiled_pieces")
    return t.spark.sql("SELECT doc_id, approximate_edits(compact, pattern) AS edits FROM spoiled_pieces WHERE length(compact) >= 40")


@query(
    "offsets_udtf",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+tion')) AS BIGINT) AS matches, md5(array_to_string(regexp_extract_all(text, '[A-Za-z]+tion'), ' ')) AS digest FROM documents WHERE regexp_matches(text, '[A-Za-z]+tion')",
)
def offsets_udtf(t):
    """Matches with offsets as a SQL table function: what stands at the offsets is what was matched, in order."""
    offsets.register_sql(t.spark)
    t.documents.createOrReplaceTempView("offset_documents")
    found = t.spark.sql("SELECT d.doc_id, m.start, substring(d.text, m.start + 1, m.finish - m.start) AS again FROM offset_documents d, LATERAL regex_offsets(d.text, '[A-Za-z]+tion') m")
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "again"))), lambda m: m["again"]), " ")
    return found.groupBy("doc_id").agg(F.count("*").alias("matches"), F.md5(in_order.cast("binary")).alias("digest"))


@query(
    "capture_read",
    "SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN 'PAGE_TEXT' ELSE 'BLOCKS' END AS input, CAST(sum(CASE WHEN conv_id % 3 = 0 THEN len(string_split(text, chr(10))) ELSE 1 END) AS BIGINT) AS blocks FROM conversations GROUP BY 1, 2",
)
def capture_read(t):
    """Stored captures rebuilt to blocks; a third of them is broken and falls back to page text."""
    box = F.array(*[F.lit(v) for v in (0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0)])
    block = F.struct("text", F.lit(0.5).cast("decimal(5,4)").alias("confidence"), box.alias("boundingBox"))
    page = F.struct(F.col("turn").cast("int").alias("page"), F.array(block).alias("blocks"))
    plain = F.struct(F.col("turn").cast("int").alias("pageNumber"), "text")
    stored = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(page)).alias("pages"))).alias("raw_json"), F.to_json(F.sort_array(F.collect_list(plain))).alias("page_texts")
    )
    broken = stored.withColumn("raw_json", F.when(F.col("doc_id") % 3 == 0, F.substring("raw_json", 1, 20)).otherwise(F.col("raw_json")))
    return rebuild_blocks(broken).groupBy("doc_id", "input").agg(F.count(F.lit(1)).alias("blocks"))




@query(
    "published_fields",
    "WITH a AS (SELECT user_id AS doc_id, CAST(event_id % 5 AS INTEGER) AS attempt, event_id % 3 AS batch, event_id, event_type FROM events), "
    "n AS (SELECT doc_id, max(attempt * 10 + batch) AS last FROM a GROUP BY 1) "
    "SELECT doc_id, attempt, concat('field-', event_id) AS path, event_type AS normalized FROM a JOIN n USING (doc_id) WHERE attempt * 10 + batch = last AND event_type <> 'click'",
)
def published_fields(t):
    """Attempts at documents stored in three batches, one of them twice, with a snapshot in between; what counts in the end."""
    folder = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).cast("int").alias("attempt"), F.concat(F.lit("field-"), "event_id").alias("path"), F.col("event_type").alias("normalized"), (F.col("event_id") % 3).alias("batch"))
    for batch in (0, 0, 1, 2):
        mine = rows.filter(F.col("batch") == batch).drop("batch")
        attempts = mine.groupBy("doc_id", "attempt").agg(F.min("normalized").alias("document_type"))
        incremental.publish(mine.filter("normalized <> 'click'"), attempts, batch, folder)
        if batch == 1:
            incremental.compact(t.spark, folder)
    return incremental.published(t.spark, folder).select("doc_id", "attempt", "path", "normalized")
