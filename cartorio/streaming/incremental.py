"""Incremental processing of arriving captures with the batch operators.

An attempt at a document is a version of its own: it is worked on, stored and replaced under (doc_id, attempt). A store has
two tables below one folder, ``fields`` and ``attempts``, in partitions by batch. A batch that is run again
replaces its own partitions. The row of an attempt is written after its fields, and an attempt without fields (an unknown
class, an empty page) has one too, so that it withdraws what earlier attempts had found.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartorio.operators.classify import classify
from cartorio.plans.extract import extract_fields
from cartorio.session import cut_lineage
from cartorio.sources.lines import CAPTURE_SCHEMA, flatten_lines

ARRIVALS = f"doc_id bigint, attempt int, {CAPTURE_SCHEMA}"
UNKNOWN = "UNKNOWN"


def _versions(captures: DataFrame) -> DataFrame:
    """One row per attempt: of several captures of one attempt the last one in the order of their contents. ``version`` stands for both ids."""
    same = captures.groupBy("doc_id", "attempt").agg(F.max_by("pages", F.xxhash64(F.to_json("pages"))).alias("pages"))
    return same.withColumn("version", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("attempt").cast("string")))


def capture_lines(captures: DataFrame) -> DataFrame:
    """Lines with boxes of capture rows (doc_id, attempt, pages)."""
    pages = captures.select("doc_id", "attempt", F.posexplode_outer("pages").alias("page_no", "p")).filter("p IS NOT NULL")
    blocks = pages.select("doc_id", "attempt", "page_no", F.col("p.page").alias("page"), F.posexplode_outer("p.blocks").alias("block_no", "b")).filter("b IS NOT NULL")
    return flatten_lines(
        blocks.select("doc_id", "attempt", "page_no", "page", "block_no", "b.text", "b.confidence", F.col("b.boundingBox").alias("bbox"))
    )


def process_captures(captures: DataFrame, rules: DataFrame, today: date) -> tuple[DataFrame, DataFrame]:
    """(fields, attempts) of captures: one row per attempt and field, and one per attempt with its class and number of lines."""
    versions = cut_lineage(_versions(captures))
    lines = cut_lineage(capture_lines(versions))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    texts = lines.groupBy("doc_id", "attempt").agg(joined.alias("text"), F.count("*").alias("lines"))
    classes = cut_lineage(classify(texts, rules).select("doc_id", "attempt", "lines", "document_type", "score"))
    named = versions.select("doc_id", "attempt", "version").join(classes, ["doc_id", "attempt"], "left")
    attempts = named.select("doc_id", "attempt", "version", F.coalesce("document_type", F.lit(UNKNOWN)).alias("document_type"), "score", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))
    # Extraction knows versions only: two attempts at one document are two documents to it.
    typed = lines.join(attempts.select("doc_id", "attempt", "version", "document_type"), ["doc_id", "attempt"])
    found = extract_fields(typed.drop("doc_id", "attempt").withColumnRenamed("version", "doc_id"), today)
    fields = attempts.select("version", "doc_id", "attempt").join(found.withColumnRenamed("doc_id", "version"), "version").drop("version")
    return fields, attempts.drop("version")


def publish(fields: DataFrame, attempts: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch under its own id: a repeated batch overwrites itself, so nothing doubles. Attempts come last: what has no row there is not read."""
    for name, rows in (("fields", fields), ("attempts", attempts)):
        writer = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        # A dynamic overwrite leaves partitions alone that get no rows, so a batch without any is written as a folder of its own.
        if rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        else:
            writer.partitionBy("batch_id").parquet(f"{path}/{name}")


def _listed(spark: SparkSession, folder: str, prefix: str) -> list[tuple[int, object, object]]:
    """(number, path, file system) of sub-folders ``<prefix><number>``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [s.getPath() for s in store.listStatus(root)]
    return sorted(((int(p.getName()[len(prefix):]), p, store) for p in names if p.getName().startswith(prefix)), key=lambda x: x[0])


def _snapshot(spark: SparkSession, path: str) -> int | None:
    """Last batch in the newest whole snapshot; its attempts are written last."""
    jvm = spark.sparkContext._jvm
    whole = [n for n, p, store in _listed(spark, f"{path}/snapshots", "through=") if store.exists(jvm.org.apache.hadoop.fs.Path(p, "attempts/_SUCCESS"))]
    return max(whole) if whole else None


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the newest snapshot and of the batches after it."""
    through = _snapshot(spark, path)
    rows = None
    if _listed(spark, f"{path}/{name}", "batch_id="):
        rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch_id", F.col("batch_id").cast("long"))
    if through is None:
        return rows
    old = spark.read.parquet(f"{path}/snapshots/through={through}/{name}")
    return old if rows is None else old.unionByName(rows.filter(F.col("batch_id") > through))


def current_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt of every document, from the last batch that wrote it."""
    rows = _table(spark, path, "attempts")
    rest = [c for c in rows.columns if c not in ("doc_id", "attempt", "batch_id")]
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("attempt", "batch_id", *rest)).alias("n"))
    return newest.select("doc_id", "n.*")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current fields: per document those of its last attempt, none if that found none."""
    current = current_attempts(spark, path).select("doc_id", "attempt", "batch_id")
    return _table(spark, path, "fields").join(current, ["doc_id", "attempt", "batch_id"], "left_semi").drop("batch_id")


def compact(spark: SparkSession, path: str) -> int | None:
    """Writes the current attempts and fields as a snapshot and removes the batches in it; returns the last of these.

    Call it between runs. A snapshot that was not finished is not read, and is written anew the next time.
    """
    batches = [n for n, _, _ in _listed(spark, f"{path}/attempts", "batch_id=")]
    if not batches:
        return _snapshot(spark, path)
    through, before = max(batches), _snapshot(spark, path)
    if through == before:
        return through
    current = cut_lineage(current_attempts(spark, path))
    fields = _table(spark, path, "fields").join(current.select("doc_id", "attempt", "batch_id"), ["doc_id", "attempt", "batch_id"], "left_semi")
    for name, rows in (("fields", fields), ("attempts", current)):
        rows.write.mode("overwrite").parquet(f"{path}/snapshots/through={through}/{name}")
    for name in ("attempts", "fields"):
        for number, folder, store in _listed(spark, f"{path}/{name}", "batch_id="):
            if number <= through:
                store.delete(folder, True)
    for number, folder, store in _listed(spark, f"{path}/snapshots", "through="):
        if number < through:
            store.delete(folder, True)
    return through


def run_incremental(spark: SparkSession, source: str, target: str, checkpoint: str, rules: DataFrame, today: date, files_per_batch: int = 1000):
    """Work off all new capture files and stop; safe to call again after a failure."""
    arrivals = spark.readStream.schema(ARRIVALS).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(source)

    def step(batch: DataFrame, batch_id: int) -> None:
        publish(*process_captures(batch, rules, today), batch_id, target)

    query = arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
