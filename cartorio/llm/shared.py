"""Intermediate tables in the folder that the cluster shares, and Arrow helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_TEST_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own (tests); a cluster raises, since
    a folder of one machine is of no use to the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return _TEST_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now: it does so when their plans are collected as garbage."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Named tables of one run below the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes the rows once and reads them back. What the shuffles before it left on disk may go then."""
        df.write.option("compression", codec).parquet(self.path(name))
        free_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        offsets = text_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(offsets.searchsorted(offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(column: pa.Array):
    """Byte offsets of the values of a string column into its buffer, as a numpy array."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffer = column.buffers()[1]
    if buffer is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
