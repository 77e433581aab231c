"""Session set-up, table access and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "cartorio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; anything can be overridden."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        # Plans are built from many small expressions; call-site capture costs more than they do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxPlanStringLength", "200000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores dealt out to all cores; a large scan is left as it is.

    Meant for rows that cost much more to work on than to move, such as whole texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, below the one that ``spark.checkpoint.dir`` names.

    Where none is named, a local session takes a temporary folder (tests); a cluster raises, as executors can't
    share a folder of one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
