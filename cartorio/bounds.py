"""Size checks that stand in front of every broadcast and every driver-side read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024
CATALOGUE_LIMIT_ROWS = 5_000


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate: exact for literal rows, an upper bound for files and filters."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(stats.sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - no JVM handle (remote session): size unknown
        return None


def hint_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint when the estimate proves the side small; otherwise the plain side, so that
    Spark plans a shuffle join (and may still switch at run time)."""
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def grown(df: DataFrame) -> DataFrame:
    """A join side that has more rows than its source because of a generator: never planned as a broadcast.

    The planner takes a generator's output to be as large as its input, and would build many times the broadcast
    limit in the driver.
    """
    return df.hint("merge")


def catalogue_rows(df: DataFrame, limit: int = CATALOGUE_LIMIT_ROWS) -> list[Row] | None:
    """Rows of a configuration table, or None when it has more than ``limit`` rows.

    Callers must have a join-based way for the None case.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Rows given in code as plan constants, so that their exact size is known to the planner."""
    fields = T._parse_datatype_string(f"struct<{', '.join(_field(p) for p in _split(schema))}>").fields

    def constant(value) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[constant(v) for v in value])
        return F.lit(value)

    structs = [
        F.struct(*[constant(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], T.StructType(fields))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def _split(schema: str) -> list[str]:
    return [part.strip() for part in schema.split(",")]


def _field(part: str) -> str:
    name, kind = part.split(" ", 1)
    return f"{name}:{kind}"
