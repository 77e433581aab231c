"""Registry of the example queries and the SQL they are checked against.

Each query runs an operator of the library over tables derived from the star-schema tables; the
derivations are written once per dialect, the operator is not.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from cartorio.bounds import literal_table
from cartorio.session import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(1998, 6, 1)
NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


class Tables:
    """Lazy access to the tables of one scale directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    @property
    def documents(self) -> DataFrame:
        return spread(read_table(self.spark, self.root, "documents"))

    def literal(self, rows, schema: str) -> DataFrame:
        return literal_table(self.spark, rows, schema)


def query(name: str, oracle: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, root: function(Tables(spark, root))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def values(rows, columns: str) -> str:
    """A DuckDB VALUES table of literal rows."""
    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, list):
            return "[" + ", ".join(text(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows) + f") AS v({columns}))"
