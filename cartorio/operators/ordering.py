"""Positions inside a key without bringing a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_positions(
    df: DataFrame, keys: Sequence[str], slices: dict[str, Column], order: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """1-based position per key, for an order that starts with the slices.

    A key may hold a large share of all rows, so it is cut in ordered slices: rows are ranked
    inside a slice, and the rank is shifted by the sizes of the slices before it. Only slice
    counts are ever brought together per key.
    """
    aliases = [f"_slice_{label}" for label in slices]
    sliced = df.withColumns(dict(zip(aliases, slices.values())))
    by = [*keys, *aliases]
    sizes = sliced.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*aliases).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.select(*[F.col(c).alias(f"{c}_r") for c in by], "_offset")
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    match = [ranked[c].eqNullSafe(offsets[f"{c}_r"]) for c in by]
    joined = ranked.join(offsets, match)
    return joined.withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint")).drop(
        *aliases, "_rank", "_offset", *[f"{c}_r" for c in by]
    )


def with_previous(positioned: DataFrame, key: str, column: str, name: str, position: str = "position") -> DataFrame:
    """The value one position earlier, by an equality join on (key, position)."""
    earlier = positioned.select(key, (F.col(position) + 1).alias(position), F.col(column).alias(name))
    return positioned.join(earlier, [key, position], "left")
