"""Rectangles of polygons given as x, y, x, y, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_box(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Adds left, top, right, bottom; all null for fewer than four numbers."""
    enough = F.size(bbox) >= 4
    pairs = F.slice(F.col(bbox), F.lit(1), (F.size(bbox) / 2).cast("int") * 2)
    xs = F.filter(pairs, lambda _, i: i % 2 == 0)
    ys = F.filter(pairs, lambda _, i: i % 2 == 1)
    return df.withColumns(
        {
            "left": F.when(enough, F.array_min(xs)),
            "top": F.when(enough, F.array_min(ys)),
            "right": F.when(enough, F.array_max(xs)),
            "bottom": F.when(enough, F.array_max(ys)),
        }
    )


def polygon(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Axis-aligned corners, clockwise from the upper left."""
    return F.array(left, top, right, top, right, bottom, left, bottom)


def centre(low: Column, high: Column) -> Column:
    return (low + high) / 2
