"""Comparison keys of printed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.functions.folding import NOT_WORD

# Leading enumerators that may be printed in front of a label ("2", "2e", "2e1").
ENUMERATORS = (r"^[0-9]{1,2}", r"^[0-9]{1,2}[A-Z]", r"^[0-9]{1,2}[A-Z][0-9]{1,2}")
MINIMUM_LEFT = 3


def starts_with_digit(text: Column) -> Column:
    """What every enumerator begins with; cheaper than trying their shapes on each text."""
    return F.substring(text, 1, 1).between("0", "9")


def label_keys(folded: Column) -> Column:
    """Compact text, the same without an enumerator, and both for each side of a slash; in that order, distinct."""
    sides = F.filter(F.transform(F.split(folded, "/"), F.trim), lambda p: p != "")
    parts = F.concat(F.array(folded), F.when(folded.contains("/") & (F.size(sides) >= 2), sides).otherwise(F.array().cast("array<string>")))
    compact = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, NOT_WORD, "")), lambda k: k != "")

    def spelled(key: Column) -> Column:
        bare = [F.regexp_replace(key, e, "") for e in ENUMERATORS]
        kept = [F.when((b != key) & (F.length(b) >= MINIMUM_LEFT), b) for b in bare]
        return F.when(starts_with_digit(key), F.array_compact(F.array(key, *kept))).otherwise(F.array(key))

    return F.array_distinct(F.flatten(F.transform(compact, spelled)))


def with_label_keys(lines: DataFrame, folded: str = "folded") -> DataFrame:
    return lines.withColumn("label_keys", label_keys(F.col(folded)))
