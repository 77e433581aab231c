"""Run counters collected while a job runs, without a second pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_counters(df: DataFrame, name: str, counts: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation with one number per condition once an action has run."""
    observation = Observation(name)
    totals = [F.count_if(condition).alias(label) for label, condition in counts.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *totals), observation
