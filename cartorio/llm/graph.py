"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Labels flow over links and jump to the label of their label, so a round halves paths at least; every
    round is a written table. A node with many links is a grouped minimum, never a gathered list.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.keep(both, f"{name}-links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        step = low.join(above, "low", "left").select("node", "was", F.least("low", "top").alias("component"))
        turn += 1
        step = scratch.keep(step, f"{name}-{turn}")
        changed = step.filter("was <> component").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = step.select("node", "component")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels
