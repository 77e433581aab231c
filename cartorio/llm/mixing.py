"""Mixing sources to target weights by nested hash thresholds, built-in functions only.

Every row has a hash of its id. A source that is to give ``target`` words of ``source_size`` takes each of its
rows ``target // source_size`` times, and once more those whose hash is below a threshold. The threshold comes
from a histogram of words by source and leading hash bits: the bucket that crosses the budget is refined by
the next bits, and only its rows are read for that. Nothing is sorted; the same rows give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartorio.llm.shared import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
#: Percent of all words that the mix holds, and the most times a source is repeated.
SHARE, REPEATS = 150, 2
#: Bits of the hash, and bits read per level.
BITS, STEP = 48, 12


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(key: Column) -> Column:
    """48 bits of the md5 of the id's text, evenly spread; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source (source, size): its weight by rank, and the words it is to give.

    Sources in code point order, null last, get the weights in turn. All together are to give ``share`` percent
    of all words; a source stops at ``repeats`` times its size and the excess goes to the others by weight.
    Ordered by the level at which they fill up, sources that fill up come first, so that one running sum finds
    the common level. A row per source, whatever the number of rows; targets are rounded to 6 places.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", F.col("size").alias("source_size"), (F.row_number().over(by_name) - 1).alias("rank"))
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("weight", F.get(turn, F.col("rank") % len(weights)).cast("double"))
    cap = (F.col("source_size") * repeats).cast("double")
    by_level = W.orderBy(cap / F.col("weight"), "rank")
    whole = W.partitionBy()
    room = weighed.select(
        "*",
        cap.alias("cap"),
        (F.sum("source_size").over(whole) * share / F.lit(100.0)).alias("budget"),
        F.coalesce(F.sum(cap).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    )
    level = (F.col("budget") - F.col("filled")) / F.col("open")
    # The first source whose cap lies above the level that is left sets it for all that follow.
    fits = room.withColumn("level", F.when(F.col("weight") * level < F.col("cap"), level))
    first = fits.withColumn("first", F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("first.level"), F.col("cap")))
    return first.select("source", "source_size", F.round(target, 6).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, times, below): rows are taken ``times`` times and once more if position < below.

    ``rows`` has (source, size, position). The last bucket is taken if that comes nearer to the target. The
    edges of a level, a row per source, are written before the next one reads them.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.select("*", times.alias("times")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    edge = scratch.keep(edge.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("going")), "level-0")
    for level in range(1, BITS // STEP + 1):
        left = BITS - STEP * level
        shift = f"shiftright(position, {left})"
        inside = rows.join(
            edge.filter("going and rest > 0").select(F.col("source").alias("s"), "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"shiftright(position, {left + STEP})") == F.col("prefix")),
        )
        histogram = inside.groupBy("source", F.expr(shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        running = histogram.select(F.col("source").alias("s"), "bucket", "words", upto.alias("upto"))
        crossed = running.join(edge.select(F.col("source").alias("e"), "rest"), F.col("s").eqNullSafe(F.col("e"))).filter("upto > rest and upto - words <= rest")
        found = crossed.groupBy("s").agg(F.min(F.struct("bucket", "words", "upto")).alias("at"))
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "times",
            # No bucket crosses: what is left is the whole of the bucket above, whose end is the next one's start.
            F.when(F.col("at").isNotNull(), F.col("rest") - (F.col("at.upto") - F.col("at.words"))).otherwise(F.col("rest")).alias("rest"),
            F.coalesce(F.col("at.bucket"), F.expr(f"shiftleft(prefix, {STEP})")).alias("prefix"),
            F.col("at").isNotNull().alias("going"),
            F.coalesce(F.col("at.words"), F.lit(0)).alias("last"),
        )
        edge = scratch.keep(edge, f"level-{level}")
    nearer = F.col("last") - F.col("rest") < F.col("rest")
    below = F.col("prefix") + F.when(F.col("going") & (F.col("rest") > 0) & nearer, 1).otherwise(0)
    return edge.select("source", "source_size", "target", "times", below.cast("long").alias("below"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target and copies (how often the mix takes the row).

    ``docs`` has (doc_id, text, source); columns of the new names are replaced. Null text: size 0. Null is a
    source of its own. Rows of one id share a hash, so they are taken alike. An empty table gives an empty one.
    """
    made = ["size", "source_size", "target", "copies"]
    names = [c for c in docs.columns if c not in made]
    scratch = Scratch(docs.sparkSession, "mixing")
    place = position(F.col("doc_id"))
    rows = scratch.keep(docs.select(F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), place.alias("position")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    edges = scratch.keep(thresholds(rows, source_targets(sizes, weights, share, repeats), scratch), "edges")
    scratch.drop("rows", *(f"level-{n}" for n in range(BITS // STEP + 1)))
    cut = edges.withColumnRenamed("source", "_source")
    joined = docs.select(F.struct(*names).alias("_row"), F.col("source").cast("string").alias("_s"), words_of(F.col("text")).alias("size"), place.alias("_place"))
    joined = joined.join(cut, F.col("_s").eqNullSafe(F.col("_source")))
    return joined.select("_row.*", "size", "source_size", "target", (F.col("times") + (F.col("_place") < F.col("below")).cast("long")).alias("copies"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, {BITS // 4}))::BIGINT AS position FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1]::DOUBLE AS weight, {REPEATS}.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * {SHARE} / 100.0::DOUBLE AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
f AS (SELECT (budget - filled) / open AS level FROM r WHERE weight * (budget - filled) / open < cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, coalesce(weight * (SELECT level FROM f), cap)), 6) AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.position) AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
