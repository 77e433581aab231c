"""Reading quality: how much of what should be on a page was recognised."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cartorio.bounds import CATALOGUE_LIMIT_ROWS, hint_small
from cartorio.functions import nearest
from cartorio.functions.pieces import piece_list, pieces_in
from cartorio.operators.classify import contains_join, grams
from cartorio.session import cut_lineage

# Fixed value: similarity from which an item counts as read.
SIMILAR = 0.9
#: Letters of a gram.
GRAM = 3


def _holding(items: DataFrame, blocks: DataFrame, key: str, gram: int = 8) -> DataFrame:
    """Rows of (item, block holding it), by equality joins on item prefixes; short items on their whole length."""
    long = contains_join(blocks, items, "block", "item", gram, (key,))
    brief = items.filter(F.length("item") < gram)
    listed = piece_list(brief, "item")
    if listed is not None:
        held = F.transform(pieces_in(F.col("block"), listed), lambda p: p["piece"])
    else:
        held = F.array_distinct(F.flatten(F.array(*[grams(F.col("block"), n) for n in range(1, gram)])))
    short = blocks.withColumn("item", F.explode_outer(held)).filter(F.contains("block", "item")).join(hint_small(brief), [key, "item"])
    columns = ["item_id", *blocks.columns]
    if listed == []:
        return long.select(*columns)
    return long.select(*columns).unionByName(short.select(*columns))


def contained_items(items: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Ids of items that stand inside some block of their sample."""
    return _holding(items, blocks.select(key, "block"), key).select("item_id").distinct()


def allowed_edits(length: Column, similar: float = SIMILAR) -> Column:
    """Edits within which a text of ``length`` letters, the longer one of two, is as similar as asked."""
    return F.floor(F.round(length * (1 - similar), 9)).cast("int")


def _gram_rows(texts: DataFrame, name: str) -> DataFrame:
    """One row per gram of a text: its columns, gram and its place."""
    spots = F.sequence(F.lit(1), F.length(name) - (GRAM - 1))
    grams = F.transform(F.when(F.length(name) >= GRAM, spots).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(name), i, F.lit(GRAM)))
    return texts.select("*", F.posexplode(grams).alias("place", "gram"))


def _leading(rows: DataFrame, by: Sequence[str], length: Column, similar: float) -> DataFrame:
    """The rarest grams of a text, so many that a similar one shares one of them.

    ``rows`` are the grams of texts that any item has, with ``uses`` and ``known``, the number of such grams of the text.
    What no item has is rarer than all of these and comes first, so a text may have no leading gram left.
    """
    longest = F.floor(F.round(length / similar, 9))
    lead = GRAM * allowed_edits(longest, similar) + 1
    strange = length - (GRAM - 1) - F.col("known")
    order = Window.partitionBy(*by).orderBy("uses", "gram", "place")
    return rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") + strange <= lead).drop("_nth")


def _pieces(items: DataFrame, similar: float) -> DataFrame:
    """One row per piece of an item, so many pieces that a similar block, of any length, has one of them unchanged."""
    size = F.length("item")
    count = allowed_edits(F.floor(F.round(size / similar, 9)), similar) + 1
    cut = lambda i: F.floor(size * i / F.col("_count")).cast("int")
    piece = lambda i: F.struct(F.substring(F.col("item"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"), (cut(i) + 1).alias("_place"))
    counted = items.filter(size >= GRAM).withColumn("_count", count)
    return counted.withColumn("_p", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("_count") - 1), piece))).select(*items.columns, "_p.*")


def _similar_by_pieces(pieces: DataFrame, blocks: DataFrame, listed: Sequence[str], key: str, similar: float) -> DataFrame:
    """``similar_pairs`` for items whose pieces fit in a task; repeated finds of a pair are put together in the end."""
    hits = blocks.withColumn("_hit", F.explode_outer(pieces_in(F.col("block"), listed, places=True))).select(*blocks.columns, "_hit.piece", "_hit.place")
    bound = allowed_edits(F.greatest(F.length("item"), F.length("block")), similar)
    close = (F.abs(F.length("item") - F.length("block")) <= bound) & (F.abs(F.col("place") - F.col("_place")) <= bound)
    met = hits.join(hint_small(pieces), [key, "piece"]).filter(close & (F.length("block") >= GRAM))
    edits = F.levenshtein("item", "block")
    near = met.select(key, "item_id", "block_no", "item", "block", edits.alias("edits")).filter(F.col("edits") <= bound)
    return near.distinct()


def similar_pairs(items: DataFrame, blocks: DataFrame, key: str = "sample", similar: float = SIMILAR) -> DataFrame:
    """(item_id, block_no, item, block, edits): pairs of a sample within 1 - ``similar`` of the longer one's letters in edits.

    Of two texts within k edits, one of k + 1 pieces of the one stands unchanged in the other, at most k places away. Up
    to the size for tasks, blocks are searched for all pieces of all items in one pass, and meet items on what they have.

    Beyond, a join on shared grams with a prefix filter. Grams are in one order, from those that fewest items use; of two texts
    within k edits, one of the first 3 k + 1 grams of both is the same and stands at most k places apart. A block
    hands on only grams that items have, and none if its first ones are all strange. Lengths and places
    differ by k at most; the few pairs left are compared as a whole.

    Items: item_id, ``key``, item; blocks: block_no, ``key``, block. ``similar`` has to be so high (five sixths or so) that
    similar texts always share a gram. Nulls and texts of under three letters are similar to nothing.
    """
    if any(n - (GRAM - 1) - GRAM * int(n * (1 - similar) + 1e-9) < 1 for n in range(GRAM, 1000)):
        raise ValueError(f"texts of a similarity of {similar} need not have a gram of {GRAM} letters in common")
    pieces = _pieces(items.select("item_id", key, "item"), similar)
    listed = piece_list(pieces, "piece")
    if listed is not None:
        return _similar_by_pieces(pieces, blocks.select("block_no", key, "block"), listed, key, similar)
    asked = _gram_rows(items.select("item_id", key, "item"), "item").withColumn("length", F.length("item"))
    uses = cut_lineage(asked.groupBy(key, "gram").agg(F.count_distinct("item_id").alias("uses")))
    kept = asked.join(uses, [key, "gram"]).withColumn("known", F.length("item") - (GRAM - 1))
    kept = _leading(kept, ["item_id", key], F.col("length"), similar).select("item_id", key, "gram", F.col("place").alias("_place"), F.col("length").alias("_length"))

    # Blocks travel as numbers: their texts are fetched for pairs alone.
    offered = _gram_rows(blocks.select("block_no", key, "block"), "block").withColumn("length", F.length("block")).drop("block")
    met = offered.join(hint_small(uses), [key, "gram"])
    sizes = met.groupBy("block_no", key).agg(F.count("*").alias("known"))
    lead = GRAM * allowed_edits(F.floor(F.round(F.col("length") / similar, 9)), similar) + 1
    possible = met.join(sizes, ["block_no", key]).filter(F.col("length") - (GRAM - 1) - F.col("known") < lead)
    ahead = _leading(possible, ["block_no", key], F.col("length"), similar)

    edits = allowed_edits(F.greatest("length", "_length"), similar)
    close = (F.abs(F.col("length") - F.col("_length")) <= edits) & (F.abs(F.col("place") - F.col("_place")) <= edits)
    pairs = ahead.join(hint_small(kept), [key, "gram"]).filter(close).select(key, "item_id", "block_no").distinct()
    whole = pairs.join(items.select("item_id", key, "item"), ["item_id", key]).join(blocks.select("block_no", key, "block"), ["block_no", key])
    bound = allowed_edits(F.greatest(F.length("item"), F.length("block")), similar)
    return whole.withColumn("edits", F.levenshtein("item", "block")).filter(F.col("edits") <= bound)


def similar_items(items: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Ids of items with a block of nearly the same letters."""
    return similar_pairs(items, blocks, key).select("item_id").distinct()


def read_recall(items: DataFrame, blocks: DataFrame, key: str = "sample", similar: bool = True) -> DataFrame:
    """Items with ``found``: contained in a block of the sample, or similar to one.

    Items: item_id, sample, item; blocks: block_no, sample, block; both already folded. Similarity is one less the edits
    as a share of the longer one's letters.
    """
    found = contained_items(items, blocks, key)
    if similar:
        rest = items.join(found, "item_id", "left_anti")
        found = found.unionByName(similar_items(rest, blocks, key)).distinct()
    return items.join(found.withColumn("_f", F.lit(True)), "item_id", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def recall_summary(marked: DataFrame, key: str = "sample") -> DataFrame:
    """Recall by item and by character, and the items that are missing."""
    size = F.length("item")
    return marked.groupBy(key).agg(
        F.round(F.count_if("found") / F.count(F.lit(1)), 4).alias("item_recall"),
        F.round(F.try_divide(F.sum(F.when(F.col("found"), size).otherwise(0)), F.sum(size)), 4).alias("char_recall"),
        F.count_if(~F.col("found")).alias("missing"),
    )


def expected_values(expected: DataFrame, blocks: DataFrame, key: str = "sample") -> DataFrame:
    """Expected values with ``exact`` and the first block of the sample that holds each.

    Expected: item_id, sample, item; blocks: sample, block_no, block.
    """
    held = _holding(expected, blocks, key).groupBy("item_id").agg(F.min(F.struct("block_no", "block")).alias("_h"))
    return expected.join(held, "item_id", "left").select(
        *expected.columns, F.col("_h").isNotNull().alias("exact"), F.col("_h.block_no").alias("block_no"), F.col("_h.block").alias("found_in")
    )


# Letters counted together; what is in none of them is counted as a rest.
LETTER_CLASSES = ("A", "E", "I", "OU", "MN", "LR", "ST", "BCDP")
#: Edits of the first round, and how much wider the next one looks.
FIRST_REACH, WIDER = 8, 4


def _placed(texts: DataFrame, pivots: DataFrame, name: str, key: str) -> DataFrame:
    """Texts with length, distances from the pivots of their sample, and letters by class."""
    length = F.length(name)
    counts = [length - F.length(F.translate(F.col(name), letters, "")) for letters in LETTER_CLASSES]
    placed = texts.join(hint_small(pivots), key)
    return placed.select(
        *texts.columns, length.alias("length"), F.levenshtein(name, "pivot_1").alias("far_1"), F.levenshtein(name, "pivot_2").alias("far_2"), F.array(*counts).alias("letters")
    )


def _least_edits(length: Column, other: Column, letters: Column, others: Column) -> Column:
    """Edits that are needed at least to turn one bag of letters into the other."""
    n = len(LETTER_CLASSES)
    rest = lambda size, bag: size - sum((bag[i] for i in range(1, n)), bag[0])
    gaps = [letters[i] - others[i] for i in range(n)] + [rest(length, letters) - rest(other, others)]
    over = [F.greatest(g, F.lit(0)) for g in gaps]
    under = [F.greatest(-g, F.lit(0)) for g in gaps]
    return F.greatest(sum(over[1:], over[0]), sum(under[1:], under[0]))


def closest_blocks(missing: DataFrame, blocks: DataFrame, key: str = "sample") -> DataFrame:
    """(item_id, distance, block_no, closest): the block of its sample that is nearest to a value by edit distance, the first of several.

    Missing: item_id, ``key``, item; blocks: block_no, ``key``, block. Up to the size for tasks, every task keeps the nearest of
    its own blocks for all values: blocks that differ too much in length or letters are left out, all others are compared,
    thousands of pairs at once. Blocks are read once and not shuffled.

    Beyond, values and blocks meet by joins. Edit distance is a metric, so texts within k edits
    differ by k at most in length and in their distance from any third text. Two values of a sample are such pivots; texts are
    cells of a grid of length and distance from the first. A round joins values with the cells in their reach
    and compares what the other bounds leave. A value is settled when something is found within its reach; else it
    looks four times as far, or as far as the nearest block it has met, whichever is less. The number of rounds is the
    logarithm of the longest text's length.

    Equal texts of a sample are compared once. Null values and blocks take no part, nor do values of a null sample; a value
    whose sample has no block gets no row. An empty value is as far from a block as that is long.
    """
    values = cut_lineage(missing.select("item_id", key, "item"))
    asked = values.filter(F.col("item").isNotNull() & F.col(key).isNotNull()).select(key, "item").distinct()
    found = _nearest_in_tasks(asked, blocks, key)
    if found is None:
        found = _nearest_by_rounds(asked, blocks, key)
    return values.join(found, [key, "item"]).select("item_id", "distance", "block_no", "closest")


def _nearest_in_tasks(asked: DataFrame, blocks: DataFrame, key: str) -> DataFrame | None:
    """(``key``, item, distance, block_no, closest) from one pass over the blocks, or None when there are more values than fit in a task."""
    size = asked.limit(CATALOGUE_LIMIT_ROWS + 1).agg(F.count("*"), F.sum(F.length("item"))).first()
    if size[0] > CATALOGUE_LIMIT_ROWS or (size[1] or 0) > nearest.TABLE_LIMIT:
        return None
    samples = asked.groupBy(key).agg(F.sort_array(F.collect_list("item")).alias("items")).withColumn("_sample", F.monotonically_increasing_id())
    samples = cut_lineage(samples)
    listed = {r["_sample"]: r["items"] for r in samples.select("_sample", "items").collect()}
    if sum(map(nearest.table_words, listed.values())) > nearest.TABLE_LIMIT:
        return None
    rows = blocks.filter(F.col("block").isNotNull()).join(F.broadcast(samples.select(key, "_sample")), key).select("_sample", "block_no", "block")
    schema = rows.select("_sample", F.lit(0).alias("_nth"), F.lit(0).alias("distance"), "block_no", F.col("block").alias("closest")).schema
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from nearest.nearest_rows(batches, listed, arrow)

    best = rows.mapInArrow(work, schema).groupBy("_sample", "_nth").agg(F.min(F.struct("distance", "block_no", "closest")).alias("b"))
    return samples.select("_sample", key, F.posexplode("items").alias("_nth", "item")).join(best, ["_sample", "_nth"]).select(key, "item", "b.*")


def _nearest_by_rounds(asked: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The same rows by rounds of joins on the cells of a grid, for values of any number."""
    pivot = lambda n: F.min(F.struct(F.xxhash64(F.lit(n), "item"), "item"))["item"]
    pivots = cut_lineage(asked.groupBy(key).agg(pivot(1).alias("pivot_1"), pivot(2).alias("pivot_2")))
    texts = blocks.filter(F.col("block").isNotNull()).groupBy(key, "block").agg(F.min("block_no").alias("block_no"))
    theirs = {c: f"_{c}" for c in ("length", "far_1", "far_2", "letters")}
    known = cut_lineage(_placed(texts, pivots, "block", key).withColumnsRenamed(theirs))
    waiting = cut_lineage(_placed(asked, pivots, "item", key).withColumn("reach", F.lit(FIRST_REACH)))
    longest = max(known.agg(F.max("_length")).first()[0] or 0, waiting.agg(F.max("length")).first()[0] or 0)

    settled, width, columns = [], FIRST_REACH, waiting.columns
    while True:
        cell = lambda value: F.floor(value / F.lit(width))  # noqa: B023, E731
        around = lambda value: F.sequence(cell(value - F.col("reach")), cell(value + F.col("reach")))
        seeking = waiting.withColumn("_row", F.explode(around(F.col("length")))).withColumn("_place", F.explode(around(F.col("far_1"))))
        offered = known.withColumns({"_row": cell(F.col("_length")), "_place": cell(F.col("_far_1"))})
        reach = F.col("reach")
        near = [F.abs(F.col(c) - F.col(f"_{c}")) <= reach for c in ("length", "far_1", "far_2")]
        bag = _least_edits(F.col("length"), F.col("_length"), F.col("letters"), F.col("_letters")) <= reach
        pairs = seeking.join(offered, [key, "_row", "_place"]).filter(near[0] & near[1] & near[2] & bag)
        best = pairs.groupBy(key, "item").agg(F.min(F.struct(F.levenshtein("item", "block").alias("distance"), "block_no", F.col("block").alias("closest"))).alias("b"))
        judged = cut_lineage(waiting.join(best, [key, "item"], "left"))
        within = F.coalesce(F.col("b.distance") <= F.col("reach"), F.lit(False))
        settled.append(judged.filter(within).select(key, "item", "b.*"))
        if width >= longest:
            break
        width *= WIDER
        waiting = judged.filter(~within).withColumn("reach", F.least(F.lit(width), F.col("b.distance"))).select(*columns)
        if waiting.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found
