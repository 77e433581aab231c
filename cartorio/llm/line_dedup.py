"""Line dedup: repeated runs of lines across documents, by prefix doubling over line-id sequences.

A document is the sequence of its ``\\n``-split lines that hold a word. A run of consecutive lines with
``min_words`` words or more that occurs before, in the order of documents and lines, is deleted; its first
occurrence stays.

1. Lines that occur once end all repeats; the others get ids in the order of their digests.
2. Prefix doubling ranks the suffixes of all documents by their first 1, 2, 4, ... lines: the rank at depth 2k
   is the place of the pair (rank at depth k, rank at depth k of the suffix k lines on) in the order of such
   pairs. A suffix alone in its rank takes no part in the next round. Ranks are the suffix array, inverted.
3. Suffixes that share their first m lines are an interval of the suffix array, named by the two ranks that
   cover m lines. A repeated run is a union of its shortest parts with ``min_words`` words, taken forwards
   from each of its lines and backwards from each; their intervals show which parts occur before.
   What these parts cover are the maximal runs. Parts have at most ``min_words`` lines, which bounds the rounds.

A line or run that many documents share is a partial aggregate in each step, never a gathered group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartorio.llm.shared import Scratch, small_batches

MIN_WORDS = 50
_KEY = ["d", "x"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of a document: its id (null apart) and a hash of its text."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), "x": F.xxhash64("text", F.col("doc_id").isNull())})


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 8 << 20):
        rows, high, low, words, place = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            at = 0
            for line in (text or "").encode().split(b"\n"):
                n = len(line.split())
                if n:
                    name = hashlib.blake2b(line, digest_size=16).digest()
                    high.append(int.from_bytes(name[:8], "little", signed=True))
                    low.append(int.from_bytes(name[8:], "little", signed=True))
                    rows.append(row)
                    words.append(n)
                    place.append(at)
                    at += 1
        taken = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("d").take(taken), batch.column("x").take(taken), pa.array(place, pa.int32()), pa.array(words, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
            ["d", "x", "at", "words", "high", "low"],
        )


def line_table(docs: DataFrame) -> DataFrame:
    """(d, x, at, words, high, low): lines with a word, numbered from 0 in their document, and their 128-bit digests."""
    lines = _keyed(docs.select("doc_id", "text")).select("d", "x", "text").mapInArrow(_lines, "d long, x long, at int, words int, high long, low long")
    return lines.dropDuplicates([*_KEY, "at"])  # rows of one id and text count once; texts stay where they are read


def _ranked(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rank`` of every value of ``by`` that two rows have at least: larger values, larger ranks."""
    repeated = rows.groupBy(*by).count().filter("count > 1").select(*by)
    return scratch.keep(repeated.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, depth: int, scratch: Scratch) -> dict[int, DataFrame]:
    """By 1, 2, 4, ... up to ``depth`` lines: (d, x, at, rank) of the suffixes whose beginning of that length is repeated.

    ``lines`` is a ``line_table``. Equal ranks, equal beginnings; ranks of one depth are in the order of the ranks of the depth before.
    """
    levels, k = {}, 1
    ids = _ranked(lines, ["high", "low"], scratch, "rank-1")
    levels[1] = scratch.keep(lines.join(ids, ["high", "low"]).select(*_KEY, "at", "words", "rank"), "level-1")
    while 2 * k <= depth:
        now = levels[k].select(*_KEY, "at", "rank")
        later = now.select(*_KEY, (F.col("at") - k).alias("at"), F.col("rank").alias("next"))
        pairs = scratch.keep(now.join(later, [*_KEY, "at"]), f"pairs-{2 * k}")
        names = _ranked(pairs.withColumnRenamed("rank", "first"), ["first", "next"], scratch, f"rank-{2 * k}")
        level = pairs.withColumnRenamed("rank", "first").join(names, ["first", "next"]).select(*_KEY, "at", "rank")
        k *= 2
        levels[k] = scratch.keep(level, f"level-{k}")
        scratch.drop(f"pairs-{k}", f"rank-{k}")
    return levels


def shortest_parts(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, x, at, size): shortest runs with ``min_words`` words that start, or that end, at each line of ``lines`` (d, x, at, words)."""
    doc = W.partitionBy(*_KEY)
    stretch = F.col("at") - F.row_number().over(doc.orderBy("at"))
    rows = lines.select(*_KEY, "at", "words", stretch.alias("stretch"))
    inside = W.partitionBy(*_KEY, "stretch")
    rows = rows.withColumn("end", F.sum("words").over(inside.orderBy("at").rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("words"))
    # Every line has a word, so the lines that begin, or end, less than min_words away are the part itself.
    forward = F.max(F.struct("at", "end")).over(inside.orderBy("begin").rangeBetween(0, min_words - 1))
    backward = F.min(F.struct("at", "begin")).over(inside.orderBy("end").rangeBetween(-(min_words - 1), 0))
    rows = rows.select(*_KEY, "at", "begin", "end", forward.alias("f"), backward.alias("b"))
    starts = rows.filter(F.col("f.end") - F.col("begin") >= min_words).select(*_KEY, "at", (F.col("f.at") - F.col("at") + 1).alias("size"))
    ends = rows.filter(F.col("end") - F.col("b.begin") >= min_words).select(*_KEY, F.col("b.at").alias("at"), (F.col("at") - F.col("b.at") + 1).alias("size"))
    return starts.unionByName(ends).distinct()


def later_copies(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(d, x, at, size): parts that occur before."""
    levels = suffix_ranks(lines, min_words, scratch)
    parts = scratch.keep(shortest_parts(levels[1], min_words), "parts")
    parts = parts.withColumn("depth", F.expr("shiftleft(1, length(bin(size)) - 1)"))
    ranks = None
    for depth, level in levels.items():
        level = level.select(*_KEY, "at", "rank", F.lit(depth).alias("depth"))
        ranks = level if ranks is None else ranks.unionByName(level)
    # Two ranks of the largest power of two within the size cover the part: they name its interval.
    head = parts.join(ranks.withColumnRenamed("rank", "head"), [*_KEY, "at", "depth"])
    tail = ranks.select(*_KEY, F.col("at").alias("from"), "depth", F.col("rank").alias("tail"))
    both = head.withColumn("from", F.col("at") + F.col("size") - F.col("depth")).join(tail, [*_KEY, "from", "depth"])
    both = scratch.keep(both.select(*_KEY, "at", "size", "head", "tail"), "intervals")
    firsts = both.groupBy("size", "head", "tail").agg(F.min(F.struct(*_KEY, "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return both.join(firsts, ["size", "head", "tail"]).filter(F.struct(*_KEY, "at") > F.col("first")).select(*_KEY, "at", "size")


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, gone, runs = [], [], [], []
        for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
            pieces = (text or "").split("\n")
            worded = [i for i, piece in enumerate(pieces) if piece.encode().split()]
            deleted: set[int] = set()
            for part in parts or []:
                deleted.update(worded[part["at"] : part["at"] + part["size"]])
            merged: list[list[int]] = []
            for place, i in enumerate(worded):
                if i in deleted:
                    if merged and merged[-1][0] + merged[-1][1] == place:
                        merged[-1][1] += 1
                    else:
                        merged.append([place, 1])
            texts.append("\n".join(p for i, p in enumerate(pieces) if i not in deleted) if deleted else text)
            lines.append(len(worded))
            gone.append(len(deleted))
            runs.append([{"start": a, "lines": b} for a, b in merged])
        run = pa.list_(pa.struct([("start", pa.int32()), ("lines", pa.int32())]))
        columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_deleted": pa.array(gone, pa.int64()), "runs": pa.array(runs, run)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted from ``text``, and n_lines, n_deleted and runs.

    ``docs`` has (doc_id, text); other columns are kept, but for n_lines, n_deleted and runs. n_lines counts lines with a
    word, ``runs`` the maximal deleted runs (start among these lines, number of lines). Documents are ordered by
    id, then by a hash of the text; rows of one id and text count once and lose the same lines. Null and empty texts stay as they are, with
    no lines; lines without a word are never deleted. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted", "runs")]
    lines = scratch.keep(line_table(docs), "lines")
    parts = scratch.keep(later_copies(lines, min_words, scratch), "copies")
    scratch.drop("lines", "parts", "intervals", "rank-1", *(f"level-{2**k}" for k in range(min_words.bit_length())))
    by_doc = parts.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "size")).alias("parts")).select(F.col("d").alias("_d"), F.col("x").alias("_x"), "parts")
    # The row goes along as one struct, so that its names meet no others.
    rows = _keyed(docs.select(F.struct(*names).alias("_row"), "doc_id", "text"))
    joined = rows.join(by_doc, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")), "left").select("_row.*", "text", "parts")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "text string, n_lines long, n_deleted long, runs array<struct<start: int, lines: int>>"])
    return joined.mapInArrow(lambda batches: _without(batches, names), schema)


ORACLE = f"""
WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
w AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM a),
p AS (SELECT doc_id, line, i, words, row_number() OVER o AS pl, sum(words) OVER o AS e, sum(words) OVER o - words AS b FROM w WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, list(line ORDER BY pl) AS lines, list(i ORDER BY pl) AS places FROM p GROUP BY doc_id),
f AS (SELECT doc_id, pl, b, e,
  max(pl) OVER (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS f_pl, max(e) OVER (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS f_e,
  min(pl) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) AS b_pl, min(b) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) AS b_b FROM p),
c AS (SELECT doc_id, pl AS low, f_pl AS high FROM f WHERE f_e - b >= {MIN_WORDS} UNION SELECT doc_id, b_pl, pl FROM f WHERE e - b_b >= {MIN_WORDS}),
g AS (SELECT doc_id, low, high, md5(array_to_string(list_slice(lines, low, high), chr(10))) AS body FROM c JOIN n USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, low) AS turn FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS pl FROM k WHERE turn > 1),
y AS (SELECT p.doc_id, p.i FROM x JOIN p ON x.doc_id = p.doc_id AND x.pl = p.pl),
z AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.i) FILTER (y.i IS NULL) AS text, count(y.i) AS n FROM a LEFT JOIN y ON a.doc_id = y.doc_id AND a.i = y.i GROUP BY a.doc_id)
SELECT s.doc_id, CASE WHEN z.n = 0 THEN s.text ELSE coalesce(z.text, '') END AS text, coalesce(len(n.lines), 0)::BIGINT AS n_lines, z.n::BIGINT AS n_deleted
FROM s JOIN z USING (doc_id) LEFT JOIN n USING (doc_id)
"""
