"""Ranked lexical search by pipelined term partitioning.

1. One pass over the documents makes postings of the asked terms: documents are dealt out in shards of ``SHARD`` rows,
   and a shard is one row of packed arrays (term, document, occurrences). Counts of documents and terms follow from it.
2. Every term has an owner. Owners are ordered from the rarest terms to the commonest, each with about twice the
   postings of the one before. A bundle is an item in a shard: it carries a sparse set of document accumulators.
3. Bundles travel through the owners: at each one they meet its postings of their shard (cogroup by shard and block of
   items), which add whole-number contributions.
4. What cannot be among the best ``TOP`` any more is left behind, which changes no result: the terms ahead of a bundle add
   no more than a known sum, so documents below the shard's own best by more than that go, and once the best are
   ahead by more, no new documents are taken up.
5. After the last owner a shard hands on its best of an item, and the best of those are the result.

Terms are compared by 64-bit hashes (two of them are taken for one with a probability of about 2**-64).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartorio.llm.hashing import LETTERS, word_hashes
from cartorio.llm.shared import Scratch, small_batches

TOP = 10
#: Documents, and postings, after which a shard is closed.
SHARD, SHARD_POSTINGS = 4096, 2_000_000
OWNERS = 4
#: Items whose terms the driver holds at once; a larger table is worked on in so many slices. Items that share a cogroup.
ITEMS, BLOCK = 4096, 256
#: Weights and shares in the formula of a contribution.
SCALE, TF, LENGTH = 1_000_000_000, 1000, 8
_U = np.uint64

_POSTINGS = "shard long, docs long, words long, ids array<long>, n binary, term binary, doc binary, tf binary"
_OWNED = "shard long, size int, ids array<long>, term binary, doc binary, impact binary"
_BUNDLE = "shard long, block int, item int, docs binary, scores binary"
_BEST = "item int, doc_id long, score long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        hashes, counts = word_hashes(batch.column("text"), LETTERS)
        rows = np.repeat(np.arange(batch.num_rows), counts)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])


def terms_of(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term hash) of ``items`` (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term long").distinct()


def _postings(terms: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        docs = postings = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, docs, postings
            term, doc, tf = (np.concatenate(x) for x in zip(*found))
            n = np.concatenate(sizes)
            order = np.lexsort((doc, term))
            all_ids = pa.concat_arrays(ids)
            row = [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                *(pa.array([a.tobytes()], pa.binary()) for a in (n, term[order].astype(np.int32), doc[order].astype(np.uint16), tf[order].astype(np.int32))),
            ]
            number += 1
            docs = postings = 0
            for held in (ids, sizes, found):
                held.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "docs", "words", "ids", "n", "term", "doc", "tf"])

        for big in small_batches(batches, "text"):
            for at in range(0, big.num_rows, SHARD):
                batch = big.slice(at, SHARD)
                if docs + batch.num_rows > SHARD and docs:
                    yield flush()
                hashes, counts = word_hashes(batch.column("text"), LETTERS)
                doc = np.repeat(np.arange(batch.num_rows), counts)
                place = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                hit = terms[place] == hashes if len(terms) else np.zeros(len(hashes), bool)
                key, tf = np.unique(doc[hit] * max(len(terms), 1) + place[hit], return_counts=True)
                found.append((key % max(len(terms), 1), key // max(len(terms), 1) + docs, tf))
                ids.append(batch.column("doc_id"))
                sizes.append(counts)
                docs += batch.num_rows
                postings += len(key)
                if postings > SHARD_POSTINGS:
                    yield flush()
        if docs:
            yield flush()

    return work


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term the documents and the most occurrences in one, summed up in the task."""
    df = most = np.zeros(0, np.int64)
    for batch in batches:
        for term, tf in zip(batch.column("term"), batch.column("tf")):
            term, tf = np.frombuffer(term.as_buffer(), np.int32), np.frombuffer(tf.as_buffer(), np.int32)
            if len(term):
                if int(term[-1]) >= len(df):
                    df, most = (np.append(a, np.zeros(int(term[-1]) + 1 - len(a), np.int64)) for a in (df, most))
                df[: term[-1] + 1] += np.bincount(term)
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                most[term[first]] = np.maximum(most[term[first]], np.maximum.reduceat(tf, first))
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(df[there]), pa.array(most[there])], ["term", "df", "most"])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def owner_of_terms(df: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Owner of each term: terms in ``order``, cut where 1, 3, 7 ... parts of all postings are reached."""
    passed = np.cumsum(df[order]) - df[order]
    edges = np.array([(2 ** (k + 1) - 1) / (2**OWNERS - 1) for k in range(OWNERS - 1)]) * max(int(df.sum()), 1)
    owners = np.zeros(len(df), np.int64)
    owners[order] = np.searchsorted(edges, passed, side="right")
    return owners


def _owned(owners: np.ndarray, owner: int, documents: int, words: int):
    """An owner's postings of each shard, with the share of a term's weight that a document gets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("n", np.int64), ("term", np.int32), ("doc", np.uint16), ("tf", np.int32))}
                own = owners[at["term"]] == owner
                length = 10 + (90 * at["n"] * documents) // max(words, 1)
                tf = at["tf"][own].astype(np.int64)
                impact = (SCALE * tf) // (TF * tf + LENGTH * length[at["doc"][own]])
                ids = batch.column("ids").slice(row, 1) if owner == OWNERS - 1 else pa.array([None], pa.list_(pa.int64()))
                packed = (at["term"][own], at["doc"][own], impact.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(row, 1), pa.array([len(at["n"])], pa.int32()), ids, *(pa.array([a.tobytes()], pa.binary()) for a in packed)],
                    ["shard", "size", "ids", "term", "doc", "impact"],
                )

    return work


def _kth(scores: np.ndarray) -> int:
    """The TOP-th best of the scores, 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - TOP)[len(scores) - TOP]) if len(scores) >= TOP else 0


def _visit(asked: list[np.ndarray], weights: np.ndarray, ahead: list[int], behind: list[int], last: bool):
    """An owner's work on the bundles of a shard and block. ``asked``: by item the owner's terms; ``ahead`` and ``behind``: the most that this owner and later ones, or later ones alone, add."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[1].as_py()
        held = {i: (d, s) for i, d, s in zip(*(left[c].to_pylist() for c in ("item", "docs", "scores")))}
        if right.num_rows:
            size = right["size"][0].as_py()
            term, doc, impact = (np.frombuffer(right[c][0].as_buffer(), t) for c, t in (("term", np.int32), ("doc", np.uint16), ("impact", np.int32)))
            ids = right["ids"][0]
        else:
            size, term, doc, impact, ids = SHARD, np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, np.int32), None
        out = []
        for item in range(block * BLOCK, min((block + 1) * BLOCK, len(asked))):
            total = np.zeros(size, np.int64)
            if item in held:
                total[np.frombuffer(held[item][0], np.uint16)] = np.frombuffer(held[item][1], np.int64)
            here = total > 0
            settled = _kth(total[here]) > ahead[item]
            lows, highs = np.searchsorted(term, asked[item], "left"), np.searchsorted(term, asked[item], "right")
            for t, low, high in zip(asked[item].tolist(), lows.tolist(), highs.tolist()):
                if low < high:
                    total[doc[low:high]] += weights[t] * impact[low:high].astype(np.int64)
            if settled:
                total[~here] = 0
            docs = np.flatnonzero(total)
            if len(docs):
                scores = total[docs]
                keep = scores + behind[item] >= _kth(scores)
                out.append((item, docs[keep], scores[keep]))
        if not last:
            names = [key[0].as_py()] * len(out), [block] * len(out), [i for i, _, _ in out], [d.astype(np.uint16).tobytes() for _, d, _ in out], [s.tobytes() for _, _, s in out]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(names, kinds)], ["shard", "block", "item", "docs", "scores"])
        rows: list[tuple] = []
        for item, docs, scores in out:
            best = sorted(((-s, i is None, i or 0) for s, i in zip(scores.tolist(), (ids[d].as_py() for d in docs.tolist()))))[:TOP]
            rows += [(item, None if none else i, -s) for s, none, i in best]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return work


def _search_slice(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Best documents of the items in ``wanted`` (item_id, term), which are ITEMS or about so many."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    kind = wanted.schema["item_id"].dataType
    by_item: dict = {}
    for row in wanted.collect():
        by_item.setdefault(row.item_id, []).append(row.term)
    names = list(by_item)
    terms = np.unique(np.array([t for ts in by_item.values() for t in ts], np.int64).view(_U))
    asked = [np.unique(np.searchsorted(terms, np.array(by_item[i], np.int64).view(_U))) for i in names]

    postings = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_postings(terms), _POSTINGS), "postings")
    sums = postings.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    documents, words = sums.docs or 0, sums.words or 0
    counts = postings.select("term", "tf").mapInArrow(_term_counts, "term int, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    df, most = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for row in counts.collect():
        df[row.term], most[row.term] = row.df, row.most
    weights = np.array([weight(documents, d) for d in df.tolist()], np.int64)
    owners = owner_of_terms(df, np.lexsort((np.arange(len(df)), df)))
    bound = weights * ((SCALE * most) // (TF * most + LENGTH * 10))

    blocks = -(-len(names) // BLOCK)
    bundles = spark.createDataFrame([], _BUNDLE)
    for owner in range(OWNERS):
        last = owner == OWNERS - 1
        ahead = [int(bound[a[owners[a] >= owner]].sum()) for a in asked]
        behind = [int(bound[a[owners[a] > owner]].sum()) for a in asked]
        own = postings.mapInArrow(_owned(owners, owner, documents, words), _OWNED).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        visit = _visit([a[owners[a] == owner] for a in asked], weights, ahead, behind, last)
        bundles = bundles.groupBy("shard", "block").cogroup(own.groupBy("shard", "block")).applyInArrow(visit, _BEST if last else _BUNDLE)
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}"))  # ITEMS rows or about so many
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = bundles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP best rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z as a-z. A document of n terms has the length
    m = 10 + 90 n N div L, for N documents that have terms and L terms in all of them; a term in df documents weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds w (10**9 tf div (1000 tf + 8 m)). Scores above 0 count, equal
    ones go by doc_id, a null id last. Every row is a document of its own, also where an id stands twice; rows of one
    item_id are one item with the terms of all of them. Null and empty texts have no terms; such items, and all items
    where there are no documents, have no rows. Other columns are ignored. Texts are whole, however long.
    """
    items = items.select("item_id", "text")
    slices = -(-items.count() // ITEMS)
    if not slices:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    docs = docs.select("doc_id", "text")
    wanted = terms_of(items)
    parts = [_search_slice(docs, wanted if slices == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)) for k in range(slices)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


ORACLE = """
WITH doc_terms AS (
    SELECT row_number() OVER () AS row, doc_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals
), item_terms AS (
    SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
    FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY 1, 2
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
