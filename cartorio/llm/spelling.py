"""Spelling variant grouping: words within one error of each other, by a bit-sliced position index.

``vocabulary`` counts the words of all texts. ``near_words`` finds for every word its near words: those that differ
by exactly one inserted, deleted or replaced code point. ``groups`` turns them into forms and roots.

1. A pair's shorter word, of length l, is cut into ``WINDOWS`` windows. One error lies in one of them, so the two words agree
   on all letters outside of it: these, the window and l make the key of a shard. A word is in the shards of its own
   length and of the one below it. Words of a shard differ in a few letters in one place, so shards stay small
   whatever beginnings or endings are frequent.
2. A task takes shards up to ``CELLS`` letters together as one vocabulary and indexes it: for every position and letter
   a bitset over the words. Each word of length l is then run through the index, one letter a step, for all 64 words
   of a machine word, and all asking words, at once. Three sets are tracked: no error so far (Z), one letter replaced (R), one
   letter more in the other word (I, whose position is shifted by one):

       I' = (I | Z) & B[i + 1, x_i]      R' = (R & B[i, x_i]) | (Z & ~B[i, x_i])      Z' = Z & B[i, x_i]

   A deletion is an insertion seen from the other word, so only the shorter word of a pair, or the first one, asks.
3. Where the error may stand in two windows, as in a run of one letter, its last place counts: Z holds at the beginning
   of the window and no longer at its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.llm.shared import Scratch

#: Words are made of these letters.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run of CUT_ONE_IN loses a letter.
CUT_ONE_IN = 31
WINDOWS = 4
#: Letters of the words that are indexed together, and asking words times machine words at once.
CELLS, ASKED = 1 << 19, 1 << 19
_U = np.uint64
_ONES = _U(2**64 - 1)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words (word, n) of ``docs`` (doc_id, text) with at least LEAST_LETTERS code points and LEAST_COUNT occurrences.

    Words are runs of letters with A-Z as a-z. With h the CRC-32 of ``<doc_id>:<run>``, a run whose h is a multiple of
    CUT_ONE_IN loses its code point h % length. Null text: no words; null id: an empty one.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("k"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r")).filter(F.length("r") >= LEAST_LETTERS)
    low = F.when(F.col("r").rlike("[A-Z]"), F.translate("r", UPPER, LOWER)).otherwise(F.col("r"))
    hashed = runs.select("k", low.alias("r")).select("r", F.crc32(F.concat("k", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    words = hashed.select(F.when(F.col("h") % CUT_ONE_IN == 0, cut).otherwise(F.col("r")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def shards(words: DataFrame) -> DataFrame:
    """Rows (l, shard, w, word, n): every word in the shards of its length and of the one below."""
    places = []
    for longer in (0, 1):
        length = F.length("word") - longer
        for w in range(WINDOWS):
            start, stop = F.floor(length * w / WINDOWS).cast("int"), F.floor(length * (w + 1) / WINDOWS).cast("int")
            left, right = F.substring("word", F.lit(1), start), F.substring("word", stop + 1 + longer, F.length("word"))
            places.append(F.struct(length.alias("l"), F.xxhash64(length, F.lit(w), left, right).alias("shard"), F.lit(w).alias("w")))
    placed = words.select("word", "n", F.explode(F.array(*places)).alias("p"))
    return placed.select("p.l", "p.shard", "p.w", "word", "n").filter(F.col("l") >= LEAST_LETTERS)


class PositionIndex:
    """Bitsets over a vocabulary: which words have a letter at a position."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """``codes``: a row of code points for each word, zeros after its end."""
        self.lengths = lengths
        self.machine_words = (len(codes) + 63) // 64
        self.alphabet = np.unique(codes[codes > 0])
        self.letters = np.searchsorted(self.alphabet, codes)
        depth = int(lengths.max(initial=0))
        self.bits = np.zeros((depth + 1) * max(1, len(self.alphabet)) * self.machine_words, _U)
        words, places = np.nonzero(codes)
        slot = (places * len(self.alphabet) + self.letters[words, places]) * self.machine_words + (words >> 6)
        np.bitwise_or.at(self.bits, slot, _U(1) << (words & 63).astype(_U))
        self.bits = self.bits.reshape(depth + 1, max(1, len(self.alphabet)), self.machine_words)

    def of_length(self, length: int) -> np.ndarray:
        """Bitset of the words with ``length`` letters."""
        flags = np.zeros(self.machine_words * 64, np.uint8)
        flags[: len(self.lengths)] = self.lengths == length
        return np.packbits(flags, bitorder="little").view(_U)

    def one_error(self, length: int, first: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking, found) of places of words: asking words have ``length`` letters, found ones as many or one more.

        For each word, ``first`` and ``last`` bound the words that it is compared with, ``start`` and ``stop`` the window of
        the error.
        """
        same, longer = self.of_length(length), self.of_length(length + 1)
        asking = np.flatnonzero(self.lengths == length)
        begin, end = first[asking] >> 6, (last[asking] - 1) >> 6
        spans = end - begin + 1
        cuts = np.searchsorted(np.cumsum(spans), np.arange(0, int(spans.sum()), ASKED), side="right") if len(spans) else []
        for low, high in zip(cuts, [*cuts[1:], len(asking)]):
            if low < high:
                yield from self._run(length, asking[low:high], begin[low:high], spans[low:high], first, last, start, stop, same, longer)

    def _run(self, length, asking, begin, spans, first, last, start, stop, same, longer):
        ask = np.repeat(asking, spans)
        at = np.arange(len(ask)) - np.repeat(np.cumsum(spans) - spans - begin, spans)
        low = np.maximum(first[ask] - at * 64, 0).astype(_U)
        high = np.minimum(last[ask] - at * 64, 64).astype(_U)
        none = (_ONES << low) & (_ONES >> (_U(64) - high))
        one, more = np.zeros(len(ask), _U), np.zeros(len(ask), _U)
        opened = np.where(start[ask] == 0, none, _U(0))
        closed = np.zeros(len(ask), _U)
        for i in range(length):
            letter = self.letters[ask, i]
            here = self.bits[i, letter, at]
            more = (more | none) & self.bits[i + 1, letter, at]
            one = (one & here) | (none & ~here)
            none = none & here
            opened = np.where(start[ask] == i + 1, none, opened)
            if i + 1 < length:
                closed = np.where(stop[ask] == i + 1, none, closed)
        found = ((one & same[at]) | ((more | none) & longer[at])) & opened & ~closed
        hits = np.flatnonzero(found)
        if len(hits):
            rows, bits = np.nonzero(np.unpackbits(found[hits].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            asked, other = ask[hits[rows]], at[hits[rows]] * 64 + bits
            once = (self.lengths[other] > length) | (other > asked)  # words of one length find each other
            yield asked[once], other[once]


def _best(words: np.ndarray, counts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    """Per word its number of near words and the one of the largest count, of equals the smallest."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[others], -counts[others], ends))
    ends, others = ends[order], others[order]
    first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    near = np.diff(np.append(first, len(ends)))
    own, best = ends[first], others[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(words[own].tolist(), pa.string()), pa.array(near, pa.int64()), pa.array(words[best].tolist(), pa.string()), pa.array(counts[best], pa.int64())],
        ["word", "near", "form", "form_n"],
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows (l, shard, w, word, n), as many shards of one l at once as fit."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        length = table["l"][0].as_py()
        words = np.array(table["word"].to_pylist())
        codes = words.view(np.uint32).reshape(len(words), -1)
        shard, w, counts = (table[c].to_numpy() for c in ("shard", "w", "n"))
        lengths = (codes > 0).sum(axis=1)
        cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (w[1:] != w[:-1])))
        sizes = np.diff(np.append(cut, len(shard)))
        first, last = np.repeat(cut, sizes), np.repeat(cut + sizes, sizes)
        index = PositionIndex(codes, lengths)
        found = list(index.one_error(length, first, last, w * length // WINDOWS, (w + 1) * length // WINDOWS))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield _best(words, counts, np.concatenate([a, b]), np.concatenate([b, a]))

    held: list[pa.Table] = []
    cells = 0
    open_rows: pa.Table | None = None

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if open_rows is not None:
            table = pa.concat_tables([open_rows, table])
        l, shard, w = (table[c].to_numpy() for c in ("l", "shard", "w"))
        fresh = np.append(True, (shard[1:] != shard[:-1]) | (l[1:] != l[:-1]) | (w[1:] != w[:-1]))
        cut = np.flatnonzero(fresh)
        open_rows = table.slice(int(cut[-1]))
        whole = table.slice(0, int(cut[-1]))
        if not whole.num_rows:
            continue
        sizes = np.diff(cut)
        whole = whole.filter(pa.array(np.repeat(sizes > 1, sizes)))  # alone in a shard: near to none there
        for part in _by_length(whole):
            if held and part["l"][0].as_py() != held[0]["l"][0].as_py() or cells > CELLS:
                if held:
                    yield from work(pa.concat_tables(held))
                held, cells = [], 0
            held.append(part)
            cells += part.num_rows * (part["l"][0].as_py() + 1)
    if open_rows is not None and open_rows.num_rows > 1:
        if held and open_rows["l"][0].as_py() != held[0]["l"][0].as_py():
            yield from work(pa.concat_tables(held))
            held = []
        held.append(open_rows)
    if held:
        yield from work(pa.concat_tables(held))


def _by_length(table: pa.Table) -> Iterator[pa.Table]:
    """Parts of one l each, and of CELLS letters at most unless one shard has more."""
    if not table.num_rows:
        return
    l, shard, w = (table[c].to_numpy() for c in ("l", "shard", "w"))
    cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (l[1:] != l[:-1]) | (w[1:] != w[:-1])))
    cells = np.cumsum(np.append(0, np.diff(np.append(cut, len(l))) * (l[cut] + 1)))
    start = 0
    for at in range(1, len(cut) + 1):
        if at == len(cut) or l[cut[at]] != l[cut[start]] or cells[at + 1] - cells[start] > CELLS:
            stop = cut[at] if at < len(cut) else len(l)
            yield table.slice(int(cut[start]), int(stop - cut[start]))
            start = at


def near_words(words: DataFrame) -> DataFrame:
    """For every word of ``words`` (word, n) that has near words: word, near (their number), form and form_n: the near word of largest n, of equals the smallest in code-point order."""
    placed = shards(words).repartition("shard").sortWithinPartitions("l", "shard", "w")
    found = placed.mapInArrow(_near, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("low"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", F.col("best.form").alias("form"), (-F.col("best.low")).alias("form_n"))


def _roots(forms: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form): counts grow by RATIO with every step, so the largest count bounds the way, which doubling halves."""
    steps = max(0, math.floor(math.log(max(largest, 1) / LEAST_COUNT, RATIO) + 1e-9)) if largest >= LEAST_COUNT else 0
    roots = forms.select("word", F.col("form").alias("root"))
    for turn in range(max(0, math.ceil(math.log2(steps)) if steps > 1 else 0)):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        roots = scratch.keep(roots.join(ahead, "root", "left").select("word", F.coalesce("top", "root").alias("root")), f"roots-{turn}")
    return roots


def groups(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, n, n_near, form, form_n, root.

    The form is the near word of largest n (ties: the smallest in code-point order) if that is RATIO times the
    word's n or more, else null. The root is where forms lead to, or the word itself. Empty and null texts have no
    words, repeated rows count as often as they stand there, very long texts and runs are whole; other columns are
    ignored, an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs.select("doc_id", "text")), "words")
    near = words.join(near_words(words), "word", "left")
    accepted: Column = F.col("form_n") >= RATIO * F.col("n")
    near = near.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(accepted, F.col("form")).alias("form"), F.when(accepted, F.col("form_n")).alias("form_n"))
    near = scratch.keep(near, "near")
    largest = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(scratch.keep(near.filter("form IS NOT NULL").select("word", "form"), "forms"), largest, scratch)
    return near.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: CRC-32 by its table, forms by words that are equal when one letter is left out, roots by following forms.
ORACLE = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS r FROM documents
), distinct_runs AS (
    SELECT k, r, count(*) AS times FROM runs WHERE length(r) >= {LEAST_LETTERS} GROUP BY 1, 2
), bytes AS (
    SELECT r, times, flatten(list_transform(string_split(k || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END)) AS b FROM distinct_runs
), hashed AS (
    SELECT r, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) AS h FROM bytes, crc
), cut AS (
    SELECT CASE WHEN h % {CUT_ONE_IN} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, times FROM hashed
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}
), less AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.rest = a.word
), best AS (
    SELECT word, count(*) AS near, max(other_n) AS top FROM pairs GROUP BY 1
), named AS (
    SELECT p.word, min(p.other) AS form FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.top GROUP BY 1
), formed AS (
    SELECT w.word, w.n, coalesce(b.near, 0) AS n_near, CASE WHEN b.top >= {RATIO} * w.n THEN m.form END AS form, CASE WHEN b.top >= {RATIO} * w.n THEN b.top END AS form_n
    FROM words w LEFT JOIN best b USING (word) LEFT JOIN named m USING (word)
), ways AS (
    SELECT word, word AS place, 0 AS step FROM formed
    UNION ALL SELECT w.word, f.form, step + 1 FROM ways w JOIN formed f ON w.place = f.word WHERE f.form IS NOT NULL
), ends AS (
    SELECT word, arg_max(place, step) AS root FROM ways GROUP BY 1
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN ends USING (word)
"""
