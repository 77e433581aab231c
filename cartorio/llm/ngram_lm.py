"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Training tokens are the words of a text, A-Z as a-z, and one end; the contexts of the first words hold begin
marks. First words are counted: the ascending hashes of a training word's file are its dictionary, a place in it
is the word's number. Then, order by order from the highest, grams of word numbers are counted, and a gram hands
on what the next lower order needs: one more left neighbour of its suffix, and the following count of its
prefix. Words and grams are dealt out by hash, so none, however common, meets in one task. Each task writes
one set of arrays: ascending 64-bit hashes and, in step with them, the counts. Files are moved to their names
when whole, and depend on their words or grams only. The hash of a gram is Spark's xxhash64 of its numbers, so
that exchanges carry the numbers alone.

Workers map the files into memory and look up whole batches of texts at once; the model is never loaded or
sent. The folder must be one that all workers mount (a ``file:`` URI or a path), as mapping needs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.llm.hashing import mix, word_hashes
from cartorio.llm.shared import free_shuffles, small_batches

_U = np.uint64
BEGIN, END = mix(np.array([0xB0, 0xE0], _U))
#: Rows that a counting task holds back to add up equal grams before the shuffle.
COMBINED = 2_000_000
#: Columns of a record: own count, and as a context the sum of following counts and how many followers have
#: count 1, 2, 3 and more. The highest order has own counts alone, of four bytes; a count that needs more stands
#: in a list of places and counts beside them.
FIELDS = ("own", "total", "n1", "n2", "n3")
MOST_WORDS = 2**31 - 1
FULL = 2**32 - 1


def local_path(folder: str) -> str:
    """The mounted path of a folder that workers are to map."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"a model is mapped into memory: {folder} is not on a mounted path, give such a folder")
    return path


def _with_ends(hashes: np.ndarray, counts: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with ``begins`` begin marks before and one end after it, and where each text starts."""
    sizes = counts + begins + 1
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), BEGIN, _U)
    words = np.arange(len(hashes)) + np.repeat(starts + begins - (np.cumsum(counts) - counts), counts)
    out[words] = hashes
    out[starts + sizes - 1] = END
    return out, starts


def _positions(counts: np.ndarray, begins: int, starts: np.ndarray) -> np.ndarray:
    """Places of predicted tokens: everything but begin marks."""
    sizes = counts + 1
    return np.arange(int(sizes.sum())) + np.repeat(starts + begins - (np.cumsum(sizes) - sizes), sizes)


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Spark's xxhash64 of integer columns (XXH64 of four bytes, each column seeded by the hash before)."""
    value = np.full(len(words[0]), 42, _U)
    with np.errstate(over="ignore"):
        for word in words:
            x = value + _U(0x27D4EB2F165667C5) + _U(4)
            x ^= word.astype(np.uint32).astype(_U) * _U(0x9E3779B185EBCA87)
            x = (x << _U(23) | x >> _U(41)) * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9)
            x = (x ^ x >> _U(33)) * _U(0xC2B2AE3D27D4EB4F)
            x = (x ^ x >> _U(29)) * _U(0x165667B19E3779F9)
            value = x ^ x >> _U(32)
    return value


def _added(g: np.ndarray, values: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of equal ``g`` as one, ascending: the first of ``values``, the total of ``sums``."""
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], [v[order][first] for v in values], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in sums]


def _alike_together(columns: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows in the order of their first ``keys`` columns: neighbours that are alike take up less in an exchange."""
    order = np.lexsort(columns[:keys][::-1])
    return [c[order] for c in columns]


def _batches(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names)


def _part(hash_column: str, parts: int) -> Column:
    """Which of ``parts`` equal ranges of an unsigned hash a row is in."""
    return F.expr(f"cast(shiftright(shiftrightunsigned({hash_column}, 40) * {parts}, 24) as int)")


def _dealt(rows: DataFrame, hash_column: str, parts: int) -> DataFrame:
    """Rows in their hash range, in unsigned order of the hash (signed order with the top bit turned)."""
    return rows.repartitionById(parts, _part(hash_column, parts)).sortWithinPartitions(F.expr(f"{hash_column} ^ {-(2**63)}L".replace("-9223372036854775808L", "shiftleft(1L, 63)")))


def _file(folder: str, kind: str, part: int) -> str:
    return f"{folder}/{kind}-{part:05d}"


class _Files:
    """Arrays of one task, under temporary names until they are whole."""

    def __init__(self, folder: str, kind: str, arrays: tuple[str, ...]):
        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        self.name = _file(folder, kind, context.partitionId())
        self.temp = f"{self.name}.{context.taskAttemptId()}.tmp"
        self.open = {a: open(f"{self.temp}.{a}", "wb") for a in arrays}

    def add(self, **arrays: np.ndarray) -> None:
        for name, values in arrays.items():
            self.open[name].write(values.tobytes())

    def done(self, head: np.ndarray) -> None:
        for stream in self.open.values():
            stream.close()
        head.tofile(f"{self.temp}.head")
        for name in (*self.open, "head"):
            os.replace(f"{self.temp}.{name}", f"{self.name}.{name}")


def _runs(batches: Iterator[pa.RecordBatch], work) -> Iterator:
    """Calls ``work`` with the columns of ascending rows; the last row of a call goes on to the next one, where it may have an equal."""
    held = None
    for batch in batches:
        if batch.num_rows:
            columns = [c.to_numpy() for c in batch.columns]
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns)] if held else columns
            held = yield from work(columns, False)
    if held:
        yield from work(held, True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [np.array([BEGIN])], 0
    counts_held = [np.zeros(1, np.int64)]

    def flush():
        g, _, (n,) = _added(np.concatenate(held), [], [np.concatenate(counts_held)])
        yield from _batches([g.view(np.int64), n], ["h", "n"])

    for batch in small_batches(batches, "text"):
        hashes, counts = word_hashes(batch.column("text"))
        held += [hashes, np.array([END])]
        counts_held += [np.ones(len(hashes), np.int64), np.array([len(counts)])]
        rows += len(hashes)
        if rows >= COMBINED:
            yield from flush()
            held, counts_held, rows = [], [], 0
    if held:
        yield from flush()


def _write_words(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, head = _Files(folder, "words", ("hash", "raw")), np.zeros(3, np.int64)

        def step(columns, last):
            g, _, (n,) = _added(columns[0].view(_U), [], [columns[1]])
            stop = len(g) if last else len(g) - 1
            files.add(hash=g[:stop], raw=n[:stop])
            head[:] += [stop, int(n[:stop].sum()), int((n[:stop] > 0).sum())]
            return None if last else [g[stop:].view(np.int64), n[stop:]]
            yield

        yield from _runs(batches, step)
        files.done(head)

    return work


@dataclass(frozen=True)
class Words:
    """The dictionary: where its files are and at which number each begins. Small, so tasks carry it."""

    folder: str
    begins: tuple[int, ...]
    tokens: int
    distinct: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones."""
        asked, back = np.unique(hashes, return_inverse=True)
        found = np.full(len(asked), -1, np.int64)
        for part, low, high in _cuts(asked, len(self.begins)):
            known = _mapped(self.folder, "words", "hash", part, "uint64")
            if len(known):
                at = np.minimum(np.searchsorted(known, asked[low:high]), len(known) - 1)
                found[low:high] = np.where(known[at] == asked[low:high], at + self.begins[part], -1)
        return found[back].astype(np.int32)


def _cuts(asked: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    where = ((asked >> _U(40)) * _U(parts)) >> _U(24)
    cuts = np.searchsorted(where, np.arange(parts + 1, dtype=_U))
    return ((p, int(cuts[p]), int(cuts[p + 1])) for p in range(parts) if cuts[p] < cuts[p + 1])


@lru_cache(maxsize=8192)
def _mapped(folder: str, kind: str, array: str, part: int, dtype: str) -> np.ndarray:
    name = f"{_file(folder, kind, part)}.{array}"
    return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)


def _count_grams(words: Words, order: int):
    names = [f"w{i}" for i in range(1, order + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush():
            keys = [np.concatenate(k) for k in zip(*held)]
            _, keys, (n,) = _added(gram_hash(keys), keys, [np.ones(len(keys[0]), np.int64)])
            yield from _batches(_alike_together([*keys, n], order), [*names, "n"])

        for batch in small_batches(batches, "text", 3 << 20):
            hashes, counts = word_hashes(batch.column("text"))
            tokens, starts = _with_ends(hashes, counts, order - 1)
            tokens, at = words.numbers(tokens), _positions(counts, order - 1, starts)
            held.append([tokens[at - order + 1 + i] for i in range(order)])
            rows += len(at)
            if rows >= COMBINED:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return work


def _names(order: int) -> list[str]:
    return [f"w{i}" for i in range(1, order + 1)] + list(FIELDS)


def _schema(order: int) -> str:
    return ", ".join([*(f"w{i} int" for i in range(1, order + 1)), *(f"{f} long" for f in FIELDS)])


def _hash_sql(order: int) -> str:
    return f"xxhash64({', '.join(f'w{i}' for i in range(1, order + 1))})"


def _write_level(folder: str, order: int, top: bool, begin: int, full: int):
    """Rows of one hash range, in order of the gram hash, to arrays and to rows of the next lower order. Rows are w1..wn and, at the top, n, else FIELDS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, seen, place = _Files(folder, f"order{order}", ("hash", "data", "over")), np.zeros(6, np.int64), 0
        lower: list[list[np.ndarray]] = []

        def hand_on(keys, own):
            """What grams give to their suffixes and prefixes."""
            real = own > 0
            keys, own = [k[real] for k in keys], own[real]
            # A suffix that begins with a begin mark has no other left neighbours: it keeps the count itself.
            left, zero = np.where(keys[1] == begin, own, 1), np.zeros(len(own), np.int64)
            words = [np.concatenate([a, b]) for a, b in zip(keys[1:], keys[:-1])]
            sums = [np.concatenate([a, b]).astype(np.int64) for a, b in ((left, zero), (zero, own), (zero, own == 1), (zero, own == 2), (zero, own >= 3))]
            _, words, sums = _added(gram_hash(words), words, sums)
            lower.append([*words, *sums])

        def flush():
            columns = [np.concatenate(c) for c in zip(*lower)]
            lower.clear()
            _, words, sums = _added(gram_hash(columns[: order - 1]), columns[: order - 1], columns[order - 1 :])
            yield from _batches(_alike_together([*words, *sums], order - 1), _names(order - 1))

        def step(columns, last):
            nonlocal place
            keys, sums = columns[:order], columns[order:]
            g, keys, sums = _added(gram_hash(keys), keys, sums)
            stop = len(g) if last else len(g) - 1
            own = sums[0][:stop]
            if top:
                large = np.flatnonzero(own >= full)
                files.add(data=np.minimum(own, full).astype(np.uint32), over=np.stack([large + place, own[large]], axis=1))
            else:
                files.add(data=np.stack([v[:stop] for v in sums], axis=1))
            files.add(hash=g[:stop])
            place += stop
            seen[:] += [*(int((own == k).sum()) for k in (1, 2, 3, 4)), int(own.sum()), int((own > 0).sum())]
            if stop:
                hand_on([k[:stop] for k in keys], own)
            if lower and sum(len(c[0]) for c in lower) >= COMBINED:
                yield from flush()
            return None if last else [v[stop:] for v in [*keys, *sums]]

        yield from _runs(batches, step)
        if lower:
            yield from flush()
        files.done(seen)

    return work


def _write_first(words: Words):
    """Rows (w1, FIELDS or n) of one dictionary file, to an array in step with it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files = _Files(words.folder, "order1", ("data",))
        data = np.zeros((len(_mapped(words.folder, "words", "hash", part, "uint64")), len(FIELDS)), np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy() - words.begins[part]
            for i, column in enumerate(batch.columns[1:]):
                np.add.at(data[:, i], at, column.to_numpy())
        files.add(data=data)
        own = data[:, 0]
        files.done(np.array([*(int((own == k).sum()) for k in (1, 2, 3, 4)), int(own.sum()), int((own > 0).sum())], np.int64))
        return iter(())
        yield

    return work


@dataclass(frozen=True)
class Model:
    """Where the files of a model are, and what holds for all of it. Small, so tasks carry it."""

    words: Words
    order: int
    #: By order from 1: discounts for counts 1, 2, 3 and more.
    discounts: tuple[tuple[float, float, float], ...]
    #: Sum of own counts of order 1 and how many words have own count 1, 2, 3 and more.
    unigrams: tuple[int, int, int, int]
    #: Four-byte value that stands for counts of its size and more.
    full: int = FULL

    @property
    def tokens(self) -> int:
        return self.words.tokens


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's closed form; where counts of counts are missing, the nearest sensible value."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    by_count = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(by_count, (1, 2, 3)))


def train(texts: DataFrame, folder: str, order: int = 2, parts: int | None = None, full: int = FULL) -> Model:
    """Counts ``texts`` (text) and writes the model below ``folder``.

    Null text: an end only. Repeated rows count as often as they stand there. No rows: an empty model, under
    which every token is unknown and scores as one of a single kind.
    """
    if order < 2:
        raise ValueError("an order of 2 at least: single words are what order 1 of any model is")
    path = local_path(folder)
    parts = parts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select("text")
    counted = _dealt(texts.mapInArrow(_count_words, "h long, n long"), "h", parts)
    counted = counted.mapInArrow(_write_words(path), "h long, n long")
    counted.write.format("noop").mode("overwrite").save()
    free_shuffles(texts.sparkSession)
    heads = [np.fromfile(f"{_file(path, 'words', p)}.head", np.int64).tolist() for p in range(parts)]
    if sum(h[0] for h in heads) > MOST_WORDS:
        raise ValueError("more distinct words than numbers for them")
    words = Words(path, tuple(int(x) for x in np.cumsum([0, *(h[0] for h in heads)])[:-1]), sum(h[1] for h in heads), sum(h[2] for h in heads))
    if not words.tokens:
        return Model(words, order, ((0.0, 0.0, 0.0),) * order, (0, 0, 0, 0))
    begin = int(words.numbers(np.array([BEGIN]))[0])

    gram = ", ".join(f"w{i} int" for i in range(1, order + 1)) + ", n long"
    rows = texts.mapInArrow(_count_grams(words, order), gram)
    for level in range(order, 1, -1):
        rows = _dealt(rows, _hash_sql(level), parts).mapInArrow(_write_level(path, level, level == order, begin, full), _schema(level - 1))
    edges = F.array(*[F.lit(b) for b in words.begins])
    own_file = F.size(F.filter(edges, lambda b: b <= F.col("w1"))) - 1
    # Files of equal begin are empty but for the last of them, which is the one counted to.
    rows.repartitionById(parts, own_file.cast("int")).mapInArrow(_write_first(words), "w1 int").write.format("noop").mode("overwrite").save()
    heads = [np.sum([np.fromfile(f"{_file(path, f'order{k}', p)}.head", np.int64) for p in range(parts)], axis=0).tolist() for k in range(1, order + 1)]
    n1, n2, _, _, own, kinds = heads[0]
    return Model(words, order, tuple(discounts(*h[:4]) for h in heads), (own, n1, n2, kinds - n1 - n2), full)


def lookup(model: Model, order: int, grams: np.ndarray) -> np.ndarray:
    """Records of grams of two words or more, zeros where there is none: rows of FIELDS, or for the highest order own counts."""
    folder, top = model.words.folder, order == model.order
    asked, back = np.unique(grams, return_inverse=True)
    found = np.zeros(len(asked) if top else (len(asked), len(FIELDS)), np.int64)
    for part, low, high in _cuts(asked, len(model.words.begins)):
        hashes = _mapped(folder, f"order{order}", "hash", part, "uint64")
        if len(hashes):
            data = _mapped(folder, f"order{order}", "data", part, "uint32" if top else "int64")
            at = np.minimum(np.searchsorted(hashes, asked[low:high]), len(hashes) - 1)
            hit = hashes[at] == asked[low:high]
            records = (data if top else data.reshape(-1, len(FIELDS)))[at[hit]].astype(np.int64)
            if top and (large := records == model.full).any():
                over = _mapped(folder, f"order{order}", "over", part, "int64").reshape(-1, 2)
                records[large] = over[np.searchsorted(over[:, 0], at[hit][large]), 1]
            found[low:high][hit] = records
    return found[back]


def word_records(model: Model, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and FIELDS of words by number; zeros for unknown ones."""
    words = model.words
    asked, back = np.unique(numbers, return_inverse=True)
    raw, data = np.zeros(len(asked), np.int64), np.zeros((len(asked), len(FIELDS)), np.int64)
    cuts = np.searchsorted(asked, [*words.begins, MOST_WORDS])
    for part, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if low < high:
            at = asked[low:high] - words.begins[part]
            raw[low:high] = _mapped(words.folder, "words", "raw", part, "int64")[at]
            data[low:high] = _mapped(words.folder, "order1", "data", part, "int64").reshape(-1, len(FIELDS))[at]
    return raw[back], data[back]


def probabilities(model: Model, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probability of the word numbers at places ``at``, and their training counts."""
    if not model.tokens:
        return np.ones(len(at)), np.zeros(len(at), np.int64)
    raw, first = word_records(model, tokens)
    own, total = first[at, 0], model.unigrams[0]
    kept = np.concatenate([[0.0], model.discounts[0]])
    # Order 1 is interpolated with the uniform distribution over the known tokens and one unknown.
    spare = sum(d * n for d, n in zip(model.discounts[0], model.unigrams[1:]))
    p = (np.maximum(own - kept[np.minimum(own, 3)], 0) + spare / (model.words.distinct + 1)) / total
    for k in range(2, model.order + 1):
        words = [tokens[at - k + 1 + i] for i in range(k)]
        context = lookup(model, k - 1, gram_hash(words[:-1])) if k > 2 else first[at - 1]
        count = lookup(model, k, gram_hash(words))
        count = count if k == model.order else count[:, 0]
        d = np.concatenate([[0.0], model.discounts[k - 1]])
        seen = context[:, 1]
        back_off = context[:, 2:5] @ np.array(model.discounts[k - 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen > 0, (np.maximum(count - d[np.minimum(count, 3)], 0) + back_off * p) / seen, p)
    return p, raw[at]


SCORES = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens (words and the end), n_known, base_score (smoothed single tokens), score and perplexity.

    Scores are log10 probabilities of the whole text. Null and empty texts: the end alone. One row out per row in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 3 << 20):
            hashes, counts = word_hashes(batch.column("text"))
            begins = max(1, model.order - 1)
            tokens, starts = _with_ends(hashes, counts, begins)
            tokens, at = model.words.numbers(tokens), _positions(counts, begins, starts)
            p, known = probabilities(model, tokens, at)
            sizes = counts + 1
            first = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10((known + 0.5) / (model.tokens + 0.5 * (model.words.distinct + 1))), first)
            score = np.add.reduceat(np.log10(p), first)
            values = [sizes, np.add.reduceat((known > 0).astype(np.int64), first), base, score, 10 ** (-score / sizes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, t) for v, (_, t) in zip(values, SCORES))], [*keep, *(n for n, _ in SCORES)])

    kinds = {pa.int64(): "long", pa.float64(): "double"}
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} {kinds[t]}" for n, t in SCORES)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(work, schema)


def held_out(key: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a row is kept from training: remainder of the CRC-32 of its id's text."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold, F.lit(False))
