"""License scans: templates found in texts by MinHash bands over overlapping windows, verified by containment.

Words are runs of letters and digits, A-Z as a-z, so marks and comment signs don't matter; a template is the
set of its 5-word shingles; one of n < 5 words is its n-word shingle, looked for among the n-word shingles of texts.
Templates of about one length (within a quarter) share windows: a
quarter longer than the longest of them, starting every quarter of that. A whole or nearly whole template then
lies in one window, with a Jaccard similarity that a bound follows for; the number of bands makes a miss less
likely than ``MISS``. A window whose bands meet a template's is verified: at least ``CONTAINED`` percent of the
template's shingles must be in it.

Windows without any shingle of the templates can't share a minimum with them and are passed over, so the work on
texts without licences is one look-up a shingle.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.llm.hashing import LETTERS, SHINGLE_WORDS, mix, word_hashes
from cartorio.llm.license_texts import NOTICES, SHORT_NOTICES
from cartorio.llm.shared import small_batches

CONTAINED = 75
ROWS = 2
MISS = 1e-9
#: Templates that go out with tasks at once; more are scanned for group by group.
GROUP = 2000
_U = np.uint64
_ODD = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=_U)) | _U(1)


def shingles_in_order(hashes: np.ndarray, counts: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``words`` words of all texts in order of place, and how many each has; a shorter text has none."""
    out, sizes = [], []
    end = 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), _U)
        padded = np.concatenate([hashes, np.zeros(words, _U)])
        for j in range(words):
            rolled += padded[j : j + len(hashes)] * _ODD[j]
        rolled = mix(rolled)
        for count in counts.tolist():
            start, end = end, end + count
            out.append(rolled[start : max(start, end - words + 1)])
            sizes.append(len(out[-1]))
    return np.concatenate(out) if out else rolled, np.array(sizes, np.int64)


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` hashes with which sets of that similarity fail to meet with a probability of ``miss`` at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity**rows))


class Shelf:
    """Templates of about one length: their windows, bands and shingles of ``words`` words."""

    def __init__(self, longest: int, templates: list[tuple[int, np.ndarray]], words: int = SHINGLE_WORDS):
        self.words = words
        self.step = max(1, longest // 4)
        self.window = longest + self.step - 1
        self.sets = dict(templates)
        least = min(len(s) for s in self.sets.values())
        inside = math.ceil(least * CONTAINED / 100)
        self.bands = bands_for(inside / (self.window + least - inside))
        self.seeds = mix(np.arange(self.bands * ROWS, dtype=_U) + _U(0x51CE))
        self.shingles = np.unique(np.concatenate(list(self.sets.values())))
        self.index: dict[int, list[int]] = defaultdict(list)
        for name, tokens in self.sets.items():
            for key in self.keys(tokens):
                self.index[key].append(name)

    def keys(self, tokens: np.ndarray) -> list[int]:
        """Band keys of a set."""
        lows = np.concatenate([mix(tokens[None, :] ^ part[:, None]).min(axis=1) for part in np.array_split(self.seeds, max(1, self.bands * ROWS * len(tokens) >> 16))])
        keys = lows.reshape(self.bands, ROWS)
        with np.errstate(over="ignore"):
            return mix(keys[:, 0] * _ODD[1] + keys[:, 1] * _ODD[2] + np.arange(self.bands, dtype=_U)).tolist()

    def scan(self, tokens: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, start, shared) of every window of a text that holds a template."""
        at = np.minimum(np.searchsorted(self.shingles, tokens), len(self.shingles) - 1)
        hits = np.flatnonzero(self.shingles[at] == tokens)
        if len(hits) == 0:
            return
        first = np.maximum(0, (hits - self.window) // self.step + 1)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), (hits // self.step).tolist())])) * self.step
        for start in starts.tolist():
            inside = np.unique(tokens[start : start + self.window])
            for name in {n for key in self.keys(inside) for n in self.index.get(key, ())}:
                template = self.sets[name]
                shared = int(np.isin(template, inside, assume_unique=True).sum())
                if 100 * shared >= CONTAINED * len(template):
                    yield name, start, shared


def shelves(templates: Sequence[str]) -> list[Shelf]:
    """Templates by words of a shingle and by length; those without words are left out. Names are places in ``templates``."""
    hashes, counts = word_hashes(pa.array(list(templates), pa.string()), LETTERS)
    found = []
    for words in range(SHINGLE_WORDS, 0, -1):
        tokens, sizes = shingles_in_order(hashes, counts, words)
        own = counts >= words if words == SHINGLE_WORDS else counts == words
        sets = sorted(((len(s), i, np.unique(s)) for i, s in enumerate(np.split(tokens, np.cumsum(sizes)[:-1])) if own[i]), key=lambda x: -x[0]) if len(sizes) else []
        held, longest = [], 0
        for length, name, values in sets:
            if held and 5 * length < 4 * longest:
                found.append(Shelf(longest, held, words))
                held = []
            if not held:
                longest = length
            held.append((name, values))
        if held:
            found.append(Shelf(longest, held, words))
    return found


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES + SHORT_NOTICES) -> DataFrame:
    """Matches (doc_id, template, license, start, words, shared, of) in every whole text of ``docs`` (doc_id, text).

    Neighbouring windows with one template are one match, that of the best window; ``start`` counts its words
    from 0, ``words`` is the length of the window, ``shared`` of ``of`` shingles were found. A template of under five
    words is found where all its words stand in a row, in texts of any length. Null and empty
    texts have no matches; repeated rows repeat theirs; ties go to the first window. Empty tables, or no templates, give an empty table.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template int, start long, words long, shared long, of long"
    names = ["template", "start", "words", "shared", "of"]

    def scanner(offset: int, texts: list[str]):
        built: list[Shelf] = []

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built[:] = built or shelves(texts)
            for batch in small_batches(batches, "text"):
                hashes, counts = word_hashes(batch.column("text"), LETTERS)
                rows, values = [], []
                for words, alike in groupby(built, lambda shelf: shelf.words):
                    alike, end = list(alike), 0
                    tokens, sizes = shingles_in_order(hashes, counts, words)
                    for row, size in enumerate(sizes.tolist()):
                        own, end = tokens[end : end + size], end + size
                        for shelf in alike:
                            runs: dict[int, list[int]] = {}
                            found = []
                            for name, start, shared in sorted(shelf.scan(own)):
                                run = runs.get(name)
                                if run and start - run[2] <= shelf.window:
                                    run[2] = start
                                    if shared > run[1]:
                                        run[0], run[1] = start, shared
                                    continue
                                if run:
                                    found.append((name, run))
                                runs[name] = [start, shared, start]
                            found += runs.items()
                            rows += [row] * len(found)
                            values += [(offset + name, run[0], min(shelf.window, size - run[0]) + words - 1, run[1], len(shelf.sets[name])) for name, run in found]
                if rows:
                    columns = [pa.array(v, pa.int32() if n == "template" else pa.int64()) for n, v in zip(names, zip(*values))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int32())), *columns], ["doc_id", *names])

        return work

    found = None
    texts = docs.select("doc_id", "text")
    for offset in range(0, max(1, len(templates)), GROUP):
        part = texts.mapInArrow(scanner(offset, [t for _, t in templates[offset : offset + GROUP]]), schema)
        found = part if found is None else found.unionByName(part)
    labels = F.array(*[F.lit(name) for name, _ in templates]) if templates else F.array().cast("array<string>")
    return found.select("doc_id", "template", F.get(labels, F.col("template")).alias("license"), "start", "words", "shared", "of")


def by_document(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, n_matches and licenses (names in order, comma between) of every id in ``docs``, those without matches too."""
    one = matches.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("l"))
    joined = docs.select("doc_id").distinct().join(one, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("l", F.lit("")).alias("licenses"))
