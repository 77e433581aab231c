"""The nearest of many texts by edit distance, for each of a list of values: all of them in one pass over the texts.

A pair of value and text is a lane of arrays of machine words that hold a column of the distance matrix as bits
(Myers, 1999; Hyyrö, 2003), so thousands of pairs move on by a letter at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bits of a machine word, pairs compared at once, letters worked on at once, texts of a slice that are compared first.
BITS, LANES, SLICE, FIRST = 64, 4096, 1 << 20, 8
#: Most words of a table that tells, for all values and letters, where a value has a letter.
TABLE_LIMIT = 1 << 22
ONE, TOP = np.uint64(1), np.uint64(BITS - 1)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def table_words(values: Sequence[str]) -> int:
    """Size of the tables that ``Nearest`` makes of a list of values."""
    return (len(set("".join(values))) + 1) * sum(len(v) // BITS + 1 for v in values)


class Nearest:
    """For every value its nearest text so far: distance, number and text; of equally near ones that with the smallest number, null first."""

    def __init__(self, values: Sequence[str]):
        letters = [_letters(v) for v in values]
        self.alphabet = np.unique(np.concatenate([np.empty(0, np.uint32), *letters]))
        self.kinds = len(self.alphabet) + 1
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.words = np.maximum(1, -(-self.sizes // BITS))
        coded = [self._codes(v) for v in letters]
        self.counts = np.array([np.bincount(c, minlength=self.kinds) for c in coded], np.int32).reshape(len(values), self.kinds)
        #: By number of words: for every word, where value and letter are equal; values have a row each, which ``rows`` names.
        self.equal: dict[int, list[np.ndarray]] = {}
        self.rows = np.zeros(len(values), np.int64)
        for words in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == words)
            tables = [np.zeros(len(mine) * self.kinds, np.uint64) for _ in range(words)]
            for row, nth in enumerate(mine):
                self.rows[nth] = row
                for place, code in enumerate(coded[nth].tolist()):
                    tables[place // BITS][row * self.kinds + code] |= ONE << np.uint64(place % BITS)
            self.equal[words] = tables
        self.best = np.full(len(values), np.iinfo(np.int64).max)
        self.found: list[tuple | None] = [None] * len(values)

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        """Number of a letter, 0 for those that no value has."""
        if not len(self.alphabet):
            return np.zeros(len(letters), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + 1, 0)

    def distances(self, nth: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Edit distances of values, all of one number of words, and of texts that lie in ``codes``, longest first."""
        tables = self.equal[int(self.words[nth[0]])]
        score, shift = self.sizes[nth].copy(), np.maximum(self.sizes[nth] - 1, 0).astype(np.uint64) % np.uint64(BITS)
        base = self.rows[nth] * self.kinds
        plus = [np.full(len(nth), ~np.uint64(0)) for _ in tables]
        minus = [np.zeros(len(nth), np.uint64) for _ in tables]
        for column, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths[0]), "left")):
            at = base[:n] + codes[starts[:n] + column]
            up, down = ONE, np.uint64(0)
            for word, table in enumerate(tables):
                equal, above, below = table[at], plus[word][:n], minus[word][:n]
                vertical = equal | below
                equal |= down
                diagonal = (((equal & above) + above) ^ above) | equal
                rise, fall = below | ~(diagonal | above), above & diagonal
                if word == len(tables) - 1:
                    score[:n] += ((rise >> shift[:n]) & ONE).astype(np.int64) - ((fall >> shift[:n]) & ONE).astype(np.int64)
                next_up, next_down = rise >> TOP, fall >> TOP
                rise, fall = (rise << ONE) | up, (fall << ONE) | down
                plus[word][:n], minus[word][:n] = fall | ~(vertical | rise), rise & vertical
                up, down = next_up, next_down
        # A value without letters is as far as the text is long.
        return np.where(self.sizes[nth] == 0, lengths, score)

    def see(self, numbers: Sequence, texts: Sequence[str]) -> None:
        """Takes in further texts, none of them null, with their numbers."""
        part, size = 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= SLICE:
                self._see(numbers[part:end], texts[part:end])
                part, size = end, 0
        if part < len(texts):
            self._see(numbers[part:], texts[part:])

    def _see(self, numbers: Sequence, texts: Sequence[str]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        codes = self._codes(_letters("".join(texts[i] for i in order)))
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(texts)), lengths)
        counts = np.bincount(row * self.kinds + codes, minlength=len(texts) * self.kinds).reshape(-1, self.kinds).T.astype(np.int32)

        bounds = []
        for nth, size in enumerate(self.sizes):
            reach = min(int(self.best[nth]), 1 << 40)
            low, high = np.searchsorted(lengths, [size - reach, size + reach + 1])
            # Letters that the value has too many, and those that the text has: each edit makes up for one of both at most.
            over = np.maximum(self.counts[nth][:, None] - counts[:, low:high], 0).sum(axis=0)
            bounds.append((low, np.maximum(over, over + lengths[low:high] - size)))

        def compare(first: bool) -> None:
            chosen = []
            for nth, (low, bound) in enumerate(bounds):
                near = np.flatnonzero(bound <= self.best[nth])
                if first and len(near) > FIRST:
                    near = near[np.argpartition(bound[near], FIRST)[:FIRST]]
                chosen.append((np.full(len(near), nth), near + low))
            nths, ats = (np.concatenate(c) for c in zip(*chosen))
            for words in self.equal:
                mine = np.flatnonzero(self.words[nths] == words)
                mine = mine[np.argsort(-ats[mine], kind="stable")]
                for part in range(0, len(mine), LANES):
                    lanes = mine[part : part + LANES]
                    nth, at = nths[lanes], ats[lanes]
                    far = self.distances(nth, codes, starts[at], lengths[at])
                    for lane in np.flatnonzero(far <= self.best[nth]).tolist():
                        self._take(int(nth[lane]), int(far[lane]), numbers[order[at[lane]]], texts[order[at[lane]]])

        compare(True)
        compare(False)

    def _take(self, nth: int, distance: int, number, text: str) -> None:
        known = self.found[nth]
        rank = (distance, number is not None, number, text) if number is not None else (distance, False, 0, text)
        if known is None or rank < known:
            self.found[nth], self.best[nth] = rank, distance


def nearest_rows(batches: Iterator[pa.RecordBatch], values: dict[int, list[str]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (sample, nth, distance, number, closest) of the values of every sample, from batches (sample, number, text); one row a value at most."""
    seen: dict[int, Nearest] = {}
    for batch in batches:
        samples, numbers, texts = (c.to_pylist() for c in batch.columns)
        mine: dict[int, tuple[list, list]] = {}
        for sample, number, text in zip(samples, numbers, texts):
            both = mine.setdefault(sample, ([], []))
            both[0].append(number), both[1].append(text)
        for sample, both in mine.items():
            if sample not in seen:
                seen[sample] = Nearest(values[sample])
            seen[sample].see(*both)
    rows = [(sample, nth, f[0], f[2] if f[1] else None, f[3]) for sample, nearest in seen.items() for nth, f in enumerate(nearest.found) if f]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
