"""Which of a list of short strings stand in a text, and where: all of them in one pass over the text.

Windows of a text are hashed as numbers, a batch at a time, so a text is never spelled out as one row a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import catalogue_rows

#: Most strings that are handed to tasks; callers have a join for more.
PIECES_LIMIT = 100_000
#: Letters of the beginning of a string by which it is looked for, where the whole is compared later.
BEGINNING = 16
#: Letters worked on at once.
SLICE = 1 << 20
FOUND = pa.struct([("piece", pa.string()), ("place", pa.int32())])


def piece_list(df: DataFrame, column: str) -> list[str] | None:
    """Distinct values of a column, or None when there are more than fit in a task."""
    rows = catalogue_rows(df.filter(F.col(column) != "").select(column).distinct(), PIECES_LIMIT)
    return None if rows is None else [r[0] for r in rows]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PieceTable:
    """Strings by length, each length as sorted hashes behind a table of bits."""

    def __init__(self, pieces: Sequence[str]):
        sizes: dict[int, list[str]] = {}
        for piece in sorted(set(pieces)):
            sizes.setdefault(len(piece), []).append(piece)
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        # Equal hashes of two pieces would hide one of them; another factor sets them apart.
        while not all(self._build(size, listed) for size, listed in sizes.items()):
            self.factor += np.uint64(0x632BE59BD9B4E01A)
        self.tables = {size: self.built[size] for size in sorted(sizes)} if sizes else {}

    def _build(self, size: int, listed: list[str]) -> bool:
        if not hasattr(self, "built"):
            self.built = {}
        hashes = np.array([next(self._windows(_letters(p), [size]))[1][0] for p in listed], np.uint64)
        order = np.argsort(hashes)
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        self.built[size] = (hashes[order], bits, np.array(listed, object)[order])
        return len(np.unique(hashes)) == len(listed)

    def _windows(self, letters: np.ndarray, sizes: Sequence[int]):
        """(size, hashes of all windows of it), from one size on to the next."""
        out, done = np.zeros(len(letters), np.uint64), 0
        for size in sorted(sizes):
            count = max(len(letters) - size + 1, 0)
            out = out[:count]
            for n in range(done, size):
                out = (out + letters[n : n + count] + np.uint64(1)) * self.factor
            done = size
            yield size, out ^ (out << np.uint64(32))

    def find(self, texts: list[str | None], places: bool) -> pa.Array:
        """list<struct<piece, place>> of each text, places from 1; without ``places`` every piece once, at its first place."""
        ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
        letters = _letters("".join(t or "" for t in texts))
        rows, names, spots = [np.empty(0, np.int64)], [np.empty(0, object)], [np.empty(0, np.int64)]
        for size, windows in self._windows(letters, list(self.tables)):
            hashes, bits, listed = self.tables[size]
            at = np.flatnonzero(bits[windows >> np.uint64(44)])
            nth = np.minimum(np.searchsorted(hashes, windows[at]), len(hashes) - 1)
            same = hashes[nth] == windows[at]
            at, nth = at[same], nth[same]
            row = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[row]
            at, nth, row = at[inside], nth[inside], row[inside]
            if not places:
                _, first = np.unique(row * len(listed) + nth, return_index=True)
                at, nth, row = at[first], nth[first], row[first]
            rows.append(row), names.append(listed[nth]), spots.append(at - np.concatenate(([0], ends[:-1]))[row] + 1)
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(names)[order], pa.string()), pa.array(np.concatenate(spots)[order], pa.int32())], fields=list(FOUND))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def found_in(table: PieceTable, texts: Sequence[str | None], places: bool) -> pa.Array:
    """``PieceTable.find`` of many texts, about a slice of letters at once."""
    every, part, size = [], [], 0
    for value in texts:
        part.append(value)
        size += len(value or "")
        if size >= SLICE:
            every.append(table.find(part, places))
            part, size = [], 0
    every.append(table.find(part, places))
    return pa.concat_arrays(every)


def pieces_in(text: Column, pieces: Sequence[str], places: bool = False) -> Column:
    """array<struct<piece, place>> of the given strings in a text; equal hashes may give a piece that isn't there, so compare in the end."""
    listed, cache = list(pieces), []

    def find(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(PieceTable(listed))
        return found_in(cache[0], texts.to_pylist(), places)

    # Not deterministic: else it would be merged into conditions behind it, and run twice.
    return F.arrow_udf(find, "array<struct<piece:string,place:int>>").asNondeterministic()(text)
