"""Approximate substring search: smallest edit distance of a pattern to any part of a text.

A pattern may differ by ``min(3, length // 8)`` edits. With a budget of k edits one of k + 1 pieces of
the pattern must occur unchanged, so all pieces of all patterns are looked for in one pass over the
text, and only the surroundings of a hit are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cartorio.functions.pieces import PieceTable, found_in

# Shortest pattern searched inside words, letters per allowed edit, most edits.
SUBSTRING_LENGTH = 8
LETTERS_PER_EDIT = 8
MAX_EDITS = 3


def budget(pattern: str) -> int:
    return min(MAX_EDITS, len(pattern) // LETTERS_PER_EDIT)


def pieces(pattern: str, count: int) -> list[tuple[int, str]]:
    """The pattern cut in ``count`` consecutive parts, with their offsets."""
    cuts = [len(pattern) * i // count for i in range(count + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(pattern: str, text: str) -> int:
    """Bit-parallel edit distance of the pattern to the best part of the text (Myers, 1999)."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for position, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | 1 << position
    last, full = 1 << (size - 1), (1 << size) - 1
    plus, minus, score, best = full, 0, size, size
    for letter in text:
        equal = masks.get(letter, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        best = min(best, score)
    return best


def _side_fits(side: str, text: str, at: int, allowed: int) -> bool:
    """Whether what stands beside an unchanged piece can be in the text at ``at``: one of its parts is there, at most ``allowed`` places away."""
    parts = allowed + 1
    if len(side) < parts:
        return True
    for part in range(parts):
        low, high = len(side) * part // parts, len(side) * (part + 1) // parts
        if side[low:high] in text[max(0, at + low - allowed) : max(0, at + high + allowed)]:
            return True
    return False


class PatternIndex:
    """All pieces of a pattern list behind one multi-pattern scan."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)
        self.owners: dict[str, list[tuple[int, int]]] = {}
        for number, pattern in enumerate(self.patterns):
            for offset, piece in pieces(pattern, budget(pattern) + 1):
                self.owners.setdefault(piece, []).append((number, offset))
        try:
            import ahocorasick

            self.scanner = ahocorasick.Automaton()
            for piece in self.owners:
                self.scanner.add_word(piece, piece)
            if self.owners:
                self.scanner.make_automaton()
        except ImportError:
            self.scanner = None

    def hits(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, piece) of every occurrence of every piece."""
        if not self.owners:
            return
        if self.scanner is not None:
            for end, piece in self.scanner.iter(text):
                yield end - len(piece) + 1, piece
            return
        for piece in self.owners:
            start = text.find(piece)
            while start >= 0:
                yield start, piece
                start = text.find(piece, start + 1)

    def search(self, text: str, hits: Iterable[tuple[int, str]] | None = None) -> dict[int, int]:
        """Pattern number -> fewest edits, for the patterns within their budget; ``hits`` are the pieces in the text, where these are known."""
        found = {} if hits is not None else {n: 0 for n, p in enumerate(self.patterns) if p in text}
        tried: set[tuple[int, int]] = set()
        for start, piece in self.hits(text) if hits is None else hits:
            for number, offset in self.owners[piece]:
                place = (number, start - offset)
                if found.get(number) == 0 or place in tried:
                    continue
                pattern = self.patterns[number]
                allowed = budget(pattern)
                end = offset + len(piece)
                if not _side_fits(pattern[end:], text, start + len(piece), allowed) or not _side_fits(pattern[:offset], text, start - offset, allowed):
                    continue
                tried.add(place)
                low = max(0, start - offset - allowed)
                edits = best_distance(pattern, text[low : start - offset + len(pattern) + allowed])
                if edits <= allowed and edits < found.get(number, allowed + 1):
                    found[number] = edits
        return found


def search_patterns(compact: Column, patterns: Sequence[str]) -> Column:
    """map<pattern number, edits> of the patterns found in a compact text column."""
    listed = list(patterns)

    @F.pandas_udf("map<int,int>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PatternIndex(listed)
        for texts in batches:
            yield pd.Series([{} if t is None else index.search(t) for t in texts], dtype="object")

    return scan(compact)


#: Letters of a piece by which it is looked for in one pass; the rest is compared where they stand.
HEAD = 8
WITHIN = pa.list_(pa.struct([("pattern", pa.string()), ("edits", pa.int32())]))


def patterns_within(compact: Column, patterns: Sequence[str]) -> Column:
    """array<struct<pattern, edits>> of the patterns that are in a compact text within their budget: all of them in one pass over the text."""
    listed, cache = list(patterns), []

    def find(texts: pa.Array) -> pa.Array:
        if not cache:
            index, heads = PatternIndex(listed), {}
            for piece in index.owners:
                heads.setdefault(piece[:HEAD], []).append(piece)
            cache.append((index, heads, PieceTable(list(heads))))
        index, heads, table = cache[0]
        values, every = texts.to_pylist(), []
        for text, found in zip(values, found_in(table, values, True).to_pylist()):
            hits = ((f["place"] - 1, piece) for f in found for piece in heads[f["piece"]] if text.startswith(piece, f["place"] - 1))
            every.append([{"pattern": listed[n], "edits": edits} for n, edits in index.search(text or "", hits).items()])
        return pa.array(every, WITHIN)

    return F.arrow_udf(find, "array<struct<pattern:string,edits:int>>").asNondeterministic()(compact)


def edits_within(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Fewest edits of a pattern in a text, both already compact; null when over the budget."""
    found = [None if t is None or p is None or len(p) < SUBSTRING_LENGTH else PatternIndex([p]).search(t).get(0) for t, p in zip(text, pattern)]
    return pd.Series(found, dtype="Int32")


def register_sql(spark, name: str = "approximate_edits"):
    """Makes ``name(compact_text, compact_pattern)`` callable from SQL."""
    function = F.pandas_udf(edits_within, "int")
    spark.udf.register(name, function)
    return function
