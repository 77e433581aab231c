"""Byte-level BPE by prefix dynamic programming.

For a piece of text, the last token of the encoding of every byte prefix is stored. It is unique: a token
``t`` that ends at a prefix is its last token exactly if the last token of the prefix before it and ``t`` stay
apart when their bytes are encoded together. So

* the encoding is read back from the last byte, jumping by token lengths;
* a piece that isn't kept for edits needs only the prefixes that a search from the longest tokens enters;
* bytes can be appended without touching what is stored;
* after an edit, prefixes before it stay, and from the first stretch as long as the longest token on which old
  and new last tokens agree, all later ones agree too.

Rank files are read by the workers from a path that is the same on all of them; they are not copied.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cartorio.llm.shared import small_batches

#: Entries of the per-process caches of pieces and of token pairs; a full cache of pairs is emptied, one of pieces keeps its newer half.
CACHE_ENTRIES, PAIR_ENTRIES = 200_000, 100_000
#: Letters above which a piece is encoded without being cached.
CACHED_LETTERS = 128


class Vocabulary:
    """Ranks of a tiktoken file and the test whether two tokens stay apart."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: Every beginning of a token, with its rank or -1: where the walk over candidates may stop.
        self.beginnings = {token[:n]: -1 for token in self.ranks for n in range(1, len(token))} | self.ranks
        self._apart: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain merging, lowest rank first, until ``least`` parts are left; used on the bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merging makes a token: itself twice for a byte, None for one that merging never makes."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = self.merged(data, 2) if len(data) > 1 else [token, token]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, give these tokens.

        Merges are taken back, the latest first, at the border of the two: they stay apart unless, on the way, the parts at the
        border would have merged earlier than the merge that is taken back.
        """
        pair = left << 32 | right
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) >= PAIR_ENTRIES:
                self._apart.clear()
            known = self._apart[pair] = self._border_holds(left, right)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        tokens, rank, halves, limit = self.tokens, self.ranks.get, self._halves, 1 << 60
        if (halves[a] if a in halves else self.halves(a)) is None or (halves[b] if b in halves else self.halves(b)) is None:
            return False
        left, right = tokens[a], tokens[b]
        while True:
            merged = rank(left + right)
            if merged is not None and merged < limit:
                return False
            # Of equal ranks the left one merges first, so the right one is taken back first.
            if len(left) > 1 and (a > b or len(right) == 1):
                limit, a = a, (halves[a] if a in halves else self.halves(a))[1]
                left = tokens[a]
            elif len(right) > 1:
                limit, b = b + 1, (halves[b] if b in halves else self.halves(b))[0]
                right = tokens[b]
            else:
                return True

    def longest_at(self, data: bytes, at: int) -> int:
        """The longest token that starts at a byte."""
        found, size, beginnings = -1, len(data), self.beginnings.get
        for stop in range(at + 1, size + 1):
            rank = beginnings(data[at:stop])
            if rank is None:
                break
            if rank >= 0:
                found = rank
        return found

    def shorter(self, token: int) -> int:
        """The longest other token that a token starts with, or -1."""
        known = self._shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self._shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return known

    def encode(self, data: bytes) -> list[int]:
        """Encoding of a whole piece, by last tokens of only those prefixes that the longest tokens lead to.

        The last token of a prefix is unique, so a prefix is entered once; from one that leads no further, the search
        goes back to the prefix before it.
        """
        entered, found, at, size = bytearray(len(data)), [], 0, len(data)
        tokens, apart, known = self.tokens, self.apart, self._apart.get
        token = self.longest_at(data, 0)
        while at < size:
            end = at + len(tokens[token])
            if not entered[end - 1]:
                fits = not found or known(found[-1] << 32 | token)
                if fits is None:
                    fits = apart(found[-1], token)
            else:
                fits = False
            if fits:
                entered[end - 1] = 1
                found.append(token)
                at = end
                token = self.longest_at(data, at)
            else:
                token = self.shorter(token)
                while token < 0:
                    token = found.pop()
                    at -= len(tokens[token])
                    token = self.shorter(token)
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class PrefixTable:
    """Last tokens of all prefixes of one piece; ``last[i]`` belongs to the prefix of ``i + 1`` bytes."""

    words: Vocabulary
    data: bytearray = field(default_factory=bytearray)
    last: list[int] = field(default_factory=list)

    def append(self, data: bytes) -> "PrefixTable":
        """Encodes further bytes; nothing stored changes."""
        start = len(self.data)
        self.data += data
        self._fill(start, len(self.data))
        return self

    def _fill(self, start: int, end: int) -> None:
        words, data, last = self.words, bytes(self.data), self.last
        ranks, apart, tokens = words.ranks, words.apart, words.tokens
        last += [-1] * (end - len(last))
        # Tokens that cross into the new bytes start at most one token before them.
        for i in range(max(0, start - words.longest + 1), end):
            before = last[i - 1] if i else None
            stop = i + 1
            while stop <= end and data[i:stop] in words.beginnings:
                token = ranks.get(data[i:stop])
                if token is not None and stop > start and last[stop - 1] < 0 and (before is None or apart(before, token)):
                    last[stop - 1] = token
                stop += 1
        assert all(t in tokens for t in last[start:end])

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replaces bytes ``start:stop``; returns how many prefixes were worked out anew."""
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        done = len(data)
        agreed = at = 0
        while at < len(tail):
            step = min(self.words.longest, len(tail) - at)
            self.append(tail[at : at + step])
            done += step
            for k in range(at, at + step):
                agreed = agreed + 1 if self.last[start + len(data) + k] == old[k] else 0
            at += step
            if agreed >= self.words.longest:
                self.data += tail[at:]
                self.last += old[at:]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the whole piece, or of its first ``end`` bytes."""
        at = len(self.last) if end is None else end
        found = []
        while at:
            found.append(self.last[at - 1])
            at -= len(self.words.tokens[found[-1]])
        return found[::-1]


class _Pieces(dict):
    """Cache from a piece of text to the bytes of its ids; a miss is looked for among older pieces, else encoded."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words = words
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.pop(piece, None)
        return self._kept(piece, packed if packed is not None else self._encoded(piece))

    def _encoded(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.words.ranks.get(data)
        ids = [whole] if whole is not None else self.words.encode(data)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _kept(self, piece: str, packed: bytes) -> bytes:
        if len(piece) <= CACHED_LETTERS:
            if len(self) >= CACHE_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Texts to ids and back: every match of ``pattern`` is encoded by itself, no special tokens."""

    def __init__(self, path: str, pattern: str):
        self.words = vocabulary(path)
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(self.words)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.tokens.__getitem__, memoryview(ids).cast("I")))

    def replace(self, text: str, ids: bytes, start: int, stop: int, new: str) -> tuple[str, bytes]:
        """Text and ids after characters ``start:stop`` became ``new``.

        Pieces are split again from the last one that ends well before the edit until a border meets an old
        border behind it; ids outside that stretch are kept. Appending is an edit at the end.
        """
        spans = [m.span() for m in self.split.finditer(text)]
        sizes = [len(self.pieces[text[a:b]]) for a, b in spans]
        # The pattern looks two characters beyond a match at most.
        head = next((i for i, (_, b) in enumerate(spans) if b + 2 >= start), len(spans))
        after = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        old = {a + shift: i for i, (a, _) in enumerate(spans) if a >= stop}
        at = spans[head][0] if head < len(spans) else spans[-1][1] if spans else 0
        middle = []
        tail = len(spans)
        for match in self.split.finditer(after, at):
            if match.start() in old and match.start() >= start + len(new):
                tail = old[match.start()]
                break
            middle.append(self.pieces[match[0]])
        kept = sum(sizes[:tail])
        return after, ids[: sum(sizes[:head])] + b"".join(middle) + ids[kept:]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of every whole text.

    A null text counts as empty: no tokens, empty ids. An empty table gives an empty one; one row out per row
    in; other columns are dropped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in small_batches(batches, text):
            ids = [own.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"]
            )

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(work, _schema(docs, keep, "n_tokens long, ids binary"))


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and ``decoded`` (binary), the bytes that the ids stand for (null ids: null)."""
    names = [c for c in encoded.columns if c != decoded]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            data = [None if i is None else own.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(data, pa.binary())], [*names, decoded])

    return encoded.select(*names).mapInArrow(work, _schema(encoded, names, f"{decoded} binary"))


def edit_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text and ids after an edit, from rows (doc_id, text, ids, start, stop, new) with character offsets.

    Offsets beyond the text mean its end. Null text, ids or new count as empty, null offsets as the end.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts, packed = [], []
            for row in batch.to_pylist():
                text = row["text"] or ""
                start = len(text) if row["start"] is None else max(0, min(len(text), row["start"]))
                stop = len(text) if row["stop"] is None else max(start, min(len(text), row["stop"]))
                a, b = own.replace(text, row["ids"] or b"", start, stop, row["new"] or "")
                texts.append(a)
                packed.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(packed, pa.binary())], ["doc_id", "text", "ids"])

    return encoded.select("doc_id", "text", "ids", "start", "stop", "new").mapInArrow(work, _schema(encoded, ["doc_id"], "text string, ids binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text).

    Encodes and decodes a row in one pass, so that ids never leave the worker. Null text: empty. Every row is worked on by
    itself: repeated rows give equal rows, no order or tie has a say. Texts are whole, however long; an empty table
    gives an empty one, other columns are dropped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in small_batches(batches, "text"):
            counts, before, after = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                before.append(hashlib.sha256(ids).hexdigest())
                after.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, _schema(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _schema(df: DataFrame, names, more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), more])
