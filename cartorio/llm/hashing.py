"""Words and word shingles of whole texts as 64-bit hashes, computed on the byte buffers of Arrow batches.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return;
A-Z count as a-z. Hashes are the same in every process. Two words of one comparison share a hash with a
probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cartorio.llm.shared import text_offsets

SHINGLE_WORDS = 5
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FILLED = np.ones(256, bool)
_FILLED[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _ODD[0])


#: Letters, digits and what is not ASCII; with these, marks and comment signs part words.
LETTERS = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def word_hashes(texts: pa.Array, parts: np.ndarray = _FILLED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text (null: none). ``parts`` says which bytes words are made of."""
    counts = np.zeros(len(texts), np.int64)
    offsets = text_offsets(texts)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, _U), counts
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    filled = parts[data]
    if texts.null_count:
        for row in np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False)):
            filled[offsets[row] : offsets[row + 1]] = False
    before = np.empty_like(filled)
    before[0] = False
    before[1:] = filled[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    first = filled & ~before
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, _U), counts
    places = np.flatnonzero(filled)
    begins = np.flatnonzero(first[places])
    lengths = np.diff(np.append(begins, len(places)))
    depth = np.arange(len(places)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        parts = mix(_BYTES[data[places]] + depth.astype(_U) * _ODD[1])
        hashes = mix(np.add.reduceat(parts, begins) + lengths.astype(_U) * _ODD[2])
    counts[:] = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Per text its distinct shingles in ascending order; a shorter text is one shingle, a text without words none."""
    sets = []
    end = 0
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(words, _U)])
        rolled = np.zeros(len(hashes), _U)
        for j in range(words):
            rolled += padded[j : j + len(hashes)] * _ODD[j % 5] + _U(j)
        rolled = mix(rolled)
        for count in counts.tolist():
            start, end = end, end + count
            if count >= words:
                sets.append(np.unique(rolled[start : end - words + 1]))
            elif count:
                short = hashes[start:end] * _ODD[:count]
                sets.append(mix(short.sum(dtype=_U, keepdims=True) + _U(count) * _ODD[4]))
            else:
                sets.append(np.zeros(0, _U))
    return sets
