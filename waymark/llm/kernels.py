"""Vectorised word kernels over Arrow string columns.

A record batch is worked through in pieces of half a MB of UTF-8, so a worker's
memory does not grow with the batch.  Words are found by a table of bytes; all
word classes in use keep every byte from 0x80, so code points are never cut.
Hashes are 64-bit: polynomial over the bytes of a word, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = (1 << 19) - 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[48:58] = LETTERS_DIGITS[97:123] = LETTERS_DIGITS[128:] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(count: int, base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below count."""
    if len(_powers["up"]) < count:
        size = 1 << max(16, int(count - 1).bit_length())
        for name, by in (("up", base), ("down", inverse)):
            steps = np.full(size, by, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:count], _powers["down"][:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


@dataclass
class Words:
    """Words of documents first..last-1 of a batch; positions are within ``data``."""

    first: int
    last: int
    data: np.ndarray  # lower-cased bytes
    bounds: np.ndarray  # of the documents in data
    start: np.ndarray
    end: np.ndarray
    edges: np.ndarray  # words of document i: edges[i] .. edges[i + 1]

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.data.astype(np.uint64) * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(i, j))


def words(column: pa.Array, is_word: np.ndarray, piece_bytes: int = PIECE_BYTES) -> Iterator[Words]:
    """Words of each document of a string column, a piece at a time."""
    at, data = text_buffers(column)
    first, count = 0, len(at) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(at, at[first] + piece_bytes, "right")) - 1)
        last = min(last, count)
        part = LOWER[data[at[first] : at[last]]]
        bounds = at[first : last + 1] - at[first]
        inside = is_word[part]
        # a document starts and ends a word
        begins = inside.copy()
        ends = inside.copy()
        if len(part):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = bounds[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(part))]
            begins[cuts] = inside[cuts]
            ends[cuts - 1] = inside[cuts - 1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        yield Words(first, last, part, bounds, start, end, np.searchsorted(start, bounds))
        first = last


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-aware hash of each run of ``size`` words, whichever document they are in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    by = _BASE
    for k in range(size):
        total += hashes[k : k + n] * by
        by = np.uint64(int(by) * int(_BASE) * 3 % (1 << 64) | 1)
    return mix(total)


def inside_documents(edges: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which of ``count`` windows of ``size`` words stay inside one document."""
    good = np.zeros(max(count, 0), bool)
    if count <= 0:
        return good
    good[:] = True
    for k in range(1, size):
        # windows that start fewer than size words before a document's end
        bad = edges[1:] - k
        bad = bad[(bad >= 0) & (bad < count)]
        good[bad] = False
    return good
