"""Word splitting and hashing of whole Arrow text columns with NumPy.

Texts stay the UTF-8 bytes Arrow holds them as. Every byte class used here treats bytes from 0x80 up
alike, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone. A worker's arrays take some 50 times that.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

#: Bytes of words: digits, letters and everything beyond ASCII (after A-Z are lower-cased).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words that only ASCII white space separates.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps, out=steps)
        if size > 4 * CHUNK_BYTES:
            return table
        _powers[base] = have = table
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high
    pa.default_memory_pool().release_unused()  # of the batches before


class Words:
    """The words of consecutive texts, their bytes mapped by fold: where they start and end, their hashes, each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = LOWER):
        self.data, self.offsets = data, offsets
        inside = is_word[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        after = before[1:].copy()
        before = before[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after = np.append(after[1:], False) if len(after) else after
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._lower = fold[data]

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        terms = sums[1:]  # in place, for these are eight times the text
        terms[:] = self._lower
        terms += np.uint64(1)
        terms *= _power_table(_MULTIPLIER, n)
        np.cumsum(terms, out=terms)
        return mix((sums[self.ends] - sums[self.starts]) * _power_table(_INVERSE, n + 1)[self.starts])

    def word(self, i: int) -> bytes:
        return self._lower[self.starts[i] : self.ends[i]].tobytes()

    def words(self, low: int, high: int) -> list[bytes]:
        return [self.word(i) for i in range(low, high)]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; entry i is that of words i to i+n-1."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        factor = mix(np.array([k + 1], dtype=np.uint64) * np.uint64(_MULTIPLIER))[0] | np.uint64(1)
        total += hashes[k : k + size] * factor
    return mix(total)
