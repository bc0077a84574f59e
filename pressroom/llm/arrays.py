"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

Texts are handled in slices of about ``SLICE`` bytes (a longer text is a slice of its own), so the
memory of a task does not depend on the size of its partition. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SEED = np.random.default_rng(20240229)
_BYTES = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: Bytes of words: anything but space and tab to carriage return; or letters, digits and all beyond ASCII.
PLAIN = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (self._table(b, self.n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = [_Powers(b) for b in _BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any run of values in constant time, from sums of value times power."""

    def __init__(self, values: np.ndarray, which: int = 1):
        self.n = len(values)
        up, self.down = _POWERS[which].upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * up[:self.n], out=self.sums[1:])

    def span(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def windows(self, length: int) -> np.ndarray:
        m = max(0, self.n - length + 1)
        return (self.sums[length:] - self.sums[:m]) * self.down[:m] if m else np.zeros(0, np.uint64)


@dataclass
class Words:
    """Words of a slice of texts: byte ranges in ``data``; text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def last(self) -> np.ndarray:
        """For each word, the index one past the last word of its text."""
        return np.repeat(self.first[1:], self.counts())

    def hashes(self) -> np.ndarray:
        h = Rolling(_BYTES[self.data], 0).span(self.start, self.end - self.start)
        return mix(h + (self.end - self.start).astype(np.uint64))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = PLAIN) -> Words:
    """All words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``offsets`` start at 0."""
    n = len(data)
    m = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = m.copy(), m.copy()
    if n:
        begins[1:] &= ~m[:-1] | edge[1:n]
        ends[:-1] &= ~m[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def word_slices(texts: pa.Array, inside: np.ndarray = PLAIN, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, last text + 1, words) for slices of a string array."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        yield lo, hi, words(LOWER[part] if lower else part, offsets[lo:hi + 1] - offsets[lo], inside)


def cover(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the given ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values by text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
