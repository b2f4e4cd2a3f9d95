"""Text columns as byte arrays inside a task: blocks, words, rolling hashes.

Everything works on one Arrow string column at a time, in blocks of bounded size (a
single text longer than a block forms a block of its own), and reads whole texts.
Hashes depend on the bytes alone, so that tasks agree without talking to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: powers minus one keep few factors of two
_WORD = (1 << 64) - 1


class Block:
    """Rows ``lo`` to ``hi`` of a batch: their UTF-8 bytes and where each row starts."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def rows_of(self, sorted_positions: np.ndarray) -> np.ndarray:
        """The row of each position; positions ascend."""
        ends = np.searchsorted(sorted_positions, self.offsets[1:])
        return np.repeat(np.arange(len(self)), np.diff(ends, prepend=0))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts in blocks of at most ``limit`` bytes or one row; null is empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield Block(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes, also those of longer code points, as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, a run of bytes other than 0x20 and 0x09-0x0D."""
    return runs(block, ~is_space(block.data))


def runs(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes marked ``inside``, within rows."""
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[block.offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:-1]
    after = np.concatenate((inside[1:], [False])) & ~first[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x ^ np.uint64((seed * 0xD1342543DE82EF95) & _WORD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def combine(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit number for an ordered pair of them."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))), seed)


@lru_cache(maxsize=8)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), seed + 101)


class Rolling:
    """Hashes of any spans of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        size = 1 << max(4, int(len(data)).bit_length())
        self._inverse, self._seed = _powers(size, True), seed
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(seed)[data] * _powers(size, False)[: len(data)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return combine(sums, (ends - starts).astype(np.uint64), self._seed)

    def grams(self, q: int) -> np.ndarray:
        """Of the ``q`` bytes at every position that has as many."""
        n = len(self._sums) - q
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[q:] - self._sums[:n]) * self._inverse[:n], self._seed)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
