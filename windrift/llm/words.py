"""Words, lines and word n-grams of Arrow text columns as numpy arrays.

A word is a run of bytes other than space and \\t..\\r, which in UTF-8 is the same as a run of
such characters. Hashes are 64 bits wide: a polynomial over random byte values, then mixed; they
depend on the bytes alone, so every task, run and machine gives a text the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from windrift.llm.common import text_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of base and of its inverse, modulo 2^64."""
    have = _TABLES.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, _SEGMENT + 1)
        up, down = np.full(size, base), np.full(size, _inverse(base))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * _SEGMENT:
            _TABLES[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each segment [start, end) of buf; segments rise and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        low = int(starts[i])
        b = buf[low : int(ends[j - 1])]
        up, down = powers(_BYTE_BASE, len(b))
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUES[b] * up[: len(b)], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Words:
    """The words of a text column, in order: hashes, byte ranges, and where each text's words begin."""

    def __init__(self, column: pa.Array, hashed: bool = True):
        self.buf, self.offsets = text_of(column)
        buf, n = self.buf, len(self.buf)
        solid = ~SPACE[buf]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        own = np.diff(self.offsets) > 0
        heads, tails = self.offsets[:-1][own], self.offsets[1:][own] - 1
        first[heads] = solid[heads]
        last[tails] = solid[tails]
        self.solid = solid
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.n = len(self.starts)
        self.hashes = segment_hashes(buf, self.starts, self.ends) if hashed and n else np.empty(0, np.uint64)

    def text_index(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def words_left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(self.n)


class Runs:
    """Hashes of any run of consecutive items (words or names) in constant time a run."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        up, self.down = powers(_WORD_BASE, n)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(items * up[:n], out=self.total[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        ends = starts + lengths
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + np.asarray(lengths, np.int64).astype(np.uint64))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def names128(items: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """[n, 2] names of runs of items by two independent hashes of all their items, 128 bits together."""
    return np.stack([Runs(items).of(starts, lengths), Runs(mix(items ^ np.uint64(0x632BE59BD9B4E019))).of(starts, lengths)], axis=1)
