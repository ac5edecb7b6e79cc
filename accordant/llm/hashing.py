"""64-bit hashes of words and word shingles over Arrow buffers, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 19  # bytes hashed at once


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(of: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, of, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class WordHasher:
    """Hashes of the words of a batch of texts (null: empty), A-Z lower-cased.

    A word is a run of bytes other than space and tab to carriage return.  Its hash is a polynomial
    over its bytes, taken from prefix sums, so a batch is hashed by a few array operations.
    """

    def __init__(self):
        self.up, self.down = _powers(BASE, BLOCK + 1), _powers(INVERSE, BLOCK + 1)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All word hashes in order, and per text the index of its first word (one more entry at the end)."""
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = ~space
        edge = at[:-1][at[:-1] < len(raw)]
        follows = np.zeros(len(raw), bool)
        follows[1:] = ~space[:-1]
        follows[edge] = False  # a text starts a word of its own
        starts = np.flatnonzero(first & ~follows)
        last = np.ones(len(raw), bool)
        last[:-1] = space[1:]
        last[edge[edge > 0] - 1] = True
        ends = np.flatnonzero(first & last) + 1
        hashes = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = int(np.searchsorted(ends, starts[lo] + BLOCK, side="right"))
            hi = max(hi, lo + 1)
            a, b = starts[lo], ends[hi - 1]
            if b - a >= len(self.up):  # one word longer than a block
                self.up, self.down = _powers(BASE, int(b - a) + 1), _powers(INVERSE, int(b - a) + 1)
            part = raw[a:b]
            part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:b - a], out=sums[1:])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            hashes[lo:hi] = mixed((sums[e] - sums[s]) * self.down[s])
            lo = hi
        return hashes, np.searchsorted(starts, at, side="left")

    def shingle_sets(self, texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
        """Per text its sorted distinct shingles of ``n`` words; of fewer words, the whole sequence as one; none of an empty text."""
        hashes, at = self.words(texts)
        rolled = np.zeros(0, np.uint64)
        if len(hashes) >= n:
            m = len(hashes) - n + 1
            rolled = np.zeros(m, np.uint64)
            for k in range(n):
                rolled = rolled * STEP + hashes[k:k + m]
            rolled = mixed(rolled)
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= n:
                yield np.unique(rolled[lo:hi - n + 1])
            elif hi > lo:
                whole = np.uint64(hi - lo)  # the number of words keeps it apart from longer shingles
                for h in hashes[lo:hi]:
                    whole = np.uint64((int(whole) * int(STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
                yield mixed(np.array([whole]))
            else:
                yield np.zeros(0, np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set: the sum of spread hashes, whatever the order."""
    total = int(np.sum(mixed(shingles ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)) + len(shingles)
    total = int(mixed(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
    return total - (1 << 64) if total >> 63 else total
