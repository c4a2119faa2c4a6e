"""A wavelet matrix over small classes, in numpy, for many queries at once.

Each level holds one bit of every class in the order the level above leaves: zeros
first, then ones, both in their old order. Bits are packed into 64-bit words, with the
ones before each word counted, so a rank is one look-up and a few counted bits.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit string with rank."""

    def __init__(self, flags: np.ndarray):
        self.size = len(flags)
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(self.size // 64 + 1, "<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position ``at`` (0 to size)."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, classes: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (classes >> level) & 1 == 1
            self.levels.append(Bits(one))
            self.zeros.append(len(classes) - int(one.sum()))
            classes = np.concatenate([classes[~one], classes[one]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each position ``at``."""
        at, start = np.asarray(at, np.int64), np.zeros(1, np.int64)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones, ones_start = level.rank(at), level.rank(start)
            if value >> (len(self.levels) - 1 - k) & 1:
                at, start = zeros + ones, zeros + ones_start
            else:
                at, start = at - ones, start - ones_start
        return at - start

    def count(self, values: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of ``values`` together stand before each position ``at``."""
        return sum(self.rank(v, at) for v in values)

    def locate(self, values: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest position from ``low`` to ``high`` with at most ``wanted`` of ``values`` before it, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.count(values, middle) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low
