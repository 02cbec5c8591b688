"""Words as 64-bit hashes, and hashes of runs of words, for numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from quillon.llm.common import Remembered

#: Words that a worker remembers.
MOST = 400_000
#: Multipliers of the run hashes (fixed odd numbers).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(Remembered):
    """A word's bytes -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > MOST:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of `length` words, by their first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    each = mixed(words + np.uint64(which))
    out, factor = each[:n].copy(), np.uint64(MULTIPLIERS[which])
    for k in range(1, length):
        out *= factor
        out += each[k : k + n]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
