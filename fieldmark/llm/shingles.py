"""Hashed word shingles in numpy, for the similarity join."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import distinct, words

CACHE_SIZE = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while the cache is not full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    span = min(size, len(hashes))
    out = np.full(len(hashes) - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out + hashes[k : k + len(out)] * ODD)
    return distinct(out)


def set_keys(shingles: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit keys of a set, the same for equal sets; the second does not depend on ``seed``."""
    count = np.uint64(len(shingles))
    own = shingles.sum(dtype=np.uint64) if not seed else mix(shingles + np.uint64(seed) * ODD).sum(dtype=np.uint64)
    both = mix(np.array([own + count, mix(shingles ^ ODD).sum(dtype=np.uint64) + count], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])
