"""Sets of hashed word shingles, computed in numpy for one text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 400_000
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHash(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z lowered; fewer words make one run; none, no set."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        k = min(size, n)
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = acc * PRIME + h[j : n - k + 1 + j]
        return np.unique(mix(acc))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "little", signed=True)
