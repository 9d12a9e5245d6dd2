"""Vectorised hashing of words, shared by the duplicate finders."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
MEMO_LIMIT = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word (bytes) -> 64-bit hash; forgets all at ``MEMO_LIMIT`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hash_words(docs: list[list[bytes]], memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all documents, one after the other, and the documents' lengths."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    return np.fromiter((memo[w] for d in docs for w in d), np.uint64, int(n.sum())), n
