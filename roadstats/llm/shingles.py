"""Hashed 5-word shingle sets, for tasks that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets everything when it holds too many."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of bytes other than the six white-space ones."""
    return text.encode().lower().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """64-bit hashes (int64) of the text's shingles in order; fewer than five words are one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    out = _mixed(h[:n - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = _mixed(out + h[i:n - width + 1 + i])
    return out.view(np.int64)


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(words, hashes))


def signature(values: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    h = xxhash.xxh3_64_intdigest(values.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h
