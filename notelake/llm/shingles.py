"""Hashed words and word shingles of whole texts, as arrays."""

import numpy as np
import xxhash

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; k up to 8 uses a multiplier for each place."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += mix(hashes[j : j + n] + _ODD[j % 8] * np.uint64(j // 8 + 1)) * _ODD[j % 8]
    return mix(total)


def shingle_set(words: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles and the letters of each; a text of fewer words is one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    hashes, k = word_hashes(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    lengths = ends[k - 1 :] - np.concatenate(([0], ends[:-k]))
    found, first = np.unique(window_hashes(hashes, k), return_index=True)
    return found, lengths[first].astype(np.float64)
