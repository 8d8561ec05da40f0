"""Words of texts and their 64-bit hashes, for the operators that work in Python.

A word is a maximal run of characters other than the ASCII white space
``[\\x20\\x09-\\x0D]``; A-Z are lower-cased. ``bytes.split`` and ``bytes.lower``
do exactly that on UTF-8, at C speed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Words remembered by one Python worker; beyond it the memory is emptied, which changes no result.
REMEMBERED = 400_000
#: Bytes of text that one numpy step works on.
BLOCK_BYTES = 4 << 20

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """word -> hash, filled as words come."""

    def __init__(self, normal=None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of the words of one text, in order."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multiplier(i: int) -> np.uint64:
    """The odd number that marks place i of a shingle."""
    return _MULTIPLIERS[i] if i < len(_MULTIPLIERS) else np.uint64((int(_MULTIPLIERS[0]) * (2 * i + 1)) % 2**64 | 1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words; of the whole sequence if it is shorter; none of no words."""
    if not len(h):
        return h
    k, n = min(k, len(h)), len(h)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += mix(h[i : n - k + 1 + i]) * multiplier(i)
        return mix(out + np.uint64(k))


def distinct(h: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is faster here than numpy's own hashing."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h if len(of) else np.zeros(len(h), bool)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes of text, one row at least."""
    start, size, i = 0, 0, -1
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start <= i:
        yield start, i + 1
