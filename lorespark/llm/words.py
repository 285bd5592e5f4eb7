"""Words and word shingles as 64-bit hashes, in numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs give equal outputs on every machine."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words; forgets all when it has grown to ``most`` words."""

    most = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


KNOWN = WordHashes()


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; in a text without any, runs of other characters."""
    if not text:
        return []
    text = text.lower()
    return WORD.findall(text) or text.split()


def hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(KNOWN.__getitem__, found), np.uint64, len(found))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, as ``\\w`` has it, and which are white space."""
    every = [chr(c) for c in range(0x110000)]
    wordy = np.array([c.isalnum() for c in every])
    wordy[ord("_")] = True
    return wordy, np.array([c.isspace() for c in every])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order; the words are those of :func:`words`, but never made as strings."""
    if not text:
        return np.zeros(0, np.uint64)
    wordy, space = _tables()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = wordy[codes]
    if not inside.any():
        inside = ~space[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, np.uint64)
    lengths = edges[1::2] - edges[::2]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(1, int(lengths.sum()) + 1, dtype=np.uint64) - np.repeat(starts.astype(np.uint64), lengths)
    return mix(np.add.reduceat(mix(codes[inside] + place * GOLDEN), starts))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` hashes; of all of them if there are fewer, none if there is none."""
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * GOLDEN + h[k : k + n] + np.uint64(k + 1))
    return out


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct word shingles of a text, sorted."""
    return np.unique(windows(word_hashes(text), size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def unpack(values: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint32) for v in values]
