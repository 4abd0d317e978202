"""Words of whole texts as 64-bit hashes, all words of a batch at once.

A word's hash is a sum of random values of its bytes times powers of an odd number, finished by a
bijective mix; words of more than ``LONG`` bytes take XXH64. Hashes of runs of words are built by
doubling: a run of L words is its first and its last ceil(L / 2) words, which may overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

LONG = 64
CHUNK = 1 << 20
_R = np.random.default_rng(977)
_VALUE = _R.integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)
_POWER = np.cumprod(np.full(LONG, int(_R.integers(1 << 62, 1 << 63)) | 1, np.uint64))


def byte_set(chosen: bytes) -> np.ndarray:
    """256 booleans, true for the chosen bytes."""
    out = np.zeros(256, bool)
    out[list(chosen)] = True
    return out


#: What ends a word: ASCII white space.
SPACES = byte_set(b" \t\n\x0b\x0c\r")


@dataclass
class Words:
    """Words of several texts, one after the other, as ranges of ``data``; ``counts`` of them a text."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def place(self) -> np.ndarray:
        """The number of each word within its text."""
        before = np.concatenate([[0], np.cumsum(self.counts)[:-1]]) if len(self.counts) else np.zeros(0, np.int64)
        return np.arange(len(self.start)) - np.repeat(before, self.counts)


def split_words(texts: list[bytes], separators: np.ndarray = SPACES, fold: bytes | None = None) -> Words:
    """The maximal runs of bytes that are no separators; ``fold`` is a table for ``bytes.translate``. Texts are joined by a space, which must be a separator."""
    data = b" ".join(texts) + b" "
    data = data.translate(fold) if fold else data
    gap = separators[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = turns[::2], turns[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, limits)]))
    return Words(data, start, end, counts)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hash of every word, made of about CHUNK bytes at a time."""
    size = words.end - words.start
    out = np.zeros(len(size), np.uint64)
    data = np.frombuffer(words.data, np.uint8)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(words.start, words.start[lo] + CHUNK)))
        span = np.minimum(size[lo:hi], LONG)
        first = np.concatenate([[0], np.cumsum(span)[:-1]])
        at = np.arange(int(span.sum())) - np.repeat(first, span)
        bytes_ = data[at + np.repeat(words.start[lo:hi], span)]
        out[lo:hi] = _finish(np.add.reduceat(_VALUE[bytes_] * _POWER[at], first) + size[lo:hi].astype(np.uint64))
        lo = hi
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(words.data[words.start[i] : words.end[i]], 42)
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return _finish(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, by doubling."""
    if size == 1 or len(h) < size:
        return h[: max(0, len(h) - size + 1)]
    half = (size + 1) // 2
    x = run_hashes(h, half)
    n, far = len(h) - size + 1, size - half
    return mix(x[:n], x[far : far + n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values, by doubling."""
    if size == 1 or len(x) < size:
        return x[: max(0, len(x) - size + 1)]
    half = (size + 1) // 2
    y = sliding_min(x, half)
    n, far = len(x) - size + 1, size - half
    return np.minimum(y[:n], y[far : far + n])
