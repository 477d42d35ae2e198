"""Helpers for work on many texts at once inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def in_chunks(texts: list[str], characters: int) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together; a longer text is a
    chunk of its own."""
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > characters:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the length of each text."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(joined, dtype=np.uint32), lengths


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first ``2 ** bits`` powers."""
    steps = np.full(2**bits, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


@lru_cache(maxsize=1)
def _mixed_points() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def segment_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of an array of code points, from differences
    of one running sum."""
    bits = len(points).bit_length()
    terms = _mixed_points()[points] * _powers(_BASE, bits)[: len(points)]
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    inverse = _powers(_INVERSE, bits)
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))


def firsts(codes: np.ndarray, distinct: int) -> np.ndarray:
    """Position of the first occurrence of every code."""
    found = np.empty(distinct, dtype=np.int64)
    found[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return found


def first_of_each(groups: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array changes."""
    fresh = np.ones(len(groups), dtype=bool)
    fresh[1:] = groups[1:] != groups[:-1]
    return np.flatnonzero(fresh)
