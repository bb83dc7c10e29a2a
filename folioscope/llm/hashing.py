"""Hashes of all runs of a length in a sequence, in a few vector steps."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def codes(which: int) -> np.ndarray:
    """A fixed random odd 64-bit number for each byte."""
    numbers = np.random.default_rng(which).integers(0, 1 << 63, 256, dtype=np.uint64)
    return numbers * np.uint64(2) + np.uint64(1)


def powers(size: int, which: int) -> np.ndarray:
    one = np.ones(1, np.uint64)
    return np.multiply.accumulate(np.concatenate([one, np.full(size, _ODD[which], np.uint64)]))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a hash over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, length: int, which: int) -> np.ndarray:
    """A hash of values[i:i + length] for every i: powers of two of the length, joined."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, got, result = values, 1, 0, np.zeros(len(values), np.uint64)
    while size <= length:
        shift = np.uint64(pow(_ODD[which], size, 1 << 64))
        if length & size:
            result = result[:len(h) - got] * shift + h[got:]
            got += size
        if 2 * size <= length:
            h = h[:-size] * shift + h[size:]
        size *= 2
    return mixed(result[:n])
