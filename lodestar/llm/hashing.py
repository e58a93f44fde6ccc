"""Hashes of words and of runs of words, equal on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

#: Multiplier of the polynomial over word hashes (odd, so that no word's bits are lost).
BASE = 0x9E3779B97F4A7C15

_MASK = (1 << 64) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def windows(h: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words, from the words' hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for j in range(size):
        out += h[j : j + n] * np.uint64(power)
        power = power * base & _MASK
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
