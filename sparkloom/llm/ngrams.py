"""Hashed character n-grams of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

BLANK = 0x20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hash buckets of n-grams; blanks only at an n-gram's ends, and not alone."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = codes == BLANK
    good = ~blank[:size]
    if n > 1:
        good |= ~blank[n - 1 :]
        for k in range(1, n - 1):
            good &= ~blank[k : k + size]
        if n == 2:
            good &= ~(blank[:size] & blank[1:])
    at = np.flatnonzero(good)
    value = np.full(len(at), n, np.uint32)
    for k in range(n):
        value = value * np.uint32(0x01000193) ^ codes[at + k]
        value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    return at, (value >> np.uint32(32 - bits)).astype(np.int64)
