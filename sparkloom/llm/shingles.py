"""Distinct word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sparkloom.llm.common import utf8, word_marks

_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES_AT_ONCE = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z as a-z if folded, and the number of words of each text."""
    if fold:
        data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    marks = word_marks(data, at)
    starts = np.flatnonzero(marks)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # a word ends at the next blank, or where its text ends
    ends = np.union1d(np.flatnonzero(blank), at)
    stops = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, max(1, len(data)))[: len(data)], out=prefix[1:])
    hashes = (prefix[stops] - prefix[starts]) * _powers(_INVERSE, max(1, len(data)))[starts]
    return mixed(hashes + (stops - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, at))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of k words of each text; the whole sequence where words are fewer."""
    words, sizes = word_hashes(data, at)
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams = mixed(grams * _BASE + words[j : j + len(grams)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for n, a in zip(sizes.tolist(), begin.tolist()):
        if n >= k:
            yield np.unique(grams[a : a + n - k + 1])
        elif n:
            whole = np.uint64(n)
            for w in words[a : a + n]:
                whole = mixed(np.array([whole * _BASE + w], np.uint64))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def batch_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sets of a column's texts, in portions of bounded size."""
    data, at = utf8(column)
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + BYTES_AT_ONCE, side="right")) - 1)
        with np.errstate(over="ignore"):
            yield from shingle_sets(data[at[start] : at[stop]], at[start : stop + 1] - at[start], k)
        start = stop
