"""Vector columns: which rows take part, and their values as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as ending in zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(col: pa.Array, wide: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary()) if size else pa.array([b""] * len(rows), pa.binary())


def unpacked(col: pa.Array, dtype, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, wide)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added from first to last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centroids of the rows."""
    k = min(k, len(x))
    c = x[np.random.Generator(np.random.PCG64(seed)).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
