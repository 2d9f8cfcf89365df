"""Vectors in Arrow batches: which take part, samples, and k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 20_000  # vectors that an index is fitted on at most


def usable(col: str) -> Column:
    """The vector is neither null nor empty nor zero and holds finite numbers only (DataFrame functions; null counts as false)."""
    v = F.col(col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def element_kind(kind: T.DataType) -> str:
    """The array type vectors travel in: single-precision ones stay so, which halves what is shuffled; all others become double."""
    return "array<float>" if kind == T.ArrayType(T.FloatType(), kind.containsNull if isinstance(kind, T.ArrayType) else True) else "array<double>"


def matrix(lists) -> np.ndarray:
    """(rows, dimension) float64 of a list column whose rows have one length and no nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            return np.zeros((0, 1))
    if not len(lists):
        return np.zeros((0, 1))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def sample(vectors: DataFrame, column: str, n: int, most: int = SAMPLE) -> np.ndarray:
    """At most `most` of n vectors, by a hash of the vector."""
    rank = F.pmod(F.xxhash64(column), F.lit(1 << 40))
    share = min(1.0, 0.9 * most / max(1, n))
    rows = vectors.where(rank < int(share * (1 << 40))).select(column).limit(most).toArrow()
    out = matrix(rows.column(0))
    return out[np.lexsort(out.T)]  # the same order however the rows lie


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, spherical: bool, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """At most k centroids of x."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ c.T if spherical else 2 * (x @ c.T) - (c * c).sum(axis=1)
        own = near.argmax(axis=1)
        size = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = total[size > 0] / size[size > 0, None]
        if spherical:
            c = c[(c * c).sum(axis=1) > 0]
            c = unit(c)
    return c
