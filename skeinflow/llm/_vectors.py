"""Integer vectors in Arrow columns, their exact inner products, and the best of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(df: DataFrame, id_col: str, vec_col: str, scale: float, *more: Column) -> DataFrame:
    """(id, vec, more): rows with an id and a vector whose parts are all finite, also after scaling."""
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"), *more)
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | ~(F.abs(x.cast("double")) * F.lit(float(scale)) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~odd)


def whole(column: pa.Array, scale: float, width: int = 0) -> np.ndarray:
    """floor(scale * x) of a column of vectors as a matrix; shorter vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    d = max(width, int(lengths.max(initial=0)))
    if (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def wide(x: np.ndarray, d: int) -> np.ndarray:
    """The rows of ``x`` with zeros up to ``d`` columns."""
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def products(q: np.ndarray, s: np.ndarray, bound: float) -> np.ndarray:
    """q @ s.T for whole numbers, exactly.  ``bound``: no sum of absolute products is larger (by the norms).

    Results are doubles below 2^53, else 64-bit integers; what may not fit those is an error.
    """
    if bound < 1 << 24:  # every partial sum is a float's whole number
        return (q.astype(np.float32) @ s.astype(np.float32).T).astype(np.float64)
    if bound < 1 << 53:
        return q @ s.T
    if bound < 1 << 62:
        return q.astype(np.int64) @ s.astype(np.int64).T
    raise ValueError("inner products need more than 64 bits")


def lowest(dtype) -> float | int:
    """Stands below every score of that kind."""
    return -np.inf if np.issubdtype(dtype, np.floating) else -((1 << 63) - 1)


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int, dtype):
        self.k, self.low = k, lowest(dtype)
        self.score = np.full((n, k), self.low, dtype)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def put(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer rows ``ids`` with their scores to the queries ``some``; a score of ``low`` is none."""
        worst, last = self.score[some, -1][:, None], self.id[some, -1][:, None]
        hit = (scores > worst) | ((scores == worst) & (ids[None, :] < last) & (scores > self.low))
        m, k = scores.shape[1], self.k
        if m > k and hit.sum() > 4 * k * len(some):
            # only the k best of a row can stay; of equal ones at the edge, those with the smallest ids
            edge = np.partition(scores, m - k, axis=1)[:, m - k][:, None]
            order = np.argsort(ids, kind="stable")
            level = (scores == edge)[:, order]
            first = np.zeros_like(hit)
            first[:, order] = level & (np.cumsum(level, axis=1) <= k)
            hit &= (scores > edge) | first
        r, c = np.nonzero(hit)
        if not len(r):
            return
        touched = np.unique(r)
        place = np.searchsorted(touched, r)
        held = some[touched]
        score = np.concatenate((self.score[held].ravel(), scores[r, c]))
        name = np.concatenate((self.id[held].ravel(), ids[c]))
        row = np.concatenate((np.repeat(np.arange(len(touched)), k), place))
        order = np.lexsort((name, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.score[held] = score[order][keep].reshape(-1, k)
        self.id[held] = name[order][keep].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of what is there."""
        q, r = np.nonzero(self.score > self.low)
        return q, self.id[q, r], self.score[q, r].astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal whole numbers in the first ``keys`` columns; a stretch may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(keys)], 1)
        bounds = [0, *(np.flatnonzero((x[1:] != x[:-1]).any(1)) + 1).tolist(), len(x)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield tuple(x[a].tolist()), batch.slice(a, b - a)
