"""Whitening of embeddings by a randomised range finder.

The covariance is never stored: a pass multiplies it with a thin matrix Q, as the sum over all
centred rows of row times (row times Q).  Random directions, some more than wanted, are sent
through such passes until Rayleigh-Ritz vectors of their span are eigenvectors to rounding; if
they are not after ``POWERS`` more passes, the span is expanded to the full dimension, where
they are.  What comes to the driver is one matrix of the vectors' dimension a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stored

#: Directions beyond the wanted ones, and power passes before the span is expanded.
OVERSAMPLE, POWERS = 10, 3
#: Residuals, as a part of the largest eigenvalue, that rounding may leave.
RESIDUAL = 1e-14
#: Entries beyond this leave no room for exact sums.
LARGEST = float(1 << 52)


def whole_numbers(rows: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, y): floor(scale * entry) of the vectors that take part, as longs.

    Vectors that are null or empty, or hold null or non-finite entries or such that exceed
    2^52 when scaled, take no part, nor do those of another length than most have (of equally
    frequent lengths the longest counts).
    """
    v = F.col(vec_col)
    scaled = F.transform(v, lambda c: c.cast("double") * scale)
    odd = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    some = rows.filter(v.isNotNull() & (F.size(v) > 0)).filter(~odd)
    lengths = some.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    some = some.filter(F.size(v) == (lengths["d"] if lengths else 0))
    return some.select(F.col(id_col), F.transform(scaled, lambda c: F.floor(c)).alias("y"))


class Centre:
    """Exact sums of all rows, and rows less their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def moved(self, y: np.ndarray) -> np.ndarray:
        """n * y - sum, exactly: longs where they fit, else Python's numbers."""
        top = int(np.abs(y).max(initial=0))
        if self.n * top + max(map(abs, self.sums)) < 1 << 62:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (self.moved(y) / self.n).astype(np.float64)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The squared length of ``moved``; None beyond what a long holds."""
        z = self.moved(y)
        if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] > float(1 << 62):
            z = z.astype(object)
        return [x if x < 1 << 63 else None for x in (z * z).sum(axis=1).tolist()]


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centre(rows: DataFrame, d: int) -> Centre:
    """One pass of whole-number sums, in two halves of 32 bits so that Spark's longs hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            y = matrix(b, d)
            n += len(y)
            sums = [s + t for s, t in zip(sums, y.sum(axis=0).tolist(), strict=True)]
        if n:
            halves = [pa.array([s >> 32 for s in sums], pa.int64()), pa.array([s & 0xFFFFFFFF for s in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *halves, pa.array([n] * d, pa.int64())], ["i", "hi", "lo", "n"])

    got = rows.mapInArrow(run, "i int, hi long, lo long, n long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("hi", "lo", "n"))).orderBy("i").collect()
    return Centre(got[0]["n"], [(r["hi"] << 32) + r["lo"] for r in got])


def product(rows: DataFrame, at: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(covariance times ``q``, trace of the covariance), from one pass over all centred rows."""
    d, wide = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((d, wide)), 0.0
        for b in batches:
            x = at.centred(matrix(b, d))
            total += x.T @ (x @ q)
            trace += float((x * x).sum())
        values = np.append(total.ravel(), trace)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values, pa.float64())], ["k", "value"])

    out = np.zeros(d * wide + 1)
    for k, value in rows.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value")).collect():
        out[k] = value / at.n
    return out[:-1].reshape(d, wide), float(out[-1])


def ritz(q: np.ndarray, vq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual as a part of the largest value) of the span of ``q``."""
    b = q.T @ vq
    e, w = np.linalg.eigh((b + b.T) / 2)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    u = q @ w
    left = np.linalg.norm(vq @ w - u * e, axis=0).max(initial=0.0)
    return np.maximum(e, 0), u, float(left / e[0]) if e[0] > 0 else 0.0


def components(rows: DataFrame, at: Centre, k: int, oversample: int, powers: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) of the covariance, largest first."""
    d = len(at.sums)
    k = min(k, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + oversample))))[0]
    for _ in range(1 + powers):
        vq, trace = product(rows, at, q)
        e, u, residual = ritz(q, vq, k)
        if residual <= RESIDUAL or q.shape[1] == d:
            return e, u, trace
        q = np.linalg.qr(vq)[0]
    q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, d - q.shape[1]))]))[0]
    vq, trace = product(rows, at, q)
    e, u, _ = ritz(q, vq, k)
    return e, u, trace


def whiten(rows: DataFrame, k: int = 32, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", oversample: int = OVERSAMPLE, powers: int = POWERS, seed: int = 1) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row and component.

    A constant added to all entries changes none of these, so rows stay the small numbers
    floor(scale * entry).  ``whole_numbers`` says which rows take part; those with equal or
    null ids do so each for itself, and with none the result is empty.  Where a component has
    no variance, ``whitened`` is null, and identity_error is over the others (null if there
    are none); ``explained`` is 0 where nothing varies; a deviation beyond a long is null.
    """
    spark = session(rows)
    kind = dict(rows.dtypes)[id_col]
    ddl = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    y = stored(whole_numbers(rows, scale, id_col, vec_col), "whole")
    first = y.select(F.size("y").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], ddl)
    at = centre(y, first["d"])
    e, u, trace = components(y, at, k, oversample, powers, seed)
    live = e > len(at.sums) * np.finfo(float).eps * max(e[0], 0.0)
    scaled = u / np.sqrt(np.where(live, e, 1.0))
    error = None
    if live.any():
        own = scaled[:, live]
        error = float(np.abs(own.T @ product(y, at, own)[0] - np.eye(own.shape[1])).max())
    explained = (e / trace if trace > 0 else np.zeros_like(e)).tolist()
    d, wide, dead = len(at.sums), len(e), np.flatnonzero(~live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b, d)
            rows = len(m)
            w = at.centred(m) @ scaled
            gone = np.zeros(w.shape, bool)
            gone[:, dead] = True
            each = pa.array(np.repeat(np.arange(rows), wide))
            columns = [
                b.column(0).take(each),
                pa.array(np.tile(np.arange(1, wide + 1), rows), pa.int32()),
                pa.array(np.full(rows * wide, at.n), pa.int64()),
                pa.array(at.deviations(m), pa.int64()).take(each),
                pa.array(w.ravel(), pa.float64(), mask=gone.ravel()),
                pa.array(explained * rows, pa.float64()),
                pa.array([error] * (rows * wide), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return y.mapInArrow(run, ddl)
