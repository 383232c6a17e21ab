"""Document quality by a regularised quadratic discriminant.

Each class of labelled documents has a mean and a covariance of transformed document
statistics; covariances shrink towards their pooled form and towards a diagonal.  The log
ratio is the difference of the two Gaussian log densities (Mahalanobis distances by Cholesky
factors, taken once) and the log prior odds.  A score is the logistic of the log ratio divided
by the square root of the number of statistics: they depend on one another, so that untempered
ratios are too sure; the order of documents and the side of 0.5 stay.

The model is made of sums over all labelled rows (counts, sums, cross products), which
partitions add up.  For these sums statistics are rounded to ``UNIT`` and added as integers,
so that the model is the same in whatever order rows come, and nothing cancels out.  Texts are
read once, for their statistics.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, session

#: Shares of the pooled covariance and of its diagonal in a class covariance.
POOLED, DIAGONAL = 0.2, 0.05
STATS = 18
#: Steps of a statistic in the sums of moments: a power of two.
UNIT = 1024

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 capital, 3 digit, 4 space, 5 line end, 6 stop or comma, 7 symbol, 8 quote or dash
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
for _c in b".,;:!?":
    _CLASS[_c] = 6
for _c in b"#$%&*+/<=>@\\^_`{|}~":
    _CLASS[_c] = 7
for _c in b"'\"()-[]":
    _CLASS[_c] = 8


def statistics(text: str | None) -> list[float]:
    """Logs, logits and square roots of what a document is made of; a null is an empty text."""
    raw = (text or "").encode()
    n = len(raw)
    x = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[x], minlength=9) / max(n, 1)
    words = raw.split()
    w = len(words)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    lengths = np.fromiter(map(len, words), np.int64, w)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(n, 1)
    seen = len(set(words))
    squeezed = len(zlib.compress(raw, 1)) / n if n else 1.0
    return [
        np.log1p(n),
        np.log1p(w),
        np.log1p(len(lines)),
        np.log1p(lengths.mean()) if w else 0.0,
        np.log1p(lengths.std()) if w else 0.0,
        seen / w if w else 1.0,
        len(set(lines)) / len(lines) if lines else 1.0,
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        min(squeezed, 1.5),
        np.log1p(n / max(len(lines), 1)),
        *np.sqrt(kinds[[1, 2, 3, 4, 6, 7, 8]]),
        np.sqrt(sum(not s.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for s in lines) / len(lines)) if lines else 0.0,
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats (array<double>) of every whole text."""
    session(df)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, STATS)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], [id_col, "stats"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    log_dets: list[float]
    log_odds: float

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        dens = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return dens[1] - dens[0] + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_ratio(x) / np.sqrt(x.shape[1]), -30, 30)))


def fit(moments: dict[int, tuple[int, list[int], list[int]]]) -> Model | None:
    """From each class's rows, sums and sums of products, integers in UNITs; None without both classes."""
    if not all(c in moments and moments[c][0] > 1 for c in (0, 1)):
        return None
    n = [moments[c][0] for c in (0, 1)]
    sums = [np.array(moments[c][1], object) for c in (0, 1)]
    outer = [np.array(moments[c][2], object).reshape(STATS, STATS) for c in (0, 1)]

    def spread(rows: int, total: np.ndarray, products: np.ndarray) -> np.ndarray:
        """The covariance; the difference is taken in whole numbers."""
        return ((rows * products - np.outer(total, total)) / (rows * rows)).astype(np.float64) / UNIT**2

    centre = ((sums[0] + sums[1]) / sum(n)).astype(np.float64) / UNIT
    scale = np.sqrt(np.maximum(np.diag(spread(sum(n), sums[0] + sums[1], outer[0] + outer[1])), 1e-8))
    means, covs = [], []
    for c in (0, 1):
        means.append(((sums[c] / n[c]).astype(np.float64) / UNIT - centre) / scale)
        covs.append(spread(n[c], sums[c], outer[c]) / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    factors, dets = [], []
    for cov in covs:
        cov = (1 - POOLED) * cov + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(float(np.log(np.diag(low)).sum()))
    return Model(centre, scale, means, factors, dets, float(np.log(n[1] / n[0])))


def train(labelled: DataFrame) -> Model | None:
    """Fit on all rows (label 0 or 1, stats); partitions send moments, never rows."""
    session(labelled)

    def run(batches):
        sums = {c: np.zeros(1 + STATS + STATS * STATS, np.int64) for c in (0, 1)}
        for b in batches:
            x = np.rint(np.asarray(b.column(1).flatten()).reshape(-1, STATS) * UNIT)
            y = np.asarray(b.column(0))
            for c in (0, 1):
                z = x[y == c]  # whole numbers below 2^53 in every product sum of a batch
                sums[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()]).astype(np.int64)
        for c, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([m], pa.list_(pa.int64()))], ["label", "m"])

    rows = labelled.select(F.col("label").cast("int"), "stats").mapInArrow(run, "label int, m array<long>")
    added = rows.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    moments: dict[int, list[int]] = {}
    for r in added.collect():  # a number for each class and moment, however many partitions there are
        moments.setdefault(r["label"], [0] * (1 + STATS + STATS * STATS))[r["pos"]] = int(r["total"])
    return fit({c: (m[0], m[1 : 1 + STATS], m[1 + STATS :]) for c, m in moments.items()})


def quality(df: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score and predicted of every whole text.

    ``held_out(id column)`` marks the rows that nothing is learned from.  Labels other than 0
    and 1 teach nothing; a label row that repeats counts each time, and so does a document row,
    each with its own text.  Null texts count as empty and get a score too; rows with a null id
    teach nothing.  If one class has fewer than two labelled rows, every score is 0.5.  Other
    columns are not read; an empty table gives an empty one.
    """
    stats = checkpoint(document_statistics(df, id_col, text_col))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    model = train(stats.filter(~held_out(F.col(id_col))).join(known, F.col(id_col) == F.col("__id")).select("label", "stats"))

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, STATS)
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [id_col, "score"])

    scored = stats.mapInArrow(run, f"`{id_col}` {dict(stats.dtypes)[id_col]}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
