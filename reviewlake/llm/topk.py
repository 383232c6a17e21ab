"""Exact top-k inner-product search by term-at-a-time accumulation.

Vectors are integer sparse rows: term t (a dimension) with a weight.  A block of candidates
keeps, for every term, its postings; a query's terms are taken one at a time and scattered,
weight times posting, into a dense score array over the block.  The best of every block are
found by partition selection and merged by query.  Both sides are dealt into blocks of
bounded size, and a task holds one block of candidates and one of queries.

The side with fewer blocks is the one whose rows are repeated: a candidate goes out once for
each block of queries, a query once for each block of candidates.  Weights travel in the
narrowest of 2, 4 and 8 bytes that holds a vector's largest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import checkpoint, session

#: Scores that are added up at a time.
STRIP = 1 << 18
#: Rows in a block of candidates and of queries.
CANDIDATES, QUERIES = 16384, 8192


def _quantise(scale: int):
    def run(batches):
        for b in batches:
            ids, blobs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(np.asarray(v, np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    blobs.append(narrow(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "v"])

    return run


def narrow(x: np.ndarray) -> bytes:
    """Weights in the narrowest width that holds them; the first byte names it."""
    most = int(np.abs(x).max(initial=0))
    wide = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([wide]) + x.astype(f"<i{wide}").tobytes()


def _terms(blobs: list[bytes]) -> int:
    return max(((len(b) - 1) // b[0] for b in blobs), default=0)


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    """Postings by term: row t has the weights of term t; missing components weigh nothing."""
    out = np.zeros((dims, len(blobs)), np.int64)
    for k, b in enumerate(blobs):
        x = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[: len(x), k] = x
    return out


def accumulate_scores(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Dense scores (queries x candidates), one term after another over its non-zero entries.

    Scores are 32-bit where the sum of the largest products of all terms fits, else 64-bit.
    """
    most = sum(int(np.abs(q).max(initial=0)) * int(np.abs(p).max(initial=0)) for q, p in zip(queries, postings, strict=True))
    kind = np.int32 if most < (1 << 31) - 1 else np.int64
    queries, postings = queries.astype(kind, copy=False), postings.astype(kind, copy=False)
    scores = np.zeros((queries.shape[1], postings.shape[1]), kind)
    product = np.empty_like(scores)
    for weights, row in zip(queries, postings, strict=True):
        who, docs = np.flatnonzero(weights), np.flatnonzero(row)
        if len(docs) == len(row) and len(who) == len(weights):
            scores += np.multiply(weights[:, None], row, out=product)
        elif len(docs) and len(who):
            scores[np.ix_(who, docs)] += weights[who][:, None] * row[docs]
    return scores


def select_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every row's k best, ties to smaller columns, by partition selection."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
        more, same = scores > least, scores == least
        room = k - more.sum(axis=1, keepdims=True)
        keep = more | (same & (np.cumsum(same, axis=1) <= room))
    else:
        keep = np.ones_like(scores, bool)
    return np.nonzero(keep)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), id, score.

    Components are floor(scale * x); the score is their integer inner product, ties go to the
    smaller id, and a query is never its own candidate.  Vectors with a null id, and those that
    are null or hold a null or non-finite component, take no part; shorter vectors count as
    filled up with zeros.  An id that repeats among the candidates is one each time it stands
    there.  An id that repeats among the queries asks once for each different vector, and its
    answers are ranked together: of all its scores with a candidate row the best counts.  Other
    columns are not read; an empty table gives an empty one.
    """
    session(vectors)
    dense = checkpoint(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).mapInArrow(_quantise(scale), "id long, v binary"))
    asked = checkpoint(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).mapInArrow(_quantise(scale), "id long, v binary").distinct())
    n, m = dense.count(), asked.count()
    parts, blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("id", "v", F.lit(own)), F.lit(of)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(key: tuple, cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "vector", "copies", "score"]
        if cand.empty or ask.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        cand, ask = cand.sort_values(["id", "v"], ignore_index=True), ask.sort_values("id", ignore_index=True)
        ids, who = cand["id"].to_numpy(), ask["id"].to_numpy()
        about = (ids, np.fromiter((xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in cand["v"]), np.int64, len(cand)), cand["copies"].to_numpy())
        dims = max(_terms(list(cand["v"])), _terms(list(ask["v"])))
        postings, wide = _matrix(list(cand["v"]), dims), _matrix(list(ask["v"]), dims)
        rows: list[list[np.ndarray]] = [[], [], [], [], []]
        strip = max(1, STRIP // len(ids))
        for a in range(0, len(who), strip):
            scores = accumulate_scores(wide[:, a : a + strip], postings)
            least = np.iinfo(scores.dtype).min
            scores[who[a : a + strip, None] == ids[None, :]] = least
            r, c = select_best(scores, k)
            keep = scores[r, c] != least
            r, c = r[keep], c[keep]
            for out, x in zip(rows, (who[r + a], *(x[c] for x in about), scores[r, c].astype(np.int64)), strict=True):
                out.append(x)
        return pd.DataFrame(dict(zip(names, map(np.concatenate, rows), strict=True)))

    left = dealt(dense.groupBy("id", "v").agg(F.count("*").alias("copies")), "part", parts, "block", blocks)
    right = dealt(asked, "block", blocks, "part", parts)
    keys = ["part", "block"]
    found = left.select(*keys, "id", "copies", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(run, "query_id long, id long, vector long, copies long, score long")
    # Candidates with equal id and vector were one so far.
    found = found.groupBy("query_id", "id", "vector").agg(F.max("score").alias("score"), F.max("copies").alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "vector", "copy")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
