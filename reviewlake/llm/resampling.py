"""Importance resampling towards a target distribution, over hashed runs of words.

A text's features are its runs of consecutive words, hashed by the CRC of their UTF-8 bytes.
The CRC of every word is computed once, over all words of a batch side by side; the CRC of a
run follows from those of its words, because appending m bytes to a string multiplies its CRC
by a fixed matrix over GF(2) before the CRC of what was appended is added.  No string of a run
is ever made.

Counts of buckets are added up in Spark; documents are weighed in a second pass, and the draw
is a sort by range: each range knows how many rows stand before it, so that no task sees all.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, session, stored, text_bytes

#: Bytes of a word that are hashed side by side; the rare longer ones go one by one.
SIDE_BY_SIDE = 32
#: Rows of a range when drawn documents are ranked.
RANGE_ROWS = 200_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, after lower-casing: digits, a-z and all of other characters.
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: What a byte adds to a CRC when it is shifted out.
BYTE_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def apply(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, times every vector of ``v``."""
    out = np.zeros_like(v)
    for i in range(32):
        out ^= columns[i] * (v >> np.uint32(i) & np.uint32(1))
    return out


@functools.cache
def shift(power: int) -> np.ndarray:
    """Tables of the matrix that appends 2**power zero bytes, one for each byte of a CRC."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = BYTE_TABLE[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
    for _ in range(power):
        columns = apply(columns, columns)
    octets = np.arange(256, dtype=np.uint32)
    return np.stack([apply(columns, octets << np.uint32(8 * k)) for k in range(4)])


def combine(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings joined, from those of the first and the second and the second's length."""
    a = a.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> power & 1)
        t, v = shift(power), a[at]
        a[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return a ^ b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, CRC, bytes) of every word of lower-cased texts that lie one after another."""
    inside = WORD[raw]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[1:-1]
    before[edge[edge < len(raw)]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(length <= SIDE_BY_SIDE)
    for j in range(int(length[at].max(initial=0))):
        at = at[length[at] > j]
        crc[at] = BYTE_TABLE[(crc[at] ^ raw[start[at] + j]) & np.uint32(255)] ^ (crc[at] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
        crc[i] = zlib.crc32(raw[start[i] : end[i]])
    return np.searchsorted(offsets, start, "right") - 1, crc, length


def features(column: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, row of each feature, bucket of each feature)."""
    raw, offsets = text_bytes(column)
    row, crc, length = words(LOWER[raw], offsets)
    rows, found = [row], [crc]
    if most > 1:
        gap = combine(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)
        run = crc
        for n in range(2, most + 1):
            run = combine(run[:-1], gap[n - 1 :], length[n - 1 :] + 1)
            ok = row[: len(run)] == row[n - 1 :]
            rows.append(row[: len(run)][ok])
            found.append(run[ok])
    return np.bincount(row, minlength=len(column)), np.concatenate(rows), np.concatenate(found).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts; what comes to the driver is ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in portions(batch, 0):
                total += np.bincount(features(b.column(0), most, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    session(texts)
    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(F.col(text_col).alias("__text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, each count one higher."""
    all_s, all_t = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(source))
    ratios = ((t + 1.0) * all_s / ((s + 1.0) * all_t) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight): the gains of a document's features added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, 1):
                n_words, row, bucket = features(b.column(1), most, len(gain))
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, row, gain[bucket])
                numbers = [n_words, np.bincount(row, minlength=b.num_rows), total]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in numbers)], [id_col, "n_words", "n_features", "weight"])

    session(docs)
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the given order, without one task that sees all of them.

    Rows are dealt to ranges of the order and stored with the number of their range; the
    numbers of rows in earlier ranges, one number a range, are what the driver reads.
    """
    dealt = stored(rows.repartitionByRange(max(8, -(-n // RANGE_ROWS)), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for k, count in sorted(dealt.groupBy("__range").count().collect()):
        offsets.append((k, before))
        before += count
    offset = rows.sparkSession.createDataFrame(offsets, "__range int, __before long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(offset), "__range").withColumn("rank", F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    most: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    least_words: int = 20,
    percent: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words, likelier ones like the target.

    Returns (id, n_features, weight, score, rank) for every row: ``score`` is the weight with
    Gumbel noise that depends on the seed and the id alone, and the highest scores are drawn
    without replacement, ties to smaller ids; ``rank`` is null where a row is not drawn.  Null
    texts count as empty; rows with equal ids are weighed and drawn each for itself, of equal
    scores and ids the heavier first; a null id is hashed as an empty one and comes last.  An
    empty target has counts of 0.
    """
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weights(docs, gain, most, id_col, text_col).withColumn("score", F.col("weight") + noise), "scores")
    enough = scored.filter(F.col("n_words") >= least_words)
    n = enough.count()
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.desc("weight"), F.desc("n_features")]
    drawn = ranked(enough, n, *order).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")
