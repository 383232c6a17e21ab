"""Vector best-fit packing of token sequences.

Documents become pieces of at most ``max_tokens`` tokens.  Pieces are dealt evenly, by a hash
of document and piece, into groups of a few thousand that are packed apart: a group wastes
at most its last bins, and neither a long document nor a hot source meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, session
from .tokens import bpe

#: Pieces in a group that is packed by itself.
GROUP_PIECES = 5000


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.02)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; pieces in order of falling length.

    A bin has three residual capacities: tokens, documents and attention cost (the sum of
    squared lengths).  Of the bins with room under all three, ``rule`` picks the one with the
    least weighted norm of what would remain ("norm") or the least weighted dot product of
    the piece's demand and the residual ("dot"), the oldest bin on ties; without such a bin a
    new one opens.  Each capacity counts in units of the whole.
    """
    n = len(lengths)
    order = np.lexsort((np.arange(n), -lengths))
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([max_tokens, max_docs, max_attention], np.float64)
    w = np.asarray(weights) / caps**2
    res = np.zeros((3, n), np.int64)
    ident = np.zeros(n, np.int64)  # open bins are kept dense at the front
    count = opened = 0
    least = int(lengths.min()) if n else 0
    for i in order.tolist():
        size = int(lengths[i])
        demand = (size, 1, size * size)
        if size > max_tokens or size * size > max_attention or max_docs < 1:
            raise ValueError("a piece exceeds the capacity of an empty bin")
        best = -1
        if count:
            r = res[:, :count]
            room = np.flatnonzero((r[0] >= size) & (r[1] >= 1) & (r[2] >= demand[2]))
            if len(room):
                left = r[:, room]
                if rule == "norm":
                    score = w[0] * (left[0] - size) ** 2.0 + w[1] * (left[1] - 1) ** 2.0 + w[2] * (left[2] - demand[2]) ** 2.0
                else:
                    score = w[0] * size * left[0] + w[1] * left[1] + w[2] * float(demand[2]) * left[2]
                low = np.flatnonzero(score == score.min())
                best = int(room[low[np.argmin(ident[room[low]])]])
        if best < 0:
            best, count = count, count + 1
            res[:, best], ident[best] = (max_tokens, max_docs, max_attention), opened
            opened += 1
        bins[i], offsets[i] = ident[best], max_tokens - res[0, best]
        res[:, best] -= np.array(demand)
        if res[0, best] < least or res[1, best] < 1:  # closed: the last open bin takes its place
            count -= 1
            res[:, best], ident[best] = res[:, count], ident[count]
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document's ids, followed by ``end_id``, are cut into pieces of ``max_tokens``; the first
    piece takes the odd rest.  Null texts count as empty; without ``end_id`` they have no piece.
    """
    session(df)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        b = bpe(tokenizer)
        for batch in batches:
            of, no, start, length, crc, held = [], [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = b.ids(t or "")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                ids = ids.astype("<u4", copy=False)
                at, p = 0, 0
                while at < len(ids):
                    end = at + ((len(ids) - at) % max_tokens or max_tokens)
                    part = ids[at:end]
                    of.append(k)
                    no.append(p)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        held.append(part.astype(np.int32))
                    at, p = end, p + 1
            cols = [batch.column(0).take(pa.array(of, pa.int32())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack(items: DataFrame, groups: int, keys: list[str], length_col: str = "length", max_tokens: int = 1024, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm") -> DataFrame:
    """Add sequence_id and offset to pieces, so that no sequence exceeds any capacity.

    Rows are dealt by a hash of all their columns; ties in length go by the keys and then by the
    other columns, so a rerun gives the same bins: rows that repeat in every column are
    interchangeable, and rows with null or repeated keys are rows like others.  By default
    documents and attention cost are bounded only as the tokens bound them.  Rows whose length
    is null take no part; an empty table gives an empty one.
    """
    docs, attention = max_docs or max_tokens, max_attention or max_tokens * max_tokens
    fields = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    flat = [c for c, t in items.dtypes if c not in keys and not t.startswith(("array", "map", "struct"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["__group"].iloc[0])
        pdf = pdf.drop(columns="__group").sort_values([*keys, *flat], kind="stable", ignore_index=True)
        bins, offsets = best_fit(pdf[length_col].to_numpy(np.int64), max_tokens, docs, attention, rule)
        return pdf.assign(sequence_id=(np.int64(group) << 32) + bins, offset=offsets)

    dealt = items.filter(F.col(length_col).isNotNull()).withColumn("__group", F.pmod(F.xxhash64(*keys, *flat), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``pieces`` and ``pack``.

    Documents that repeat an id, or have none, are packed each for itself.  Other columns than
    id and text are not read.  Groups are sized by the pieces there are, so that a table of
    long documents has more of them.
    """
    cut = checkpoint(pieces(df, tokenizer, max_tokens, end_id, id_col, text_col))
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    return pack(cut, groups, [id_col, "piece"], max_tokens=max_tokens, **limits)
