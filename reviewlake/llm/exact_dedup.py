"""Exact deduplication with a cuckoo-filter index of live digests.

The filter answers "surely new" from a few bits; a hit is verified against the full digests
held in the filter's own buckets.  Entries can be deleted, and a filter that runs full is
rebuilt at twice the size from the keys it has stored.  The index works twice: in each map
task, where it folds a task's copies into one row before the shuffle, and in each reduce
task over one slice of the digest space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, joined_by_size, session

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return and space.
SPACE = r"[\x20\x09-\x0D]+"
#: Digests that a map task's index holds at most: a full one goes out and a new one begins.
FOLD_KEYS = 200_000
#: Rows for each reduce task over a slice of the digest space.
SLICE_ROWS = 200_000


class CuckooIndex:
    """A cuckoo filter whose slots also hold the keys; key -> value of live entries only.

    ``bits`` of the key's hash are the fingerprint; a bucket has four slots; an entry sits in
    one of two buckets, of which each is found from the other and the fingerprint.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024, bits: int = 16):
        self.bits, self.live, self.resizes, self.false_hits = bits, 0, 0, 0
        self._new(buckets)

    def _new(self, buckets: int) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.prints: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.items: list[list[tuple[bytes, object]]] = [[] for _ in range(self.mask + 1)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:16].ljust(16, b"\0"), "little")
        f = (h & ((1 << self.bits) - 1)) or 1
        i = (h >> 64) & self.mask
        return f, i, (i ^ (f * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> tuple[int, int] | None:
        f, i, j = self._place(key)
        for b in (i, j):
            prints = self.prints[b]
            if f in prints:  # a filter hit: verify against the bucket's content
                for k, p in enumerate(prints):
                    if p == f and self.items[b][k][0] == key:
                        return b, k
                self.false_hits += 1
        return None

    def get(self, key: bytes):
        at = self._slot(key)
        return None if at is None else self.items[at[0]][at[1]][1]

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) is not None

    def put(self, key: bytes, value) -> bool:
        """Insert, or replace the value of a live key; whether the key was new."""
        at = self._slot(key)
        if at is not None:
            self.items[at[0]][at[1]] = (key, value)
            return False
        if (left := self._insert((key, value))) is not None:
            self._rebuild([*self.entries(), left])
        self.live += 1
        return True

    def _rebuild(self, entries: list) -> None:
        size = self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._new(size)
            if all(self._insert(e) is None for e in entries):
                return

    def _insert(self, entry: tuple) -> tuple | None:
        """None, or the entry left over when too many had to move."""
        f, i, j = self._place(entry[0])
        for b in (i, j):
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(f)
                self.items[b].append(entry)
                return None
        b = i
        for kick in range(self.KICKS):
            k = (kick * 7 + f) % self.SLOTS
            f, self.prints[b][k] = self.prints[b][k], f
            entry, self.items[b][k] = self.items[b][k], entry
            b = (b ^ (f * 0x5BD1E995)) & self.mask
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(f)
                self.items[b].append(entry)
                return None
        return entry

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at is None:
            return False
        b, k = at
        for rows in (self.prints[b], self.items[b]):
            rows[k] = rows[-1]
            rows.pop()
        self.live -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, object]]:
        for b in self.items:
            yield from b


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.entries())
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["digest", "keep_id", "group_size"])


def _fold(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(digest, keep, size) rows of one task folded to a row per digest, or per digest and ``most`` of them."""
    index = CuckooIndex()
    for b in batches:
        for key, keep, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            old = index.get(key)
            if old is not None:
                keep, size = (keep if old[0] is None or (keep is not None and keep < old[0]) else old[0]), size + old[1]
            index.put(key, (keep, size))
        if most and index.live >= most:
            yield from _rows(index)
            index = CuckooIndex()
    yield from _rows(index)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are after every run of ASCII white space became one space; null
    counts as empty.  The smallest id of a group stays.  Rows that repeat an id are rows of
    their own and count in group_size; all of them are kept if the id is the smallest.  Rows
    with a null id stay only if their group has no other.
    """
    session(df)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    keyed = checkpoint(df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")))
    schema = "digest binary, keep_id long, group_size long"
    n = keyed.count()
    folded = keyed.select("digest", "id", F.lit(1).cast("long")).mapInArrow(lambda batches: _fold(batches, FOLD_KEYS), schema)
    groups = folded.repartition(max(12, -(-n // SLICE_ROWS)), "digest").mapInArrow(_fold, schema).filter("group_size > 1")
    out = joined_by_size(keyed, checkpoint(groups), ["digest"], "group_size", n)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _maintain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply (digest, keep, size, op) rows of one slice; op 0: stored, 1: insert, 2: delete."""
    index, late = CuckooIndex(), []
    for b in batches:
        for key, keep, size, op in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if op == 2:
                late.append((key, size))
            else:
                old = index.get(key)
                index.put(key, (keep, size) if old is None else (min(keep, old[0]), size + old[1]))
    for key, size in late:
        if (old := index.get(key)) is not None:
            index.delete(key) if old[1] <= size else index.put(key, (old[0], old[1] - size))
    yield from _rows(index)


def maintain_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, parts: int = 32) -> DataFrame:
    """A stored index (digest, keep_id, group_size) after rows (id, digest) come and go.

    Inserts come first.  A deleted row lowers its digest's group_size, and the digest goes
    with its last row; keep_id stays the smallest id ever seen while the digest lives.  Rows
    to delete that are not in the index change nothing.
    """
    rows = index.select("digest", "keep_id", "group_size", F.lit(0).alias("op"))
    for df, op in ((inserts, 1), (deletes, 2)):
        got = df.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        rows = rows.unionByName(got.withColumn("op", F.lit(op)))
    return rows.repartition(parts, "digest").mapInArrow(_maintain, "digest binary, keep_id long, group_size long")
