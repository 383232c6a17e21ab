"""What the operators share: checkpoints, sizing, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint, shared_folder, ship

#: Edges whose components one task finds by itself; more go through the rounds of stars.
EDGES_AT_ONCE = 400_000
#: Ids that are broadcast to filter a scan; more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Rows in one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of ids, broadcast only while it is small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "id", how)


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``keys``, where a group may hold a third of all rows.

    ``size`` is the number of rows of a group.  Groups of more than ``total`` / 10 000 rows (at
    least 100) are at most 10 000, a proven bound, and are broadcast; rows of the others meet
    their groups in a shuffle, in which no key has more than that.
    """
    limit = max(100, total // 10_000)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) <= limit), keys, "left")
    return rows.join(hot, keys).unionByName(cold)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, which costs no job; where it has none, the bytes of all strings."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    strings = [F.octet_length(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"]
    total = sum((F.coalesce(x, F.lit(0)) for x in strings), F.lit(16))
    return int(df.agg(F.sum(total)).first()[0] or 0)


def tasks_for(df: DataFrame, mb: float, least: int = 12) -> int:
    """Number of partitions that gives each about ``mb`` MB of the input."""
    return max(least, -(-input_bytes(df) // int(mb * 1e6)))


def per_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: Callable[[list], list[pa.Array]],
    schema: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Apply ``fn(texts) -> arrays`` to Arrow batches; ids and ``keep`` columns pass through."""
    session(df)
    names = [c.split()[0] for c in schema.split(",")]
    types = dict(df.dtypes)
    lead = [F.col(id_col)] + [F.col(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + out, [id_col, *keep, *names])

    full = ", ".join(f"`{c}` {types[c]}" for c in (id_col, *keep))
    return df.select(*lead, F.col(text_col).alias("__text")).mapInArrow(run, f"{full}, {schema}")


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by a spanning star of each of its own components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds over the edge table: each round is two keyed
    aggregations with map-side partials, so no component is gathered in one task.  A
    partition's own edges are first reduced to a spanning forest; if few edges are left of
    all, one task finishes them the same way.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(_local_forest, "u long, v long").distinct()
    e = checkpoint(e)
    if e.count() <= EDGES_AT_ONCE:  # few enough for one task's memory
        e = checkpoint(e.repartition(1).mapInArrow(_local_forest, "u long, v long"))
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    before = mark(e)
    while before[0]:
        e = checkpoint(star(star(e, True), False))
        after = mark(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# --- 64-bit hashing in numpy -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its row offsets (nulls are empty rows), without copying."""
    if pa.types.is_large_string(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, kind, len(column) + 1, column.offset * width).astype(np.int64) if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def portions(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts exceed ``most`` bytes, so that long texts do not meet."""
    _, offs = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
