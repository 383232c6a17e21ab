"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint, ship


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for all but the smallest nodes of the pairs' own components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in pairs:
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: list[tuple[int, int]] = []
    for b in batches:
        pairs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if len(pairs) > 1 << 20:
            pairs = spanning(pairs)
    kept = spanning(pairs)
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs to (node, component), the component being its smallest node.

    Of a partition's edges first a star for each of its own components is kept; every round then
    links a node's larger neighbours, then its smaller ones, to the smallest; the rounds grow
    with the logarithm of the nodes.  A node without edges has no row, nor has an edge from a
    node to itself.
    """
    ship(edges.sparkSession)
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    e = checkpoint(e.mapInArrow(_reduce, "u long, v long").distinct())
    while True:
        # The smallest of a node and its neighbours takes over all that are larger than the node.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = checkpoint(small.union(parent.select("u", F.col("m").alias("v"))).distinct())
        rest = new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi")
        more = new.groupBy("u").count().filter("count > 1")
        e = new
        if rest.isEmpty() and more.isEmpty():  # only stars are left
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
