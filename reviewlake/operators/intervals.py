"""Intervals and points that meet, by equality joins on cells.

A number line is cut in cells of 1, 16, 256, ... numbers.  An interval is the union of a few
cells, at most 30 of each size; a point lies in one cell of each size.  An interval holds a
point exactly if one of its cells is one of the point's, so the two meet by equality of key and
cell: a key (a file, say) with millions of points and intervals spreads over as many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: Bits that a cell's size grows by, and sizes: enough for 32-bit numbers.
BITS, SIZES = 4, 8
#: Pairs of an interval and a point under one key from which they meet by cells.
CROWDED = 10_000_000


def _level(k: int) -> Column:
    return F.lit(k).cast("int").alias("size")


def cells_of_point(at: Column) -> Column:
    """array<struct<size, cell>> of the cells that a number lies in."""
    at = at.cast("long")
    return F.array(*[F.struct(_level(k), F.shiftright(at, BITS * k).alias("cell")) for k in range(SIZES)])


def cells_of_interval(lo: Column, hi: Column) -> Column:
    """array<struct<size, cell>> of the fewest cells that make up the numbers lo to hi; none if lo > hi."""
    lo, until = lo.cast("long"), hi.cast("long") + 1
    right, left = (lambda x, n, f=f: F.call_function(f, x, n) for f in ("shiftright", "shiftleft"))
    one, none = F.lit(1).cast("long"), F.array().cast("array<bigint>")
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(none)
    ends = lambda bits: (right(lo + left(one, bits) - 1, bits), right(until, bits))

    def level(k: Column) -> Column:
        (a, z), (inner, outer) = ends(k * BITS), ends(k * BITS + BITS)
        up = lambda x: left(x, F.lit(BITS))
        # What larger cells hold is left to them.
        cells = F.when((k < SIZES - 1) & (inner < outer), F.concat(span(a, up(inner)), span(up(outer), z))).otherwise(span(a, z))
        return F.transform(F.coalesce(cells, none), lambda c: F.struct(k.alias("size"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), level))


def _crowded(spans: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Keys under which more than CROWDED pairs would meet."""
    n, m = (df.groupBy(key).agg(F.count("*").alias(c)) for df, c in ((spans, "n"), (points, "m")))
    return checkpoint(n.join(m, key).filter(F.col("n") * F.col("m") > CROWDED).select(key))


def _semi(rows: DataFrame, others: DataFrame, key: str, lo: str, hi: str, at: str) -> DataFrame:
    """Rows that meet one of the others under the same key, tested pair by pair."""
    a, b = rows.alias("a"), others.alias("b")
    side = {c: "a" if c in rows.columns else "b" for c in (lo, hi, at)}
    x, y, z = (F.col(f"{side[c]}.{c}") for c in (lo, hi, at))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (z >= x) & (z <= y), "left_semi")


def holding(spans: DataFrame, points: DataFrame, key: str, lo: str, hi: str, at: str) -> DataFrame:
    """The rows of ``spans`` (key, lo, hi, ...) that hold one of ``points`` (key, at) or more.

    The names ``lo``, ``hi`` and ``at`` differ.  Keys with few pairs are tested pair by pair, the others meet by cells.
    """
    points = points.select(key, at)
    hot = _crowded(spans, points, key)
    if hot.isEmpty():
        return _semi(spans, points, key, lo, hi, at)
    cold = _semi(spans.join(hot, key, "left_anti").select(*spans.columns), points, key, lo, hi, at)
    spans, points = (df.join(hot, key, "left_semi").select(*df.columns) for df in (spans, points))
    # Points next to each other share their larger cells, so there are hardly more cells than points.
    places = points.select(key, F.explode(cells_of_point(F.col(at))).alias("c")).select(key, "c.*").distinct()
    own = spans.select(key, lo, hi).distinct()
    cells = own.select(key, lo, hi, F.explode(cells_of_interval(F.col(lo), F.col(hi))).alias("c")).select(key, lo, hi, "c.*")
    hit = cells.join(places, [key, "size", "cell"], "left_semi").select(key, lo, hi).distinct()
    return cold.unionByName(spans.join(hit, [key, lo, hi], "left_semi").select(*spans.columns))


def inside(points: DataFrame, spans: DataFrame, key: str, lo: str, hi: str, at: str) -> DataFrame:
    """The rows of ``points`` (key, at, ...) that one of ``spans`` (key, lo, hi) or more holds; see ``holding``."""
    spans = spans.select(key, lo, hi)
    hot = _crowded(spans, points, key)
    if hot.isEmpty():
        return _semi(points, spans, key, lo, hi, at)
    cold = _semi(points.join(hot, key, "left_anti").select(*points.columns), spans, key, lo, hi, at)
    spans, points = (df.join(hot, key, "left_semi").select(*df.columns) for df in (spans, points))
    cells = spans.select(key, F.explode(cells_of_interval(F.col(lo), F.col(hi))).alias("c")).select(key, "c.*").distinct()
    own = points.select(key, at).distinct()
    places = own.select(key, at, F.explode(cells_of_point(F.col(at))).alias("c")).select(key, at, "c.*")
    hit = places.join(cells, [key, "size", "cell"], "left_semi").select(key, at).distinct()
    return cold.unionByName(points.join(hit, [key, at], "left_semi").select(*points.columns))
