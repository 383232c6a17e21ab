import random
import re
import time

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import graph, intervals


def overlap(spans, hunks):
    return {(f, n) for f, n, a, b in spans for g, lo, hi in hunks if f == g and hi >= a and lo <= b}


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (1, 0), (5, 5), (3, 40), (1, 4095), (16, 31), (17, 2**31 - 1), (-40, 40), (255, 70_000)])
def test_cells_make_up_an_interval(spark, lo, hi):
    row = spark.range(1).select(intervals.cells_of_interval(F.lit(lo), F.lit(hi)).alias("c")).first()["c"]
    parts = sorted((c["cell"] << 4 * c["size"], (c["cell"] + 1 << 4 * c["size"]) - 1) for c in row)
    assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert (parts[0][0], parts[-1][1]) == (lo, hi) if lo <= hi else parts == []
    assert len(parts) <= 240


@pytest.mark.parametrize("crowded", [0, 5000, 10**7])
def test_touched_and_inside_as_by_comparison(spark, monkeypatch, crowded):
    monkeypatch.setattr(intervals, "CROWDED", crowded)
    rng = random.Random(8)
    spans = [(rng.choice("ab"), f"s{k}", a := rng.randrange(-50, 3000), a + rng.choice([-1, 0, 1, 7, 90, 2000])) for k in range(300)]
    points = [(rng.choice("abc"), rng.randrange(-60, 5000)) for _ in range(120)]
    s = spark.createDataFrame(spans + spans[:3], "file string, name string, start_line int, end_line int")
    p = spark.createDataFrame(points, "path string, line int")
    got = graph.touched(s, p).collect()
    want = [x for x in spans + spans[:3] if any(f == x[0] and x[2] <= at <= x[3] for f, at in points)]
    assert sorted(map(tuple, got)) == sorted(want)
    held = intervals.inside(p.withColumnRenamed("path", "file"), s, "file", "start_line", "end_line", "line").collect()
    assert sorted(map(tuple, held)) == sorted(q for q in points if any(f == q[0] and a <= q[1] <= b for f, _, a, b in spans))


@pytest.mark.parametrize("crowded", [0, 10**7])
def test_changed_exports_as_by_comparison(spark, monkeypatch, crowded):
    monkeypatch.setattr(intervals, "CROWDED", crowded)
    rng = random.Random(9)
    symbols = sorted({(rng.choice("ab"), rng.randrange(1, 2000)) for _ in range(120)})
    rows = [(f, f"n{k}", line) for k, (f, line) in enumerate(symbols)]
    nexts = [rows[k + 1][2] - 1 if k + 1 < len(rows) and rows[k + 1][0] == f else 2**31 - 1 for k, (f, _, _) in enumerate(rows)]
    hunks = [(rng.choice("abc"), lo := rng.randrange(1, 2500), lo + rng.choice([0, 1, 30])) for _ in range(40)] + [("a", 1900, 5000)]
    got = graph.changed_exports(spark.createDataFrame(rows, "file string, name string, line int"), spark.createDataFrame(hunks, "file string, lo int, hi int"))
    assert {tuple(r) for r in got.collect()} == overlap([(f, n, a, b) for (f, n, a), b in zip(rows, nexts, strict=True)], hunks)


def test_a_hot_file_spreads(spark):
    """Lines and spans of one file meet under many keys, none of which has more than a small part."""
    lines = spark.range(200_000).select(F.lit("hot").alias("path"), (F.col("id") * 3).cast("int").alias("line"))
    spans = spark.range(20_000).select(F.lit("hot").alias("file"), (F.col("id") * 31).cast("int").alias("start_line"), (F.col("id") * 31 + F.col("id") % 2).cast("int").alias("end_line"))
    cells = spans.select(F.explode(intervals.cells_of_interval(F.col("start_line"), F.col("end_line"))).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] <= 2
    began = time.monotonic()
    want = sum(any(x % 3 == 0 and x < 600_000 for x in range(k * 31, k * 31 + k % 2 + 1)) for k in range(20_000))
    assert graph.touched(spans, lines).count() == want
    assert time.monotonic() - began < 60


def reach(symbols, edges):
    out = {}
    for f, n in symbols:
        direct = {s for s, m, d in edges if d == f and m == n and s != f}
        far = {s for s, _, d in edges if d in direct} - {f} - direct
        if far:
            out[f, n] = len(far)
    return out


@pytest.mark.parametrize("hub", [0, 3, 10_000])
def test_hubs_are_maps(spark, hub):
    rng = random.Random(hub)
    files = [f"m{k}" for k in range(60)]
    edges = list({(rng.choice(files), rng.choice(["x", "y"]), rng.choice(files[:12])) for _ in range(400)})
    symbols = [(f, n) for f in files[:12] for n in ("x", "y")]
    e = spark.createDataFrame(edges, "src string, name string, dst string")
    direct = graph.direct_callers(spark.createDataFrame(symbols, "file string, name string"), e)
    assert {(r["file"], r["name"]): r["transitive"] for r in graph.transitive_callers(direct, e, hub).collect()} == reach(symbols, edges)


def test_caller_lists_are_short(spark):
    direct = spark.createDataFrame([("f", "n", f"c{k:05d}") for k in range(5000)], "file string, name string, caller string")
    assert graph.first_callers(direct.repartition(7), 12).first()["callers"] == [f"c{k:05d}" for k in range(12)]
    plan = graph.first_callers(direct, 12)._jdf.queryExecution().executedPlan().toString()
    assert {"Partial", "Final"} <= set(re.findall(r"WindowGroupLimit.*?(Partial|Final)", plan))  # before the shuffle and after it
