import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.functions.text import feature_hash
from reviewlake.operators import components, memory, similarity


def table(spark, vectors, ddl="id long, vec array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], ddl)


def plain(x, y, least):
    wide = max(len(v) for v in (*x, *y) if v is not None)
    filled = [[None if v is None else np.pad(np.asarray(v, float), (0, wide - len(v))) for v in side] for side in (x, y)]
    return {(i, j) for i, a in enumerate(filled[0]) for j, b in enumerate(filled[1]) if a is not None and b is not None and a @ b >= least}


def finding_texts(n):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("load", "user", "cache", "index", "token", "render", "batch", "queue", "parse", "merge") for b in ("er", "Map", "List", "Key", "Path", "State")]
    rules = [" ".join([f"{kind}.{a}-{b}", *rng.sample(words, 9)]) for kind in ("hygiene", "correctness", "style", "sql") for a in words[:12:3] for b in words[1:16:4]]
    return [f"{rules[rng.randrange(len(rules))]} in src/{rng.choice(words)}/{rng.choice(words)}.ts" for _ in range(n)]


@pytest.fixture(scope="module")
def hashed(spark):
    df = spark.createDataFrame(list(enumerate(finding_texts(1500))), "id long, text string")
    return df.select("id", feature_hash(F.col("text")).alias("vec")).cache()


@pytest.mark.parametrize("least", [0.3, 0.82, 0.97])
@pytest.mark.parametrize("block", [8000, 40])
def test_hashed_texts_as_by_brute_force(hashed, monkeypatch, least, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rows = [(r["id"], np.array(r["vec"])) for r in hashed.collect()]
    x = np.array([v for _, v in sorted(rows, key=lambda r: r[0])])
    all_sims = x @ x.T
    got = similarity.similarity_pairs(hashed, hashed, least).toArrow().to_pandas()
    want = np.argwhere(all_sims >= least)
    assert not got.duplicated(["l", "r"]).any()
    assert set(zip(got["l"], got["r"], strict=True)) == set(map(tuple, want.tolist()))
    assert np.abs(got["sim"].to_numpy() - all_sims[got["l"], got["r"]]).max() < 1e-12


def test_few_pairs_are_multiplied(hashed):
    n = hashed.count()
    visited, whole = similarity.multiplied(hashed, hashed, 0.82).agg(F.sum("visited"), F.sum("multiplied")).first()
    assert whole < visited <= n * n and whole < 0.1 * n * n


@pytest.mark.parametrize("least", [-0.5, 0.0, 0.4, 3.0])
def test_odd_vectors(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 11)
    rng = np.random.default_rng(7)
    x = [rng.standard_normal(rng.integers(1, 6)).tolist() for _ in range(60)] + [[0.0] * 4, None, [1e-9, 2.0], [3.0] * 5, [3.0] * 5]
    y = [rng.standard_normal(rng.integers(1, 9)).tolist() for _ in range(50)] + [[0.0], None, [3.0] * 5]
    got = [(r["l"], r["r"]) for r in similarity.similarity_pairs(table(spark, x), table(spark, y), least).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(x, y, least)
    assert {r["id"] for r in similarity.alike(table(spark, x), table(spark, y), least).collect()} == {i for i, _ in got}


def test_empty_sides_and_kinds(spark):
    none, one = table(spark, []), table(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    assert similarity.similarity_pairs(none, one, 0.5).count() == similarity.similarity_pairs(one, none, 0.5).count() == similarity.similarity_pairs(none, none, 0.5).count() == 0
    kinds = one.withColumn("kind", F.when(F.col("id") == 2, "b").otherwise("a"))
    got = similarity.similarity_pairs(kinds, kinds, 0.5, by=("kind",)).collect()
    assert sorted((r["l"], r["r"]) for r in got) == [(0, 0), (1, 1), (2, 2)]


def test_components_as_by_a_plain_union(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(16)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = dict(components.spanning([e for e in edges if e[0] != e[1]]))
    want |= {r: r for r in want.values()}
    assert got == want


def test_a_hot_group_gives_no_pair_table(spark):
    rng = np.random.default_rng(3)
    hot = np.ones(32) + 0.01 * rng.standard_normal((3000, 32))
    rest = rng.standard_normal((500, 32))
    x = np.concatenate([hot, rest])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = similarity.near_forest(table(spark, x), 0.97).collect()
    assert len(edges) < 3 * len(x)
    got = dict(components.spanning([tuple(e) for e in edges]))
    near = np.argwhere(np.triu(x @ x.T >= 0.97, 1)).tolist()
    assert got == dict(components.spanning(list(map(tuple, near))))


def chain(n, dims=64, step=0.97):
    """Unit vectors along a curve: neighbours are near, others are not."""
    rng = np.random.default_rng(5)
    turn = rng.uniform(0.5, 1.5, dims // 2)
    turn *= np.sqrt(2 * (1 - step) / np.mean(turn**2)) * 0.97
    at = np.arange(n)[:, None] * turn
    return np.hstack([np.cos(at), np.sin(at)]) / np.sqrt(dims / 2)


def test_a_long_chain_is_settled_in_one_pass(spark):
    x = chain(10_000)
    near = x[:-1] * x[1:]
    assert (near.sum(axis=1) >= 0.97).all()
    gone = np.flatnonzero(memory.earlier_near(x, 0.97))
    kept: list[int] = []
    for k in range(400):  # the rule, row by row
        if not any(x[k] @ x[j] >= 0.97 for j in kept):
            kept.append(k)
    assert [k for k in range(400) if k not in kept] == gone[gone < 400].tolist()
    df = table(spark, x).withColumn("kind", F.lit("a"))
    began = time.monotonic()
    got = sorted(r["id"] for r in memory.later_copies(df).collect())
    assert time.monotonic() - began < 60
    assert got == gone.tolist() and 4000 < len(got) < 6000


def test_giant_components_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(memory, "GIANT_ROWS", 50)
    monkeypatch.setattr(memory, "GIANT_BLOCK", 64)
    x = np.concatenate([chain(400), chain(30)[::-1] * -1, np.tile([[1.0, *[0.001] * 63]], (40, 1)) + np.random.default_rng(1).standard_normal((40, 64)) * 0.001])
    df = table(spark, x).withColumn("kind", F.lit("a"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(r["id"] for r in memory.later_copies(df).collect()) == np.flatnonzero(memory.earlier_near(unit, 0.97)).tolist()


def test_kinds_are_apart(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.001]), (3, "a", [1.0, 0.002]), (4, "b", [2.0, 0.0]), (5, None, [1.0, 0.0]), (6, "a", [0.0, 0.0]), (7, "a", [0.0, 0.0]), (8, "a", [3.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<double>")
    assert sorted(r["id"] for r in memory.later_copies(df).collect()) == [3, 4, 8]
    assert math.isclose(memory.DUPLICATE, 0.97)


def test_a_row_is_sent_once_for_a_block(hashed):
    """Not once for each cell that it visits: the rows of near-duplicate searches filled the disk."""
    side = similarity._side(hashed, "vec", ())
    _, visiting, blocks, _ = similarity._dealt(side, side, 0.5)
    sent, cells = visiting.agg(F.count("*"), F.sum(F.size("cells"))).first()
    assert sent <= hashed.count() * blocks.blocks and cells > 4 * sent


def test_visitors_and_pairs_come_in_batches(spark, monkeypatch):
    for name, rows in (("BLOCK_ROWS", 20), ("VISITORS", 5), ("PAIRS", 7)):
        monkeypatch.setattr(similarity, name, rows)
    x = [[1.0, 0.01 * k] for k in range(70)]
    got = [(r["l"], r["r"]) for r in similarity.similarity_pairs(table(spark, x), table(spark, x), 0.9).collect()]
    assert len(got) == len(set(got)) == 70 * 70
    batches = []
    monkeypatch.setattr(similarity, "_met", lambda left, right, least, by, meet, ddl: batches.extend(meet(*[v for _ in "lr" for v in (similarity.pa.array(range(70)), np.array(x))], iter([(slice(0, 70), np.arange(70))]))))
    similarity.similarity_pairs(table(spark, x), table(spark, x), 0.9)
    assert sum(b.num_rows for b in batches) == 70 * 70 and max(b.num_rows for b in batches) <= 2 * 7


def prose(n, dims=256, seed=8):
    """Unit vectors as those of hashed prose: all near one direction, the shorter a text the further off, and some near copies."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(dims) + rng.gamma(2.0, 0.3, (n, 1)) * rng.standard_normal((n, dims))
    copies = rng.choice(n, n // 10, replace=False)
    x[copies] = x[rng.choice(n, n // 10)] + 0.15 * rng.standard_normal((n // 10, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_of_prose_are_settled_soon(spark):
    """Angles to leaders do not tell them apart: by those, this took 79 s on four cores, now about 20."""
    x = prose(20_000)
    df = memory.checkpoint(table(spark, x.tolist()).withColumn("kind", F.lit("a")))
    began = time.monotonic()
    got = sorted(r["id"] for r in memory.later_copies(df).collect())
    assert time.monotonic() - began < 50
    assert got == np.flatnonzero(memory.earlier_near(x, 0.97)).tolist() and 1000 < len(got) < 10_000


@pytest.mark.parametrize("rows", [400, 301, 97, 10_000])
def test_blocks_in_any_number_lose_no_near_copy(spark, monkeypatch, rows):
    for module, name, value in ((memory, "FIRST_ROWS", 5), (memory, "GIANT_ROWS", 150), (memory, "GIANT_BLOCK", 64), (similarity, "FEW_ROWS", min(rows, 64)), (similarity, "NEAR_ROWS", rows), (similarity, "VISITORS", 50), (similarity, "FITTED", 300)):
        monkeypatch.setattr(module, name, value)
    x = np.concatenate([prose(1200, 40), chain(300, 40), np.tile(prose(1, 40), (100, 1)), prose(40, 40)[:40] * 3.0])
    kinds = [f"k{k % 7 % 3}" if k % 50 else f"rare{k % 13}" for k in range(len(x))]
    order = np.random.default_rng(2).permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, kinds[i], x[i].tolist()) for i in order], "id long, kind string, vec array<double>")
    unit, want = x / np.linalg.norm(x, axis=1, keepdims=True), set()
    for kind in set(kinds):
        at = np.array([i for i, k in enumerate(kinds) if k == kind])
        want.update(at[memory.earlier_near(unit[at], 0.97)].tolist())
    assert {r["id"] for r in memory.later_copies(df).collect()} == want and len(want) > 100


def test_vectors_without_a_direction_are_near_to_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("nan"), 1.0]), (4, [1e200, 1e200]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, [0.0, -2.0]), (8, [-0.0, -2.0]), (9, None), (10, [])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("kind", F.lit("a"))
    assert sorted(r["id"] for r in memory.later_copies(df).collect()) == [3, 6, 8]
    assert memory.later_copies(df.limit(0)).count() == 0


def test_few_products_of_prose_are_whole():
    x = prose(3000)
    y = x @ similarity.turned(x)
    ahead = similarity.fronts(y)
    bound = ahead.astype(float) @ ahead.T.astype(float)
    assert (bound >= x @ x.T - 1e-5).all() and (bound >= 0.97).mean() < 0.1
    got = {p for i, j in similarity.near(y, y, (ahead, ahead), 0.97) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == set(map(tuple, np.argwhere(x @ x.T >= 0.97).tolist()))
