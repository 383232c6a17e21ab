import numpy as np
import pytest

from reviewlake.llm import queries, whitening


def plain(vectors, k=32, scale=64):
    """(x, n, covariance, eigenvalues, eigenvectors, exact deviations) by a dense decomposition."""
    x = np.floor(np.array(vectors, np.float64) * scale) + 1_000_000
    whole = [[int(v) for v in r] for r in x]
    n = len(whole)
    sums = [sum(c) for c in zip(*whole, strict=True)]
    deviations = [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in whole]
    c = np.array([[(n * v - s) / n for v, s in zip(r, sums, strict=True)] for r in whole])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    return c, v, e[::-1][:k], u[:, ::-1][:, :k], deviations


def compare(got, ids, vectors, k=32, atol=1e-7):
    c, v, e, u, deviations = plain(vectors, k)
    wide = len(e)
    assert len(got) == len(ids) * wide
    assert {r["n"] for r in got} == {len(ids)}
    at = {i: p for p, i in enumerate(ids)}
    w = np.zeros((len(ids), wide))
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[at[r["vec_id"]]]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-9
    want = c @ u / np.sqrt(e)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < atol


def rows(spark, vectors, ids=None):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], "vec_id long, embedding array<float>")


def test_low_rank_needs_no_expansion(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.integers(-9, 10, (80, 3)) @ rng.integers(-5, 6, (3, 40))  # whole numbers, so that flooring keeps the rank
    wide = []
    product = whitening.product
    monkeypatch.setattr(whitening, "product", lambda a, b, q: wide.append(q.shape[1]) or product(a, b, q))
    got = whitening.whiten(rows(spark, v), k=3, scale=1, oversample=4)
    c, _, e, u, _ = plain(v, 3, 1)
    w = np.array([r["whitened"] for r in sorted(got.collect(), key=lambda r: (r["vec_id"], r["component"]))]).reshape(80, 3)
    want = c @ u / np.sqrt(e)
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-7
    assert set(wide) <= {7, 3}


def test_flat_spectrum_expands_to_all_dimensions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((120, 24)).astype(np.float32)
    wide = []
    product = whitening.product
    monkeypatch.setattr(whitening, "product", lambda a, b, q: wide.append(q.shape[1]) or product(a, b, q))
    compare(whitening.whiten(rows(spark, v), k=6, oversample=2).collect(), list(range(120)), v, 6)
    assert wide == [8] * (1 + whitening.POWERS) + [24, 6]


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = [r.tolist() for r in rng.standard_normal((30, 5)).astype(np.float32)]
    nan, inf = float("nan"), float("inf")
    odd = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [nan, 1.0, 1.0, 1.0, 1.0]), (53, [1.0, -inf, 1.0, 1.0, 1.0]), (54, []), (55, [1.0, 2.0]), (56, [3e38] * 5)]
    rows = [*enumerate(v), *odd]
    df = spark.createDataFrame([(i, x, "c", 3) for i, x in rows], "vec_id long, embedding array<float>, component string, n int")
    compare(whitening.whiten(df).collect(), list(range(30)), v)
    twice = spark.createDataFrame([(None if i == 3 else i // 2, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = whitening.whiten(twice).collect()
    assert len(got) == 150 and sum(r["vec_id"] is None for r in got) == 5
    assert whitening.whiten(df.filter("vec_id >= 50 and vec_id <> 55")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0


def test_no_variance(spark):
    got = whitening.whiten(rows(spark, [[1.0, 2.0, 3.0]] * 4)).collect()
    assert len(got) == 12
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, 0.0, None)}
    line = whitening.whiten(rows(spark, [[1.0, 0.0], [3.0, 0.0]])).collect()
    assert sorted((r["component"], r["whitened"] and abs(r["whitened"]), r["explained"]) for r in line) == [(1, 1.0, 1.0)] * 2 + [(2, None, 0.0)] * 2


def test_large_entries_stay_exact(spark):
    v = [[4.0e9, 1.0], [-3.0e9, 2.0], [5.0e8, 7.0]]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows(spark, v)).collect()}
    assert got == {0: None, 1: None, 2: 704**2}  # the others are beyond a long
    at = whitening.Centre(3, [1 << 61, 5])
    assert at.moved(np.array([[1 << 60, 2]])).tolist() == [[3 * (1 << 60) - (1 << 61), 1]]


def test_query_against_a_dense_decomposition(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = queries.op13_whitening(spark, sf).collect()
    compare(got, [r["vec_id"] for r in table], [r["embedding"] for r in table])
