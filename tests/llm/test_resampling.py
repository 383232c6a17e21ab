import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, most):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, most=1, buckets=10_000, seed="2024", least=20, percent=10):
    """Everything by strings and Python's own numbers; rows (id, n, weight, score, rank) in the order of docs."""

    def counts(texts):
        c = Counter()
        for t in texts:
            c.update(zlib.crc32(f.encode()) % buckets for f in runs(t, most)[1])
        return c, sum(c.values())

    (s, all_s), (t, all_t) = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = runs(text, most)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((k for k in range(len(out)) if out[k][4] >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, -out[k][2], -out[k][1]))
    rank = {k: r for r, k in enumerate(enough, 1) if r <= percent * len(enough) // 100}
    return [(*out[k][:4], rank.get(k)) for k in range(len(out))]


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_runs_from_words(most):
    rng = random.Random(5)
    bits = ["a", "Zeta", "É", "日本", " ", "  ", "-", "\n", "0", "9x", "w" * 70, "é" * 40, "`", "[", "\x7f"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [None, "", "one"]
    column = pa.array(texts)
    for col in (column, column.slice(7, 200), pa.array([], pa.string())):
        n, row, bucket = resampling.features(col, most, 1 << 32)
        got = [Counter(bucket[row == k].tolist()) for k in range(len(col))]
        want = [runs(t, most) for t in col.to_pylist()]
        assert n.tolist() == [a for a, _ in want]
        assert got == [Counter(zlib.crc32(x.encode()) for x in f) for _, f in want]


def test_crcs_join():
    rng = random.Random(1)
    a, b = [rng.randbytes(rng.randrange(0, 9)) for _ in range(200)], [rng.randbytes(rng.choice([0, 1, 5, 300, 70_000])) for _ in range(200)]
    crcs = [np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b)]
    got = resampling.combine(*crcs, np.array(list(map(len, b))))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 35), (3, 7, 100)])
def test_draw_against_plain(spark, monkeypatch, most, buckets, percent):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 9)
    rng = random.Random(most)
    vocab = ["the", "of", "Über", "data", "42", "naïve", "x"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (7, "the " * 30), (None, "of " * 25), (None, None), (900, None), (901, ""), (902, "- . !")]
    target = ["Über data of the world", None, "", "data data"]
    df = spark.createDataFrame([(*d, "x", 1.5) for d in docs], "doc_id long, text string, rank string, score double")
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets, percent=percent)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, most, buckets, percent=percent), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(docs, docs).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert tuple(resampling.resample(one, docs).first())[1] == 30


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, queries.op12_resampling(spark, sf).collect())) == sorted(plain(docs, target))
