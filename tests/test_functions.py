import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import hashing, paths, severity, text


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def fnv(data: bytes, bits: int) -> int:
    h, prime = {32: (0x811C9DC5, 0x01000193), 64: (0xCBF29CE484222325, 0x100000001B3)}[bits]
    for b in data:
        h = ((h ^ b) * prime) % (1 << bits)
    return h


@pytest.mark.parametrize("s", ["", "a", "hello world", "naïve 日本", "x" * 300])
def test_hashes(spark, s):
    assert one(spark, hashing.fnv1a32(F.col("s")), s=s) == fnv(s.encode(), 32)
    assert one(spark, hashing.hex16(hashing.fnv1a64(F.col("s"))), s=s) == f"{fnv(s.encode(), 64):016x}"


def test_fingerprint_separates_parts(spark):
    a = one(spark, hashing.fingerprint(F.lit("ab"), F.lit("c")), s="")
    b = one(spark, hashing.fingerprint(F.lit("a"), F.lit("bc")), s="")
    assert a != b and len(a) == 16


def test_entropy_and_snippets(spark):
    assert one(spark, text.shannon_entropy(F.col("s")), s="") == 0
    assert one(spark, text.shannon_entropy(F.col("s")), s="aaaa") == 0
    s = "aabbccdé"
    c = Counter(s.encode())
    n = sum(c.values())
    assert one(spark, text.shannon_entropy(F.col("s")), s=s) == pytest.approx(-sum(v / n * math.log2(v / n) for v in c.values()))
    assert one(spark, text.normalize_snippet(F.col("s")), s="  a \t b\n c ") == "a b c"
    assert one(spark, text.truncate(F.col("s"), 3), s="abcdef") == "abc…"
    assert text.wrap("aa bb cc", 5) == ["aa bb", "cc"]


def test_feature_hash(spark):
    v = one(spark, text.feature_hash(F.col("s")), s="Fix the login.bug")
    assert len(v) == 256 and math.isclose(sum(x * x for x in v), 1)
    assert set(one(spark, text.feature_hash(F.col("s")), s="!!")) == {0.0}
    assert one(spark, text.tokens(F.col("s")), s="Ab cdef") == ["w:ab", "w:cdef", "g:cde", "g:def"]
    assert one(spark, text.round3(F.col("x")), x=0.12345) == 0.123


def test_age_days(spark):
    now = F.lit("2026-06-09T00:00:00Z")
    assert one(spark, text.age_days(F.col("s"), now), s="2026-06-07T12:00:00Z") == 1.5
    assert one(spark, text.age_days(F.col("s"), now), s="nonsense") == 0


@pytest.mark.parametrize(
    "path,generated,lang",
    [("src/a.ts", False, "typescript"), ("dist/a.js", True, "javascript"), ("redist/a.py", True, "python"), ("Cargo.lock", True, "other"), ("a/B.TS", False, "other"), ("x.min.css", True, "other"), ("go.sum", True, "other"), ("lib/x.scala", False, "scala")],
)
def test_paths(spark, path, generated, lang):
    assert one(spark, paths.is_generated(F.col("p")), p=path) == generated
    assert one(spark, paths.language(F.col("p")), p=path) == lang


@pytest.mark.parametrize("glob,path,hit", [("generated/**", "generated/a/b.ts", True), ("**/*.pb.go", "proto/gen/user.pb.go", True), ("examples/keys.sample.env", "examples/keys.sample.env", True), ("src/*.ts", "src/a/b.ts", False), ("src/*.ts", "src/a.ts", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.glob_match(F.col("p"), glob), p=path) == hit


def test_severity(spark):
    assert one(spark, severity.parse(F.col("s")), s="HIGH") == "high"
    assert one(spark, severity.parse(F.col("s")), s="worst") is None
    assert one(spark, severity.rank(F.col("s")), s="critical") == 4
    assert one(spark, severity.tier(F.col("s")), s="medium") == "concern"
    assert one(spark, severity.from_level(F.col("s")), s="note") == "low"
    assert one(spark, severity.to_level(F.col("s")), s="info") == "note"


def test_memory_ids_take_utf16_units(spark):
    """Against a plain loop over code units; a null text leaves the kind alone."""

    def plain(s: str) -> str:
        raw, h = s.encode("utf-16-be"), 0x811C9DC5
        for k in range(0, len(raw), 2):
            h = ((h ^ (raw[k] << 8 | raw[k + 1])) * 0x01000193) & 0xFFFFFFFF
        return f"m_{h:08x}"

    texts = ["", "plain", "naïve — ça", "\u0000\u00ff\uffff", "😀 two units", "日本語\n\n", "x" * 5000 + "é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.memory_id(F.lit("note"), F.col("t")).alias("id")).collect()
    assert {r["t"]: r["id"] for r in got} == {t: plain(f"note\0{t}") for t in texts}


def test_paths_lose_one_head_each(spark):
    """Without patterns: blanks, back slashes, one ``./``, then the root, each at the start only."""
    names = [" ./r.x/a.ts", "r.x/./r.x/a", "././r.x/b", "rxx/a", ".\\r.x\\c.ts ", "r.x/r.x/d", "", "/", None, "a/"]
    df = spark.createDataFrame([(p,) for p in names], "p string")
    got = df.select(paths.relative(df.p, "r.x/").alias("a"), paths.basename(df.p).alias("b"))
    assert [r["a"] for r in got.collect()] == ["a.ts", "./r.x/a", "./r.x/b", "rxx/a", "c.ts", "r.x/d", "", "/", None, "a/"]
    assert [r["b"] for r in got.collect()] == ["a.ts", "a", "b", "a", ".\\r.x\\c.ts ", "d", "", "", None, ""]
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_words_are_hashed_side_by_side(spark, monkeypatch):
    """As the tokens of each text one by one, however words are cut into batches."""
    texts = ["", None, "!!", "a", "ab ab abc", "Deploys run on fridays; use pnpm/build:x_1.", "x" * 64, "y" * 65 + " abcd" * 3, "K Ōtā 日本 k", " ".join(f"w{k} v{k % 9}" for k in range(90)), "ab"]
    want = []
    for cells in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").orderBy("id").select(text.hashed_cells(F.coalesce("text", F.lit("")))).collect():
        sums = [0.0] * text.DIM
        for c in cells[0]:
            sums[c["idx"]] += c["sign"]
        want.append(sums)
    for side, most in ((1 << 14, 1 << 20), (3, 5)):
        monkeypatch.setattr(text, "SIDE_BY_SIDE", side)
        slices = text._slices
        monkeypatch.setattr(text, "_slices", lambda done, most=most, slices=slices: slices(done, most))
        assert text.hashed_sums(texts, len(texts)).tolist() == want
