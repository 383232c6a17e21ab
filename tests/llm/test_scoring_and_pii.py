import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import langid, pii, quality
from reviewlake.llm.queries import fold


def speech(rng, parts, n=60):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


TONGUES = {"xx": ["la", "re", "mi", "fa"], "yy": ["sch", "ung", "ich"], "zz": ["ção", "ñe", "ez"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for k in range(240):
        lang = rng.choice(list(TONGUES))
        rows.append((k, speech(rng, TONGUES[lang]), lang if k % 9 else None, lang))
    rows += [(900, None, "xx", ""), (901, "", "xx", ""), (902, "123 !!", "xx", ""), (903, speech(rng, TONGUES["yy"], 40_000), None, "yy")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_language(docs):
    model = langid.train(docs.filter(~fold(F.col("doc_id"), 4, 2)))
    got = langid.identify(docs, model, keep=("truth",)).collect()
    assert len(got) == 244 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {900, 901, 902}
    assert np.mean([r["lang_pred"] == r["truth"] for r in got if r["truth"]]) > 0.98
    assert langid.train(docs.filter("lang is null")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_presence_is_a_set_and_reads_the_whole_text():
    raw = np.frombuffer("abcabc".encode() + "abc".encode() + b"", np.uint8)
    rows = langid.presence(raw, np.array([0, 6, 9, 9]))
    assert set(np.unique(rows)) <= {0.0, 1.0} and rows[2].sum() == 0
    assert rows[0].sum() > rows[1].sum() and (rows[0] >= rows[1]).all()


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        good = rng.random() < 0.6
        t = speech(rng, TONGUES["xx"]) if good else "".join(rng.choice("#$%& a1") for _ in range(300))
        rows.append((k, t))
        labels.append((k, int(good)))
    rows += [(900, None), (901, ""), (902, "x" * 200_000)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(5, None), (6, 7)], "doc_id long, quality int")
    held = lambda key: fold(key, 3, 1)
    got = {r["doc_id"]: r for r in quality.quality(d, lab, held).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    out = [got[k]["predicted"] == y for k, y in labels if got[k]["held_out"]]
    assert len(out) > 50 and np.mean(out) > 0.97
    assert {r["score"] for r in quality.quality(d, lab.limit(0), held).collect()} == {0.5}
    assert quality.quality(d.limit(0), lab, held).count() == 0


def test_quality_equals_a_plain_discriminant(spark):
    """Class covariances, shrinkage and densities written out on the dense table."""
    rng = random.Random(4)
    docs = [(k, speech(rng, TONGUES["xx" if k % 3 else "zz"], rng.randrange(5, 90)) + "$#" * rng.randrange(9) * (k % 3 == 0)) for k in range(260)] + [(3, "again"), (3, "again"), (None, "x")]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 260, 2)] + [(4, 0), (None, 1)]
    held = lambda key: fold(key, 3, 1)
    d = spark.createDataFrame([(*r, 2) for r in docs], "doc_id long, text string, label int")
    lab = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, stats int")
    got = {(r["doc_id"], r["score"]) for r in quality.quality(d, lab, held).collect()}
    x = np.array([quality.statistics(t) for _, t in docs])
    out = {r["doc_id"] for r in d.filter(held(F.col("doc_id"))).collect()}
    rows = [(y, x[n]) for i, y in labels for n, (j, _) in enumerate(docs) if i == j and i is not None and i not in out]
    cls = [np.array([np.rint(v * quality.UNIT) / quality.UNIT for y, v in rows if y == c]) for c in (0, 1)]
    both = np.concatenate(cls)
    centre, scale = both.mean(axis=0), np.sqrt(np.maximum(both.var(axis=0), 1e-8))
    cov = [np.cov(((c - centre) / scale).T, bias=True) for c in cls]
    pooled = sum(len(c) * m for c, m in zip(cls, cov, strict=True)) / len(both)
    z, dens = (x - centre) / scale, []
    for c, m in zip(cls, cov, strict=True):
        s = 0.95 * (0.8 * m + 0.2 * pooled) + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(m))
        off = z - ((c - centre) / scale).mean(axis=0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-(dens[1] - dens[0] + np.log(len(cls[1]) / len(cls[0]))) / np.sqrt(quality.STATS)))
    assert len(out) > 50 and len(got) == len({(i, t) for i, t in docs})
    for (i, _), w in zip(docs, want, strict=True):
        assert min(abs(s - w) for j, s in got if j == i) < 1e-6


def test_language_equals_a_dense_ridge(spark):
    """Kernel, Nyström map and ridge regression written out on dense rows."""
    rng = np.random.default_rng(6)
    rows = (rng.random((90, langid.BUCKETS)) < np.where(np.arange(90) % 3 == 0, 0.02, 0.03)[:, None]).astype(np.float32)
    rows[np.arange(90) % 3 == 1, :200] = 1
    labels = [("b", "c", "a")[k % 3] for k in range(90)]
    m = langid.fit(rows, labels)
    pick = np.concatenate([[k for k in range(90) if labels[k] == c][: langid.LANDMARKS // 3] for c in "abc"])
    x = rows.astype(np.float64)
    kernel = lambda p, q: p @ q.T / np.sqrt(np.outer(p.sum(axis=1), q.sum(axis=1)))
    w, v = np.linalg.eigh(kernel(x[pick], x[pick]))
    keep = w > 1e-6 * w.max()
    z = kernel(x, x[pick]) @ v[:, keep] / np.sqrt(w[keep])
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    zc = z - z.mean(axis=0)
    beta = np.linalg.inv(zc.T @ zc + langid.RIDGE * 90 / 100 * np.eye(zc.shape[1])) @ zc.T @ (y - y.mean(axis=0))
    assert np.abs(m.scores(rows) - (zc @ beta + y.mean(axis=0))).max() < 1e-3


def test_every_part_of_a_long_text_teaches(spark):
    """A tongue that stands in one part of long texts only is learned from it, wherever the hash points."""
    rng = random.Random(12)
    long = lambda t: "".join(speech(rng, TONGUES[t if k == 3 else "zz"], 2 * langid.PART_BYTES)[: langid.PART_BYTES] for k in range(8))
    rows = [(k, long(t), t) for k, t in enumerate(["xx", "yy"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    test = spark.createDataFrame([(k, speech(rng, TONGUES[t]), t) for k, t in enumerate(["xx", "yy"] * 20)], "doc_id long, text string, truth string")
    got = langid.identify(test, model, keep=("truth",)).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in got) >= 38
    raw, offs = np.frombuffer("".join(t for _, t, _ in rows).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for _, t, _ in rows])
    marks = (np.random.default_rng(1).random((5, langid.BUCKETS)) < 0.1).astype(np.uint8)
    mean = langid.over_parts(raw, offs, 5, langid.kernel_with(marks))
    for k in (0, 31):  # by hand: the mean over eighths by their bytes
        own = raw[offs[k] : offs[k + 1]]
        many = -(-len(own) // langid.PART_BYTES)
        cut = [len(own) * j // many for j in range(many + 1)]
        parts = [langid.presence(own[a:z], np.array([0, z - a]))[0] for a, z in zip(cut, cut[1:])]
        want = sum((p @ marks.T) / np.sqrt(p.sum() * marks.sum(axis=1)) * (z - a) for p, a, z in zip(parts, cut, cut[1:])) / len(own)
        assert np.abs(mean[k] - want).max() < 1e-5


def test_language_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(k, speech(rng, TONGUES[t]), t) for k, t in enumerate(["xx", "yy"] * 40)] + [(500, speech(rng, TONGUES["zz"]), "zz"), (7, "la re", "xx"), (7, "la re", "xx"), (None, "sch ung", "yy"), (8, "²½³ 12", "xx"), (9, "ª", None)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    model = langid.train(df, rows=6)
    assert model.classes == ["xx", "yy", "zz"]  # a rare label is not missed
    got = langid.identify(df, langid.train(df)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 3
    assert {r["doc_id"]: r["lang_pred"] for r in got}[8] == "und" and {r["doc_id"]: r["lang_pred"] for r in got}[9] != "und"  # the second is a letter, category Lo
    twins = langid.fit(np.ones((4, langid.BUCKETS), np.float32), ["b", "a", "a", "b"])
    assert twins.classes[int(twins.scores(np.ones((1, langid.BUCKETS), np.float32)).argmax())] == "a"  # classes that tie: the first by name
    million = "".join(speech(rng, TONGUES["yy"], 4000) for _ in range(60))
    assert langid.identify(spark.createDataFrame([(1, million)], "doc_id long, text string"), langid.train(df)).first()["lang_pred"] == "yy"


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = list("0123456789") * 2 + list("  --..++@@ab.,()%") + ["1.2.3.4", "4111 1111 1111 1111", "+1 555 123-4567", "a@b.co", "é\n", "255.", "@"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        assert pii.listed(pii.spans(t), pii.BASE) == brute(t), t


def test_added_kinds_and_masks(spark):
    t = "See https://a.io/x?y=1, mail me@b.org. IBAN: DE89 3704 0044 0532 0130 00; lives at 12 Long Oak Street."
    found = pii.spans(t)
    text = lambda k: [t[a:b] for a, b in found[k]]
    assert text("url") == ["https://a.io/x?y=1"] and text("email") == ["me@b.org"] and text("address") == ["12 Long Oak Street"]
    assert text("account") and text("account")[0].startswith("DE89")
    assert pii.mask("a me@b.org z") == "a [EMAIL] z" and pii.mask("clean") == "clean"
    df = spark.createDataFrame([(1, t, "x"), (2, None, "y"), (3, "", "z"), (3, "plain", "z")], "doc_id long, text string, spans string")
    rows = {r["spans"]: r["text"] for r in pii.mask_pii(df).collect()}
    assert "me@b.org" not in rows["x"] and rows["y"] is None
    assert pii.find_pii(df).count() == 4 and pii.find_pii(df.limit(0)).count() == 0


def test_account_boundaries():
    text = lambda t: [t[a:b] for a, b in pii.spans(t)["account"]]
    good = "DE89 3704 0044 0532 0130 00"
    assert text(f"iBaN {good} 17 items") == [good]  # what follows is no part of a number whose check digits are right
    assert text("IBAN: GB82WEST12345698765432.") == ["GB82WEST12345698765432"]
    assert text("Account No. 00123456 is closed") == ["00123456"] and text("account manager") == []
    assert text("IBAN DE88 3704 0044 0532 0130 00") == ["DE88 3704 0044 0532 0130 00"]  # wrong, yet personal
    assert pii.lowered("İ KONTO") == "İ konto" and text("İ KoNtO 123456") == ["123456"]


def test_long_texts_and_clashing_names(spark):
    long = "x" * 300_000 + " a@b.co " + "1" * 200_000 + " +1 555 123-4567 " + "@" * 100_000
    df = spark.createDataFrame([(1, long, "q", 1), (1, "a@b.co", "q", 2), (None, None, "q", 3)], "doc_id long, text string, base string, n_email int")
    got = pii.find_pii(df).orderBy(F.length("base")).collect()
    assert [(r["doc_id"], r["n_email"], r["n_phone"], r["base"]) for r in got] == [(None, 0, 0, ""), (1, 1, 0, "email:0:6"), (1, 1, 1, "email:300001:300007,phone:500009:500024")]
    assert [len(r["text"] or "") for r in pii.mask_pii(df).orderBy("n_email").collect()] == [len(pii.mask(long)), 7, 0]
