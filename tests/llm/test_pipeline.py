import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import pii

from test_scoring_and_pii import TONGUES, speech
from test_scoring_and_pii import brute as base_spans
from test_search_and_dedup import components, edits, shingles

SHARED = "a line of boilerplate that stands in several documents of this corpus"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    body = lambda n: " ".join(word() for _ in range(n))
    base = body(200)
    rows = [(k, f"{body(60)}\n{SHARED}", "en") for k in range(30)]
    rows += [(100, base, "en"), (101, base + " tail", "en"), (102, base, None), (103, "12345 !!", "en"), (104, None, "en"), (105, "write to some.one@mail.example.org now " + body(30), "en")]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], DDL)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes], name
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert kept[0] == {r[0] for r in rows} - {103, 104}
    assert kept[1] == kept[0] - {102}  # an exact copy has no line of its own
    assert 101 in kept[1] and kept[2] == kept[1] - {101}
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert "[EMAIL]" in texts[105][0] and all(len(t) == n for t, n in texts.values())
    assert sum(SHARED in t for t, _ in texts.values()) == 1
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert length == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, (t, _) in texts.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def plain_pipeline(rows):
    """The pipeline in plain Python, over all pairs; every document of the fixture has a clear language or no letter."""
    docs = [(i, t) for i, t in rows if t is not None and any(map(str.isalpha, t))]
    clean = lambda s: b" ".join(s.encode().split()).decode()
    places = [(i, n, clean(s)) for i, t in docs if i is not None for n, s in enumerate(t.split("\n")) if clean(s)]
    names = sorted({s for *_, s in places})
    near = [(a, b) for a, b in itertools.combinations(names, 2) if abs(len(a) - len(b)) <= 2 and min(len(a), len(b)) >= 7 and edits(a, b) <= 2]
    group = components(names, near)
    first = {}
    for i, n, s in places:
        first[group[s]] = min(first.get(group[s], (i, n)), (i, n))
    gone = {(i, n) for i, n, s in places if first[group[s]] != (i, n)}
    cut = []
    for i, t in docs:
        left = "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone)
        if left.strip(" \t\n\r\v\f"):
            cut.append((i, left))
    sets = {}
    for i, t in cut:
        sets.setdefault(i, set()).update(shingles(t))
    known = [i for i in sets if i is not None]
    links = [(a, b) for a, b in itertools.combinations(known, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    stay = {i for i, c in components(known, links).items() if i == c}
    out = [(i, pii.mask(t)) for i, t in cut if i is None or i in stay]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for i, t in out:
        assert not base_spans(t)
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        at = p = 0
        while at < len(ids):
            end = at + ((len(ids) - at) % 1024 or 1024)
            pieces.append((str(i), p, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            at, p = end, p + 1
    return sorted(pieces)


def test_run_equals_plain_python(spark, tmp_path):
    rng = random.Random(17)
    line = lambda lang: speech(rng, TONGUES[lang], rng.randrange(6, 14))
    shared = [line("xx") for _ in range(4)]
    rows = []
    for k in range(70):
        lang = ("xx", "yy", "zz")[k % 3]
        own = [line(lang) for _ in range(rng.randrange(1, 8))]
        own += [s if rng.random() < 0.5 else s[:5] + "q" + s[6:] for s in rng.sample(shared, rng.randrange(3))]
        if k % 11 == 0:
            own.append(f"mail me{k}@mail.example.org or +1 555 123-45{k:02d}")
        rng.shuffle(own)
        rows.append((k, "\n".join(own), lang))
    words = "".join(speech(rng, TONGUES["yy"], 300)).split()
    for k in range(80, 90):  # near copies that no line tells: each breaks its lines elsewhere
        w = list(words)
        w[rng.randrange(300)] = f"neu{k}"
        cut = rng.randrange(40, 60)
        rows.append((k, "\n".join(" ".join(w[i : i + cut]) for i in range(0, 300, cut)), "yy"))
    rows += [(95, None, "xx"), (96, "12 34 !!", "xx"), (97, "", None), (98, " \n ", "zz"), (3, "la re mi fa la re mi", "xx"), (3, "la re mi fa la re mi", "xx"), (None, line("zz"), "zz"), (99, " ".join(line("zz") for _ in range(400)), "zz")]
    rows += [(k, f"mi {k * 7919}", "xx") for k in range(200, 300)]  # short ones, so that sequences run full of documents
    df = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DDL)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    doc = lambda x: "None" if x != x or x is None else str(int(x))
    have = sorted((doc(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == plain_pipeline([r[:2] for r in rows])
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (got.offset == ends - got.length).all() and ends.max() <= 1024
    assert got.groupby("sequence_id").size().max() == corpus_pipeline.SEQUENCE_DOCS  # the capacity binds


def test_stages_on_empty_and_clashing_tables(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, id long, gone string, lang_pred string, row string"
    df = spark.createDataFrame([(1, "la re mi", "xx", "s", 8, 0.5, 9, 9, "g", "p", "r"), (None, None, None, None, None, None, None, None, None, None, None)], names)
    for rows in (df, df.limit(0)):
        docs = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == df.columns, name
            path = str(tmp_path / f"{rows is df}{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (rows is df)
