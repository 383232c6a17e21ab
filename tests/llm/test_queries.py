"""The registered queries themselves, on the smallest tables: digests, folds, places and parameters."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from reviewlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.QUERIES) < set(names) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_op2(spark, docs):
    t = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_and_op4(spark, docs):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op3_langid(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]])) for r in got)
    asked = [r for r in got if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in asked]) > 0.9
    got = queries.op4_quality(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def plain_spans(text):
    """(kind, start, end) of the four base kinds, from their patterns."""
    ascii_digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(ascii_digits(s)) <= 19 and luhn(ascii_digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(ascii_digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_op5(spark, docs):
    for r in queries.op5_pii(spark, SF).collect():
        want = plain_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        base = [f"{k}:{a}:{z}" for k, a, z in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op6(spark, docs):
    t = library("byte_bpe_50k.json")
    ids = {i: np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4") for i, text in docs.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, SF).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(ids[i][start : start + length].tobytes())
            assert length == 1024 or k == 0 or len(own) == 1
            at += length
        assert at == len(ids[i]) and (len(own) == 1) == (at <= 1024)
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= 1024
    assert len(places) <= 1.1 * sum(map(len, ids.values())) / 1024 + 2


def test_op7(spark, docs):
    lines = {(i, k) for i, text in docs.items() for k, s in enumerate(re.split("\n", text)) if s.strip()}
    got = queries.op7_line_dedup(spark, SF).collect()
    assert len({(r["doc_id"], r["line_no"]) for r in got}) == len(got)
    assert {i for i, _ in lines} >= {r["doc_id"] for r in got}
    size = defaultdict(int)
    for r in got:
        size[r["class_id"], r["class_line_no"]] += 1
    assert all(r["class_size"] == size[r["class_id"], r["class_line_no"]] for r in got)
    assert sum(r["kept"] for r in got) == len(size)


def test_op8(spark, docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in docs.items()}
    least = {i: i for i in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b])]
    for _ in docs:  # until nothing moves
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard(spark, SF).collect()} == {i: (len(sets[i]), least[i]) for i in docs}


def test_op10(spark, docs):
    t = library("byte_bpe_50k.json")
    for r in queries.op10_token_counts(spark, SF).collect():
        text = docs[r["doc_id"]]
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_op10_odd_tables(spark):
    from reviewlake.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(None, "a", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z")], "doc_id long, text string, n_tokens int, fit_chars string")
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in tokens.token_counts(df, path).collect()) == [(False, 0), (False, 0), (True, 1)]
    assert tokens.token_counts(df.limit(0), path).count() == 0
