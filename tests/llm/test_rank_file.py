import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reviewlake.llm import queries, rankfile

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["a", "Zq", "the ", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'LL", "é", "ß", "日本", "🙂", "́", "١", "1", "12", "²", "!!", "..", "\x1c", "\x85", " ", " ", "　", "᠎", "<|endoftext|>", "-=", "_", "ª"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])
def test_safe_places_change_no_id(path, monkeypatch):
    v = rankfile.RankFile(path, PATTERN)
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 25)))
        want = v.engine.encode_ordinary(t)
        monkeypatch.setattr(rankfile.parts, "__defaults__", (rng.choice([1, 2, 3, 7]),))
        assert "".join(rankfile.parts(t)) == t
        got = v.ids(t)
        assert got.tolist() == want, t
        assert v.decode(got) == t.encode() == v.engine.decode_bytes(want)


@pytest.mark.parametrize("run", ["a", " ", "\n", "é", "0", ".", "日", "a1", "word ", "'s"])
def test_very_long_texts(library, run):
    text = "x" + run * (600_000 // len(run)) + "y"
    began = time.perf_counter()
    v = rankfile.rank_file(PATH, PATTERN)
    got = v.ids(text)
    assert v.decode(got) == text.encode()
    assert time.perf_counter() - began < 20
    assert got.tolist() == library.encode_ordinary(text)


def test_ids_that_end_inside_a_character(library):
    v = rankfile.rank_file(PATH, PATTERN)
    ids = v.ids("日本🙂")
    for n in range(len(ids)):
        assert v.decode(ids[:n]) == library.decode_bytes(ids[:n].tolist())
    assert v.decode(np.array([50256], "<u4")) is None
    assert v.decode(np.array([1 << 31], "<u4")) is None


def test_rows(spark, library):
    rows = [(1, "hello world"), (1, "twice"), (2, None), (None, ""), (3, " it's <|endoftext|> \n\n 12" * 9000)]
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = rankfile.encode_decode(df, PATH, PATTERN).collect()
    for (i, t), g in zip(rows, got, strict=True):
        want = library.encode_ordinary(t or "")
        assert (g["doc_id"], g["n_tokens"]) == (i, len(want))
        assert np.frombuffer(g["ids"], "<u4").tolist() == want
        assert bytes(g["decoded"]) == (t or "").encode()
    apart = rankfile.decode(rankfile.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r["decoded"]) for r in apart] == [(t or "").encode() for _, t in rows]
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"\1\0\0")), (3, bytearray(b"\xff" * 4))], "doc_id long, ids binary")
    assert [r["decoded"] for r in rankfile.decode(odd, PATH, PATTERN).collect()] == [b"", None, None]
    assert rankfile.encode_decode(df.limit(0), PATH, PATTERN).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_rank_file(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
