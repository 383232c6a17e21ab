import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import chunked_bpe, packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "the", "ing", " quick", "é", "ß", "日本", "🙂", "́", "١", "1", "12", "<|endoftext|>", "<|end", " ", "\x1c", "!!", "..", "I'll", "x" * 60, "\r\n", " \n", "…", "ª", "²", "Σ", "İ", "Å"]


def texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_every_prefix_has_its_count(library):
    b = tokens.ByteBpe(BYTE)
    for t in texts(600):
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert b.at_every_prefix(t) == want, t
        assert sum(b.unit_counts(t)[1]) == want[-1]
        assert b.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
        for budget in (0, 1, 4):
            assert b.truncate(t, budget) == max(i for i, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "a", "é", "1", "\u00a0 ", "-="])
def test_long_runs_take_linear_time(library, run):
    b = tokens.ByteBpe(BYTE)
    t = "word" + run * (100_000 // len(run)) + "end"
    began = time.perf_counter()
    n = sum(b.unit_counts(t)[1])
    fit = b.truncate(t, n // 2)
    assert time.perf_counter() - began < 20
    assert n == len(library.encode(t, add_special_tokens=False).ids)
    assert len(library.encode(t[:fit], add_special_tokens=False).ids) <= n // 2 < len(library.encode(t[: fit + 1], add_special_tokens=False).ids)
    short = "x" + run * 90 + "<|endoftext|>" + run * 40
    assert b.at_every_prefix(short) == [len(library.encode(short[:i], add_special_tokens=False).ids) for i in range(len(short) + 1)]


def test_counts_do_not_depend_on_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 3)
    monkeypatch.setattr(tokens, "MEMO_PREFIXES", 5)
    monkeypatch.setattr(tokens, "MEMO_PAIRS", 2)
    b = tokens.ByteBpe(BYTE)
    for t in texts(150, 9):
        assert sum(b.unit_counts(t)[1]) == len(library.encode(t, add_special_tokens=False).ids)


def test_token_count_rows(spark, library):
    long = "word é " * 3000
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, "again"), (None, "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in tokens.token_counts(df, BYTE, 8).collect()]
    for (i, t), g in zip(rows, got, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert g[:4] == (i, len((t or "").encode()), n, n > 8)
        assert len(library.encode((t or "")[: g[4]], add_special_tokens=False).ids) <= 8
    assert tokens.token_counts(df.limit(0), BYTE).count() == 0


def by_chunks(c, t):
    raw = t.encode()
    at = chunked_bpe.cuts(np.frombuffer(raw, np.uint8))
    place = [0, *chunked_bpe.spaced([int(x) for x in at if x >= chunked_bpe.WINDOW], len(raw))]
    return np.frombuffer(c.document(c.chunk(raw[i:j]) for i, j in itertools.pairwise(place)), c.kind), len(place) - 1


@pytest.mark.parametrize("mean", [4, 64, 512])
def test_chunks_join_as_the_library_encodes(monkeypatch, mean):
    monkeypatch.setattr(chunked_bpe, "CHUNK_BYTES", mean)
    monkeypatch.setattr(chunked_bpe, "LEAST_BYTES", mean // 4)
    monkeypatch.setattr(chunked_bpe, "KEEP_WORDS", 50)
    tok, c = Tokenizer.from_file(WORD), chunked_bpe.ChunkedBpe(WORD)
    assert c.spaced and not chunked_bpe.ChunkedBpe(BYTE).spaced
    chunks = 0
    for t in texts(300, mean) + [" ".join(texts(40, k)) for k in range(10)] + ["", "x" * 5000, "word " * 4000, " " * 3000, "é" * 900]:
        want = tok.encode(t, add_special_tokens=False).ids
        got, n = by_chunks(c, t)
        chunks += n
        assert got.tolist() == want, t
        assert c.decode(got) == tok.decode(want, skip_special_tokens=False)
    assert chunks > 320


def test_a_join_that_does_not_agree_is_an_error():
    c = chunked_bpe.ChunkedBpe(WORD)
    ids, head, tail, head_n, tail_n = c.chunk(b"one two three four five six seven eight nine")
    wrong = (np.frombuffer(ids, c.kind)[::-1].tobytes(), head, tail, head_n, tail_n)
    with pytest.raises(ValueError):
        c.document(iter([wrong, wrong]))


def test_encode_decode_rows(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgé,'1") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    passage = prose(2500)
    rows = [(k, prose(rng.randrange(200)) + " " + passage * (k % 3) + prose(9)) for k in range(90)] + [(7, "x"), (7, "x"), (7, None), (None, "a b"), (None, "a b"), (95, ""), (96, "long text é " * 20_000), (97, "ß" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, ids int, decoded string").repartition(3)
    tok = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, tok.decode(ids, skip_special_tokens=False)))
    rows_of = lambda got: sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got.collect())
    assert rows_of(chunked_bpe.encode_decode(df, WORD)) == sorted(want)
    assert chunked_bpe.encode_decode(df.limit(0), WORD).count() == 0
    docs = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = chunked_bpe.shared_marks(docs)
    raws = [(t or "").encode() for _, t in rows]
    chunks = Counter(c for raw in raws for *_, own in chunked_bpe.chunks_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) for c in own)
    shared = {c for c, n in chunks.items() if n > 1}
    assert len(shared) > 3 and all(chunked_bpe.marked(marks, c) for c in shared) and sum(chunked_bpe.marked(marks, c) for c in chunks) <= len(shared) + 2
    moved = chunked_bpe.chunk_rows(docs, "bigint", spark.sparkContext.broadcast(marks)).groupBy("digest", "salt").agg(F.sum(F.size("ids")).alias("n"))
    assert moved.agg(F.sum("n").alias("n")).first()["n"] == sum(chunks[c] for c in shared)
    crowded = spark.sparkContext.broadcast(np.full(1, -1, np.int64).view(np.uint64))
    every = chunked_bpe.chunk_rows(docs, "bigint", crowded)  # a crowded map changes nothing but the way
    assert every.agg(F.sum(F.size("ids")).alias("n")).first()["n"] == sum(chunks.values())
    pieces = chunked_bpe.encoded_chunks(every.sortWithinPartitions("digest"), "bigint", WORD).repartition(2, "id", "name").sortWithinPartitions("id", "name", "place")
    assert rows_of(chunked_bpe.whole_texts(pieces, "bigint", WORD).withColumnRenamed("id", "doc_id")) == sorted(want)


def test_other_vocabularies_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts(40, 3))], "doc_id long, text string")
    tok = Tokenizer.from_file(BYTE)
    for r, t in zip(chunked_bpe.encode_decode(df, BYTE).collect(), texts(40, 3), strict=True):
        assert r["ids"] == tok.encode(t, add_special_tokens=False).ids
        assert r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False)


def test_pieces_and_packing(spark, library):
    rows = [(k, "some words here " * (k * 7 % 90)) for k in range(60)] + [(99, None), (100, "long text " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, BYTE, 256).toPandas()
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == k].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 256).all()
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (got.offset == ends - got.length).all() and ends.max() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "one"), (7, "two two"), (7, "one"), (8, "word " * 3000), (8, "word " * 3000), (9, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, sequence_id int")
    frames = [packing.pack_documents(df.repartition(k), BYTE, 64).toPandas().sort_values(["sequence_id", "offset"], ignore_index=True) for k in (1, 3)]
    assert frames[0].equals(frames[1])  # the same bins in whatever order rows come
    got = frames[0]
    assert got.doc_id.isna().sum() == 2 and (got.doc_id == 7).sum() == 3 and ((got.doc_id == 9) & (got.length == 1)).sum() == 1
    ends = got.groupby("sequence_id").length.cumsum()
    assert (got.offset == ends - got.length).all() and ends.max() <= 64


def reference_packing(lengths, caps, weights):
    """Vector best fit written out over all bins."""
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = (lengths[i], 1, lengths[i] ** 2)
        fits = [b for b, r in enumerate(bins) if all(x >= y for x, y in zip(r, need, strict=True))]
        score = lambda b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, bins[b], need, caps, strict=True))
        if fits:
            low = min(map(score, fits))
            best = next(b for b in fits if score(b) <= low * (1 + 1e-12))
        else:
            best = len(bins)
            bins.append(list(caps))
        out[i] = best
        bins[best] = [x - y for x, y in zip(bins[best], need, strict=True)]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("caps", [(1024, 1024, 1024**2), (100, 5, 2500), (100, 3, 10**4)])
def test_best_fit_equals_the_rule_written_out(caps):
    lengths = np.random.default_rng(3).integers(1, min(caps[0], int(caps[2] ** 0.5)) + 1, 300)
    bins, _ = packing.best_fit(lengths, *caps)
    assert bins.tolist() == reference_packing(lengths.tolist(), caps, (1.0, 0.02, 0.02))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 400)
    bins, offsets = packing.best_fit(lengths, 100, 5, 4000 + 100 * 100, rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 14000
        at = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[at]) - own[at] == offsets[bins == b][at]).all()
    tight, _ = packing.best_fit(np.full(10, 10), 100, 3, 10_000, rule)
    assert len(np.unique(tight)) == 4
    costly, _ = packing.best_fit(np.full(10, 10), 100, 99, 250, rule)
    assert len(np.unique(costly)) == 5
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 9, 10**6)
