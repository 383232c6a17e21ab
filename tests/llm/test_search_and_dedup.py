import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import common, exact_dedup, jaccard, linededup, topk


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a not in parent:
            continue
        p, q = find(a), find(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "EDGES_AT_ONCE", at_once)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- top-k -------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for k in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [1.0, 0.5]), (204, []), (205, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk(df, df.filter("vec_id % 20 = 0"), 5, 8).collect()}
    ok = {k: np.pad(np.floor(np.array(v, float) * 8), (0, 6 - len(v))) for k, v in rows if v is not None and None not in v and not np.isnan(v).any()}
    want = {}
    for q in (k for k in ok if k % 20 == 0):
        best = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:5]
        want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert got == want
    assert topk.topk(df.limit(0), df, 5, 8).count() == 0
    assert topk.topk(df, df.limit(0), 5, 8).count() == 0
    assert topk.topk(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 5, 8).count() == 2


def test_topk_with_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [4.0, 0.0]), (2, [3.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [9.0, 9.0]), (None, [7.0, 7.0]), (4, [1e15, 1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = lambda q, k: [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.topk(df.filter("vec_id <> 4 or vec_id is null"), df.filter(q), k, 1).orderBy("query_id", "rank").collect()]
    assert got("vec_id = 0", 3) == [(0, 1, 3, 9), (0, 2, 1, 4), (0, 3, 2, 3)]  # a query that stands twice asks once
    assert got("vec_id = 0 or vec_id is null", 9) == [(0, 1, 3, 9), (0, 2, 1, 4), (0, 3, 2, 3), (0, 4, 3, 2), (0, 5, 3, 2)]  # a candidate that stands twice counts twice
    assert [r[2:] for r in got("vec_id = 3", 2)] == [(1, 36), (2, 27)]  # of a query's two vectors the better score counts
    wide = topk.topk(df, df.filter("vec_id = 4"), 1, 1).first()
    assert (wide["vec_id"], wide["score"]) == (3, 9 * 10**15 + 9)  # beyond 32 bits


# --- exact dedup ----------------------------------------------------------------------------


def test_cuckoo_index_against_a_dictionary():
    rng, index, model = random.Random(5), exact_dedup.CuckooIndex(2, bits=4), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(600)]
    for step in range(6000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.put(k, step) == (k not in model)
            model[k] = step
        else:
            assert index.delete(k) == (model.pop(k, None) is not None)
        assert (k in index) == (k in model)
    assert dict(index.entries()) == model and index.live == len(model) and index.resizes > 0 and index.false_hits > 0


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (2, None), (1, ""), (7, "x"), (7, "x"), (None, "a b"), (8, "a b")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(df).collect())
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in norm.items():
        low = min(i for i in ids if i is not None)
        want += [(str(i), low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_of_hot_groups_and_long_texts(spark, monkeypatch):
    rows = [(k, "copy of a third") for k in range(0, 900, 3)] + [(k, f"own {k % 250}") for k in range(900) if k % 3] + [(2000, "long  " * 200_000), (2001, "long " * 200_000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, group_size int, digest string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(" +", " ", t), []).append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()} == want  # 300 rows are a hot group
    folds = [b.to_pylist() for b in exact_dedup._fold(iter([pa.record_batch({"digest": [bytes([k % 7]) * 32], "id": [k], "n": [1]}) for k in range(30)]), 3)]
    assert len(folds) > 3 and sum(r["group_size"] for b in folds for r in b) == 30


def test_index_maintenance(spark):
    row = lambda *xs: [(bytearray([x]) * 32, i) for x, i in xs]
    frame = lambda rows: spark.createDataFrame(rows, "digest binary, id long")
    empty = spark.createDataFrame([], "digest binary, keep_id long, group_size long")
    one = exact_dedup.maintain_index(empty, frame(row((1, 5), (1, 3), (2, 9))), frame([]), 4)
    two = exact_dedup.maintain_index(one, frame(row((3, 1))), frame(row((1, 5), (2, 9), (9, 9))), 4)
    assert sorted((bytes(r["digest"])[0], r["keep_id"], r["group_size"]) for r in two.collect()) == [(1, 3, 1), (3, 1, 1)]


# --- shingle sets ----------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    docs = [None, "", " \n", "A b C d", "a B c D", "one", "ONE", "É x y z w", "é x y z w"]
    for n in (6, 9, 20, 80, 150):
        base = [word() for _ in range(n)]
        for _ in range(30):
            d = list(base)
            for _ in range(rng.randrange(0, max(2, n // 20))):
                i = rng.randrange(len(d))
                d[i : i + rng.randrange(2)] = [word()] * rng.randrange(2)
            docs.append(" ".join(d))
    docs += docs[20:60]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x " * 30000)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 1, 2), ("None", 2, None)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_of_ids_with_unlike_texts(spark):
    """Near copies, copies, empty texts and others under one id, against brute force over all rows."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(150)] for _ in range(12)]
    rows = [(1, "w" + " w".join(map(str, range(400)))), (2, "w" + " w".join(map(str, [*range(399), 7000]))), (2, " ".join(word() for _ in range(30)))]
    for k in range(90):
        i = rng.randrange(10, 50)
        d = list(base[rng.randrange(12)])
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            d[rng.randrange(len(d))] = word()
        rows.append((i, rng.choice([" ".join(d), " ".join(d), " ".join(d), "", None, " ".join(word() for _ in range(20))])))
    rows += [(None, " ".join(base[0])), (None, None), (-5, " ".join(base[1][:-1]))]
    sets = [shingles(t or "") for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[b][0] is not None and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = components({i: None for i, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, doc int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((i, len(s), want.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=key)
    assert want[2] == 1


def test_jaccard_around_a_hot_pivot(spark):
    """One text is near to several hundred others that are not all near to each other."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = [" ".join(base)]
    for _ in range(260):
        d = list(base)
        d[rng.randrange(120)] = word()
        docs.append(" ".join(d))
    rows = list(enumerate(docs))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, a int, component_id int")).collect()}
    assert got == components(sets, links)


# --- lines --------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != d))
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 90))) for _ in range(500)]
    b = []
    for s in a:
        x = list(s)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randrange(2)] = [rng.choice("abcé")] * rng.randrange(2)
        b.append("".join(x))
    assert linededup.edit_distances(a, b, tau).tolist() == [min(edits(x, y), tau + 1) for x, y in zip(a, b, strict=True)]


def test_line_classes_equal_brute_force(spark):
    rng = random.Random(4)
    base = "the quick brown fox jumps over the lazy dog near riverbank"
    lines = [base, base.upper(), "short", "x" * 24, ""]
    for _ in range(120):
        s = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        lines.append("".join(s))
    docs = [(k, f"{s}\nshort\n  {rng.choice(lines)}  ") for k, s in enumerate(lines)] + [(900, None), (901, "")]
    got = {(r["doc_id"], r["line_no"]): (r["class_id"], r["class_line_no"], r["class_size"], r["n_links"], r["kept"]) for r in linededup.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    places = [(i, n, s) for i, t in docs for n, s in enumerate(linededup.lines_of(t)) if len(s) >= linededup.MIN_CHARS]
    names = sorted({s for *_, s in places})
    links = [(a, b) for a, b in itertools.combinations(names, 2) if edits(a, b) <= linededup.TAU]
    group = components(names, links)
    want = {}
    for i, n, s in places:
        own = sorted((a, b) for a, b, x in places if group[x] == group[s])
        want[(i, n)] = (*own[0], len(own), sum(s in e for e in links), own[0] == (i, n))
    assert got == want


def test_lines_of_odd_tables(spark):
    hot = "a line that stands in every one of many documents, as licences do"
    long = "z" * 40_000
    rows = [(k, hot + f"\nown line {k * 7919} of its document") for k in range(150)] + [(200, long), (201, long[:-1] + "y"), (7, "x y z of the other seven\n" + hot), (None, hot), (202, None)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, class int, first string")
    got = linededup.near_lines(df).collect()
    assert len(got) == 150 * 2 + 2 + 2  # a null id takes no part
    size = {(r["doc_id"], r["line_no"]): (r["class_id"], r["class_size"]) for r in got}
    assert size[(100, 0)] == (0, 151) and size[(201, 0)] == (200, 2) and sum(r["kept"] and r["class_size"] == 151 for r in got) == 1
    left = linededup.drop_lines(spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, id int, gone string, `left` int"))
    texts = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert left.columns == ["doc_id", "text", "id", "gone", "left"] and (None, hot) in texts and (202, None) in texts and (200, long) in texts and not any(i == 201 for i, _ in texts)


def test_drop_lines(spark):
    line = "this very line is in many of the documents"
    df = spark.createDataFrame([(1, line + "\nown words of one"), (2, line.replace("very", "vary")), (3, "short\n" + line), (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.drop_lines(df).collect()} == {1: line + "\nown words of one", 3: "short", 4: None, 5: ""}
    assert linededup.drop_lines(df.limit(0)).count() == 0
