"""Queries reach every row and every character of their tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

from reviewlake import catalog, catalog_code
from reviewlake.operators import heuristics, similarity
from reviewlake.plans.review import Context


def save(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(str(folder / f"{name}.parquet"))


def test_whole_texts_are_hashed(spark, tmp_path):
    texts = ["ab " * 100 + "the Tail of a long text, twice: Tail", "", None]
    save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for k, t in enumerate(texts):
        for w in re.findall(r"[a-z0-9_.:/-]+", (t or "").lower()):
            for token in ["w:" + w, *("g:" + w[i : i + 3] for i in range(len(w) - 2))]:
                h = 0x811C9DC5
                for b in token.encode():
                    h = (h ^ b) * 0x01000193 % 2**32
                want.setdefault(k, Counter())[h // 2 % 256] += 1 if h % 2 else -1
    got = {(r["doc_id"], r["idx"]): r["v"] for r in catalog.feature_hash_cells(spark, str(tmp_path)).collect()}
    assert got == {(k, i): v for k, c in want.items() for i, v in c.items()}


def test_patches_hold_every_line(spark, tmp_path):
    save(spark, tmp_path, "documents", [(7, "\n".join(f"line {k}" for k in range(31)))], "doc_id long, text string")
    marks = ["-" if k % 4 == 3 else " " if k % 4 == 1 else "+" for k in range(31)]
    places = [8 + sum(m != "-" for m in marks[:k]) for k in range(31)]
    added = {(r["line"], r["text"]) for r in catalog.diff_parse_added(spark, str(tmp_path)).collect()}
    assert added == {(places[k], f"line {k}") for k in range(31) if marks[k] == "+"}
    files = catalog.diff_files(spark, str(tmp_path)).first()
    assert (files["added_count"], files["removed_count"]) == (marks.count("+"), marks.count("-"))
    assert {r["new_line"] for r in catalog.diff_anchor_index(spark, str(tmp_path)).collect()} == {places[k] for k in range(31) if marks[k] != "-"}


def test_findings_anchor_beyond_the_first_lines(spark, tmp_path):
    save(spark, tmp_path, "documents", [(0, "\n".join("abcdefghijklmnopqrstuvw"))], "doc_id long, text string")
    f = catalog.patches(spark, str(tmp_path)).select("patch_id").selectExpr("patch_id", "'d/0.txt' as file", "17 as line", "17 as end_line")
    assert catalog.anchors.anchor(f, catalog.unified_diff.anchor_index(catalog.patches(spark, str(tmp_path))), ["patch_id"]).first()["anchor_line"] == 17


def test_every_order_calls(spark, tmp_path):
    save(spark, tmp_path, "orders", [(k, 10 + k) for k in range(1, 9)], "o_orderkey long, o_custkey long")
    save(spark, tmp_path, "lineitem", [(k, 1) for k in range(1, 9)], "l_orderkey long, l_suppkey long")
    save(spark, tmp_path, "supplier", [(1,)], "s_suppkey long")
    direct = catalog.direct_callers(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, direct)) == [("s1", "f1", f"o{k}") for k in range(1, 9)]
    assert [tuple(r) for r in catalog.transitive_callers(spark, str(tmp_path)).collect()] == [("s1", "f1", 8)]


def test_vectors_of_any_ids_pair(spark, tmp_path):
    rows = [(k, [1.0, 0.0] if k < 4 else [0.0, 1.0], k % 2) for k in range(5)]
    save(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    pairs = catalog.similarity_join(spark, str(tmp_path)).collect()
    assert sorted((r["l"], r["r"]) for r in pairs) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    best = catalog.similarity_best(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, best)) == [(k, 1.0, 1.0) for k in range(4)]


def test_paths_of_all_parts_resolve(spark, tmp_path):
    save(spark, tmp_path, "part", [(k,) for k in range(1, 400)], "p_partkey long")
    paths = {r["path"] for r in catalog.part_paths(spark, str(tmp_path)).collect()}
    found = {r["path"]: r["key"] for r in catalog.path_suffix_resolve(spark, str(tmp_path)).collect()}
    assert found.keys() == paths and any(p.endswith("/package-lock.json") for p in found)
    assert all(k.endswith(p) or p.endswith(k) for p, k in found.items())


def test_near_copies_are_remembered_once(spark, tmp_path):
    base = " ".join(f"word{k} of{k * k}" for k in range(120))
    rows = [(1, "en", base), (2, "en", base + " more"), (3, "de", base + " more"), (4, "en", "quite another text"), (5, "en", base), (6, "en", "!!"), (7, "en", "??"), (8, "en", "!!")]
    save(spark, tmp_path, "documents", rows, "doc_id long, lang string, text string")
    assert sorted(r["id"] for r in catalog.memory_near_dup(spark, str(tmp_path)).collect()) == [1, 3, 4, 6, 7]


def test_a_row_is_near_only_to_rows_that_stayed(spark, monkeypatch):
    import math

    monkeypatch.setattr(similarity, "STRIP_ROWS", 7)
    turn = [(k, "a", [math.cos(k * 0.15), math.sin(k * 0.15)]) for k in range(30)]
    kept = []
    for k, _, v in turn:
        if all(v[0] * w[0] + v[1] * w[1] < 0.97 for _, w in kept):
            kept.append((k, v))
    df = spark.createDataFrame(turn, "id long, kind string, vec array<double>")
    assert {r["id"] for r in catalog.memory.later_copies(df).collect()} == set(range(30)) - {k for k, _ in kept}


def test_remember_compares_new_rows(spark):
    base = " ".join(f"word{k} of{k * k}" for k in range(120))
    new = spark.createDataFrame([("note", base, None, None), ("note", base + " more", None, None)], "kind string, text string, scope string, file string")
    assert catalog.memory.remember(spark.createDataFrame([], catalog.memory.MEMORY_DDL), new, "2026-06-09T00:00:00Z").count() == 1


def test_parsing_is_dealt_over_all_tasks(spark, tmp_path):
    """A part table of one file is read by one task; parsing takes as many as there are shuffle partitions."""
    rows = [(k, k % 50) for k in range(1, 201)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    parsed = catalog_code.tables.parsed(catalog_code.code_files(spark, str(tmp_path)))
    tasks = [r["count"] for r in parsed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_rules_are_dealt_over_all_tasks(spark):
    """A change of few bytes, read by one task and joined to its files by few."""
    added = spark.range(400).coalesce(1).selectExpr("concat('src/f', id % 40, '.ts') as path", "0 as file_ord", "cast(id as int) as line", "'console.log(a)' as text")
    files = added.select("path", F.lit(False).alias("is_deleted")).distinct()
    found = heuristics.run(Context(spark, files, added).reviewable())
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(tasks) == 400


def test_shipped_rules_deal_files_before_they_become_lines(spark):
    found = catalog_code.shipped_rules(spark, "/root/testdata/sf0.001")
    tasks = found.groupBy(F.spark_partition_id()).count().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
