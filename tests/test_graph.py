import pytest

from reviewlake.analysis import tables
from reviewlake.operators import complexity, graph
from reviewlake.operators.inspect import Repository, inspect
from reviewlake.sources import scip

REPO = [
    ("src/auth.ts", "export function check(x) {\n  return x;\n}\nexport const A = 1;\n"),
    ("src/u1.ts", "import { check } from './auth';\n"),
    ("src/u2.ts", "import { check as c, A } from './auth.js';\n"),
    ("api/u3.ts", "import { check } from '../src/auth';\nexport function h() {}\n"),
    ("src/far.ts", "import { x } from './u1';\n"),
    ("other/auth.ts", "export function check() {}\n"),
    ("lib/index.ts", "export function lib() {}\n"),
    ("src/u4.ts", "import { lib } from '../lib';\n"),
]


@pytest.fixture(scope="module")
def repo(spark):
    return Repository.of(spark.createDataFrame(REPO, "path string, content string"))


def test_edges(repo):
    got = {tuple(r) for r in repo.edges.collect()}
    assert ("src/u1.ts", "check", "src/auth.ts") in got and ("src/u2.ts", "c", "src/auth.ts") in got
    assert ("src/u4.ts", "lib", "lib/index.ts") in got and not any(d == "other/auth.ts" for _, _, d in got)


def test_reach(repo):
    r = {(x["file"], x["name"]): x for x in graph.heuristic_reach(repo.symbols, repo.edges).collect()}
    own = r[("src/auth.ts", "check")]
    assert own["callers"] == ["api/u3.ts", "src/u1.ts"] and own["crosses"]
    assert own["transitive"] == 1  # src/far.ts; the alias c is no caller
    assert ("other/auth.ts", "check") not in r


@pytest.mark.parametrize("kind,target,key,want", [("definition", "check", "definitions", 2), ("callers", "check", "direct_callers", 0), ("exports", "src/auth.ts", "exports", 2), ("imports", "src/u2.ts", "imports", 1), ("complexity", "src/auth.ts", "max", 0)])
def test_inspect(repo, kind, target, key, want):
    got = inspect(repo, kind, target, "other/auth.ts")[key]
    assert (len(got) if isinstance(got, list) else got) == want


def test_inspect_blast_radius_and_missing(repo):
    assert inspect(repo, "blast_radius", "check", "src/auth.ts")["crosses_api_boundary"]
    assert inspect(repo, "definition", "nothing")["not_found"]
    with pytest.raises(ValueError):
        inspect(repo, "wish", "x")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(no, value):
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    return varint(no << 3 | 2) + varint(len(value)) + value


def index(occ):
    docs = {}
    for file, line, symbol, role in occ:
        docs.setdefault(file, []).append(field(1, varint(line - 1) + varint(0)) + field(2, symbol.encode()) + field(3, role))
    return b"".join(field(2, field(1, f.encode()) + b"".join(field(2, o) for o in os)) for f, os in docs.items())


OCC = [("a.ts", 3, "pkg/check().", 1), ("b.ts", 9, "pkg/check().", 0), ("c.ts", 2, "pkg/check().", 0), ("c.ts", 4, "pkg/check().", 0), ("a.ts", 8, "pkg/checker().", 1), ("a.ts", 1, "local 3", 1), ("d.ts", 5, "pkg/lonely#", 1)]


def test_scip_round_trip(spark):
    occ = scip.read(spark.createDataFrame([(bytearray(index(OCC)),), (bytearray(b"\xff\xff"),)], "content binary"))
    assert {tuple(r) for r in occ.collect()} == {(f, n, s, bool(r)) for f, n, s, r in OCC if not s.startswith("local")}
    sym = spark.createDataFrame([("a.ts", "check", 4), ("d.ts", "lonely", 5), ("a.ts", "che", 8)], "file string, name string, start_line int")
    got = {r["name"]: r for r in graph.precise_reach(sym, occ).collect()}
    assert got["check"]["callers"] == ["b.ts", "c.ts"] and got["check"]["total_refs"] == 3
    assert got["lonely"]["direct"] == 0 and "che" not in got
    edges = spark.createDataFrame([("x.ts", "lonely", "d.ts"), ("y.ts", "z", "e.ts")], "src string, name string, dst string")
    tiers = {r["name"]: r["method"] for r in graph.tiered_reach(sym.union(spark.createDataFrame([("e.ts", "z", 1)])), edges, occ).collect()}
    assert tiers["lonely"] == "scip" and tiers["z"].startswith("import graph")


def test_scip_file_in_many_tasks(spark, tmp_path):
    """Fields before, between and after documents, documents larger than a range, and a cut file."""
    rows = [(f"src/f{k}.ts", 1 + k % 300, f"pkg/s{k % 90}().", k % 2) for k in range(4000)]
    data = field(1, b"metadata " * 30) + index(rows) + field(3, b"external") + index([(f"big{k}.ts", 7, "pkg/" + "x" * 3000 + "#", 1) for k in range(40)])
    path = tmp_path / "index.scip"
    path.write_bytes(data)
    want = sorted(scip.occurrences(data))
    for split in (9000, 20_000, 1 << 24):
        got = scip.load(spark, str(path), split=split)
        assert sorted(map(tuple, got.collect())) == want
    assert scip.load(spark, str(path), split=20_000).rdd.getNumPartitions() > 10
    with path.open("rb") as f:
        for split in (1, 700, 20_000):
            spans = list(scip.ranges(f, len(data), split))
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert sorted(r for a, b in spans for r in scip.occurrences(data[a:b])) == want
    (tmp_path / "cut.scip").write_bytes(data[: len(data) - 100])
    cut = {tuple(r) for r in scip.load(spark, str(tmp_path / "cut.scip"), split=9000).collect()}
    assert cut < set(want) and len(cut) > 3000
    (tmp_path / "no.scip").write_bytes(b"\xff\xff")
    (tmp_path / "empty.scip").write_bytes(b"")
    assert scip.load(spark, str(tmp_path / "no.scip"), str(tmp_path / "empty.scip")).count() == 0


@pytest.mark.parametrize("head,base,want", [(30, None, "medium"), (15, None, "low"), (14, None, None), (15, 10, "low"), (31, 20, "medium"), (20, 4, "medium"), (12, 2, "low"), (16, 13, None)])
def test_classifier(spark, head, base, want):
    df = spark.createDataFrame([(head, base)], "h int, b int")
    assert df.select(complexity.classify(df.h, df.b).alias("x")).first()["x"] == want


def test_complexity_findings_compare_the_first_of_a_name(spark):
    body = "".join(f"{'  ' * k}if a{k}:\n" for k in range(1, 7)) + "  " * 7 + "pass\n"
    head = tables.functions(tables.parsed(spark.createDataFrame([("m.py", "def f():\n" + body)], "path string, content string")))
    base = spark.createDataFrame([("m.py", "f", 1, 2, 1), ("m.py", "f", 9, 9, 99)], "file string, name string, start_line int, end_line int, score int")
    added = spark.createDataFrame([("m.py", 0, 3, "x")], "path string, file_ord int, line int, text string")
    f = complexity.complexity_findings(head, base, added).collect()
    assert len(f) == 1 and f[0]["severity"] == "medium" and "was 1" in f[0]["message"]
    assert complexity.complexity_findings(head, base, added.filter("line > 50")).count() == 0


def test_an_import_goes_out_once(spark):
    """Imports stream past a table of the files: they are neither sorted for a join nor grouped."""
    files = spark.createDataFrame([("a/x.ts",), ("a/x.js",), ("a/y.js",), ("a/y/index.ts",), ("a/z.js.ts",)], "path string")
    imports = spark.createDataFrame([("a/m.ts", ["n", "k"], s) for s in ("./x.js", "./x", "./y.js", "./y", "./z.js", "../../a/./x.mjs", "./none")] + [("a/m.ts", None, "./y/"), ("m.ts", ["r"], "./a/y.js")], "file string, names array<string>, source string")
    edges = graph.import_edges(imports, files)
    found = {"a/x.ts", "a/y.js", "a/z.js.ts"}
    assert {tuple(r) for r in edges.collect()} == {("a/m.ts", n, f) for n in ("n", "k") for f in found} | {("a/m.ts", None, "a/y.js"), ("m.ts", "r", "a/y.js")}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan and "posexplode" not in plan


def test_hubs_are_counted_without_a_pass_over_all_pairs(spark):
    """Edges may repeat; repeats make neither callers nor hops more, whichever way a hub goes."""
    e = [("a", "f", "s"), ("b", "f", "s"), ("x", "g", "a"), ("x", "h", "a"), ("y", "g", "a"), ("b", "g", "a"), ("s", "g", "b")]
    edges = spark.createDataFrame(e + e, "src string, name string, dst string")
    direct = graph.direct_callers(spark.createDataFrame([("s", "f")], "file string, name string"), edges)
    assert sorted(r["caller"] for r in direct.collect()) == ["a", "b"]
    for hub in (1, 4, 100):
        assert [tuple(r) for r in graph.transitive_callers(direct, edges, hub).collect()] == [("s", "f", 2)]


def test_direct_callers_are_not_sorted_for_their_join(spark):
    edges = spark.range(9).selectExpr("concat('o', id) as src", "'f' as name", "concat('s', id % 3) as dst")
    plan = graph.direct_callers(spark.range(3).selectExpr("concat('s', id) as file", "'f' as name"), edges)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def tiers_of_two(spark):
    """The index knows s0, the import graph s1."""
    symbols = spark.createDataFrame([("s0", "f", 1), ("s1", "f", 1)], "file string, name string, start_line int")
    edges = spark.createDataFrame([("a", "f", "s0"), ("a", "f", "s1"), ("b", "f", "s1"), ("c", "g", "a"), ("c", "h", "a"), ("b", "g", "a"), ("s1", "g", "b")], "src string, name string, dst string")
    occ = spark.createDataFrame([("s0", 1, "pkg/f().", True), ("z", 4, "pkg/f().", False)], "file string, line int, symbol string, is_def boolean")
    return symbols, edges, occ


def test_the_import_graph_is_asked_for_what_the_index_does_not_know(spark, monkeypatch):
    asked, reach = [], graph.heuristic_reach
    monkeypatch.setattr(graph, "heuristic_reach", lambda symbols, *a: asked.extend(r["file"] for r in symbols.collect()) or reach(symbols, *a))
    got = {r["file"]: (r["callers"], r["direct"], r["transitive"], r["method"]) for r in graph.tiered_reach(*tiers_of_two(spark)).collect()}
    assert got == {"s0": (["z"], 1, 0, "scip"), "s1": (["a", "b"], 2, 1, "import graph (ts/js)")}
    assert asked == ["s1"]


def test_callers_that_nobody_asks_for_are_not_ranked(spark):
    symbols, edges, occ = tiers_of_two(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan(graph.tiered_reach(symbols, edges, occ)) and "Window" not in plan(graph.tiered_reach(symbols, edges, occ).drop("callers"))


def test_second_hops_need_no_join_back(spark):
    symbols, edges, _ = tiers_of_two(spark)
    far = graph.transitive_callers(graph.direct_callers(symbols, edges), edges)
    assert sorted(map(tuple, far.collect())) == [("s0", "f", 2), ("s1", "f", 1)]
    assert "LeftAnti" not in far._jdf.queryExecution().executedPlan().toString()
