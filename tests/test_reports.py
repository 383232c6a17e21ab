import json

import pytest

from reviewlake.operators import reports as op
from reviewlake.sources import external, reports

LCOV = "TN:\nSF:src/a.ts\nDA:1,5\nDA:2,0\nDA:2,3\nend_of_record\nDA:9,9\nSF:src/b.ts\nDA:4,0\nend_of_record\n"
ISTANBUL = json.dumps({"/r/src/a.ts": {"statementMap": {"0": {"start": {"line": 1}}, "1": {"start": {"line": 1}}, "2": {"start": {"line": 7}}}, "s": {"0": 0, "1": 4}}})
COBERTURA = '<coverage><class name="A" filename="src/a.py"><lines><line number="3" hits="0"/><line number="4" hits="2"/></lines></class></coverage>'
GO = "mode: set\npkg/a.go:3.2,5.10 2 0\npkg/a.go:5.2,5.9 1 7\nbad line\n"


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("lcov.info", LCOV, {("src/a.ts", 1, 5), ("src/a.ts", 2, 3), ("src/b.ts", 4, 0)}),
        ("c.json", ISTANBUL, {("src/a.ts", 1, 4), ("src/a.ts", 7, 0)}),
        ("c.xml", COBERTURA, {("src/a.py", 3, 0), ("src/a.py", 4, 2)}),
        ("cover.out", GO, {("pkg/a.go", 3, 0), ("pkg/a.go", 4, 0), ("pkg/a.go", 5, 7)}),
        ("c.json", "{broken", set()),
        ("x.txt", LCOV, set()),
    ],
)
def test_coverage_formats(spark, path, text, want):
    df = reports.normalized(reports.coverage(spark.createDataFrame([("r", text)], "report string, text string"), path), "/r")
    assert rows(df, "file", "line", "hits") == want


def added(spark, lines):
    return spark.createDataFrame([(p, 0, n, "x") for p, n in lines], "path string, file_ord int, line int, text string")


def test_uncovered_lines(spark):
    cov = spark.createDataFrame([("/ci/src/a.ts", n, h) for n, h in ((1, 0), (2, 0), (3, 4), (9, 0))], "file string, line int, hits bigint")
    f = op.coverage_findings(added(spark, [("src/a.ts", 1), ("src/a.ts", 2), ("src/a.ts", 3), ("other.ts", 1)]), cov, "lcov.info").first()
    assert "2/3" in f["message"] and "1–2" in f["message"] and f["severity"] == "low" and f["region"]["start_line"] == 1


def test_resolution_prefers_equal_then_smallest(spark):
    names = op.resolve_paths(spark.createDataFrame([("a/b.ts",), ("b.ts",)], "path string"), spark.createDataFrame([("z/a/b.ts",), ("a/b.ts",), ("xb.ts",)], "key string"))
    assert rows(names, "path", "key") == {("a/b.ts", "a/b.ts"), ("b.ts", "a/b.ts")}


def test_stale_files_are_skipped(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 1, 2), ("c", None, 1)], "path string, f int, r int")
    assert rows(op.fresh(df, "f", "r"), "path") == {("b",), ("c",)}


def test_mutants(spark):
    stryker = json.dumps({"files": {"src/a.ts": {"mutants": [{"status": "Survived", "mutatorName": "Arith", "replacement": "-" * 50, "location": {"start": {"line": 3}}}, {"status": "NoCoverage", "mutatorName": "B", "location": {"start": {"line": 4}}}, {"status": "Killed", "mutatorName": "K", "location": {"start": {"line": 3}}}]}}})
    got = reports.stryker(spark.createDataFrame([("r", stryker)], "report string, text string")).orderBy("line").collect()
    assert [(r["line"], r["no_coverage"]) for r in got] == [(3, False), (4, True)]
    assert got[0]["desc"].endswith("…")
    cargo = reports.cargo_mutants(spark.createDataFrame([("r", "src/l.rs:7:5: replace a with b\nsrc/m.rs:9: gone\nnoise\n")], "report string, text string"))
    assert rows(cargo, "file", "line", "desc") == {("src/l.rs", 7, "replace a with b"), ("src/m.rs", 9, "gone")}


def test_mutants_on_added_lines_are_capped(spark):
    m = spark.createDataFrame([("r", "a.ts", n, f"m{n}", False) for n in range(1, 9)], "report string, file string, line int, desc string, no_coverage boolean")
    f = op.mutation_findings(added(spark, [("a.ts", n) for n in range(1, 8)]), m).orderBy("region.start_line").collect()
    assert len(f) == 5 and "+2 more" in f[-1]["message"] and "more" not in f[0]["message"]


def test_external_defaults(spark):
    sarif = json.dumps({"runs": [{"results": [{"message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}}}]}, {"ruleId": "r", "level": "error", "locations": []}]}]})
    r = external.sarif(spark.createDataFrame([(sarif,)], "text string")).collect()
    assert [tuple(x) for x in r] == [("rule", "a.py", 1, "medium", "m")]
    osv = json.dumps({"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "V1"}, {}]}]}]})
    assert rows(external.osv(spark.createDataFrame([(osv,)], "text string")), "id", "ecosystem", "name", "version", "summary") == {("V1", "unknown", "p", "1", "Known vulnerability"), ("VULN", "unknown", "p", "1", "Known vulnerability")}
    assert external.ast_grep(spark.createDataFrame([('[{"file": "a", "range": {"start": {"line": 4}}}]',)], "text string")).first()["line"] == 5
    assert external.gitleaks(spark.createDataFrame([("nonsense",)], "text string")).count() == 0


def test_mutants_are_counted_by_line_and_only_the_first_lines_move(spark):
    """As ``capped`` over all hits: several reports, a report without a name, paths of one key, lines with many mutants."""
    m = spark.createDataFrame([(r, k, n, f"m{j:02d}", j % 2 == 0) for r in ("r", None) for k in ("a.ts", "x/b.ts", "dist/c.ts", "z.ts") for n in range(1, 5) for j in range(n if r else 7)], "report string, file string, line int, desc string, no_coverage boolean")
    lines = added(spark, [(p, n) for p in ("a.ts", "b.ts", "x/b.ts", "dist/c.ts", "q.ts") for n in (2, 3, 4)] * 2)
    f = op.mutation_findings(lines, m)
    keys = {"a.ts": "a.ts", "b.ts": "x/b.ts", "x/b.ts": "x/b.ts"}
    want = []
    for path, key in keys.items():
        for report in ("r", None):
            hit = sorted((r["line"], r["desc"], r["no_coverage"]) for r in m.filter(m.file == key).collect() if r["report"] == report and 2 <= r["line"] <= 4)
            want += [(path, n, d, "low" if c else "medium", f"(+{len(hit) - 5} more in this file)" if k == 4 else "") for k, (n, d, c) in enumerate(hit[:5])]
    got = [(r["file"], r["region"]["start_line"], r["anchor"]["detail"], r["severity"], r["message"].partition(r["anchor"]["detail"])[2].strip()) for r in f.collect()]
    assert sorted(got) == sorted(want)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "ShuffledHashJoin" in plan
