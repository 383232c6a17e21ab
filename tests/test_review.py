import json
import os
import subprocess
import time

import pytest

from reviewlake.plans.review import COLLECTORS, Context, Simple, review
from reviewlake.plans import sinks
from reviewlake.plans.tools import Tools
from reviewlake.sources import git, stores

NOW = "2026-06-09T00:00:00Z"


def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def work_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run(root, "init", "-q")
    (root / "src").mkdir()
    (root / "src/a.ts").write_text("export function f(x) {\n  return x;\n}\n")
    for n in range(3):
        (root / f"src/u{n}.ts").write_text("import { f } from './a';\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "fix: first")
    (root / "src/a.ts").write_text("export function f(x) {\n  console.log(x);\n  return x;\n}\n")
    (root / "lcov.info").write_text("SF:src/a.ts\nDA:2,0\nend_of_record\n")
    return root


def test_review_end_to_end(spark, work_tree, tmp_path):
    tools = Tools(spark, str(work_tree), str(tmp_path))
    report, hidden = tools.review(NOW)
    rows = {r["rule_id"]: r for r in report.findings.collect()}
    assert "hygiene.debug-console" in rows and rows["hygiene.debug-console"]["region"]["start_line"] == 2
    assert rows["impact.blast-radius"]["blast_radius"]["direct_callers"] == 3
    assert hidden.count() == 0 and "heuristics" in report.collectors_run
    own = rows["hygiene.debug-console"]
    tools.dismiss(own["id"], NOW, own["rule_id"], "x")
    report, hidden = tools.review(NOW)
    assert own["id"] not in {r["id"] for r in report.findings.collect()} and hidden.count() == 1
    assert "Audit" in tools.report([r["id"] for r in report.findings.collect()])
    tools.note("use pnpm", NOW)
    assert tools.recall("pnpm").first()["text"] == "use pnpm"
    assert tools.inspect("callers", "f")["direct_callers"] == 3
    f = spark.createDataFrame([(own["id"], "nit", "src/a.ts", 2, None, "b")], "id string, tier string, file string, line int, end_line int, body string")
    assert tools.pr_review(f, "s").first()["comments"][0]["line"] == 2


def report(root, name, value):
    path = root / ".review/reports" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


@pytest.fixture
def own_tree(tmp_path):
    root = tmp_path / "own"
    (root / "src").mkdir(parents=True)
    run(root, "init", "-q")
    (root / "src/a.ts").write_text("export function f(x) {\n  return x;\n}\n\nexport function g(x) {\n  return x;\n}\n")
    (root / "package-lock.json").write_text("{}\n")
    (root / "src/u.ts").write_text("import { f } from './a';\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "first")
    (root / "src/a.ts").write_text("export function f(x) {\n  console.log(x);\n  return x;\n}\n\nexport function g(x) {\n  debugger;\n  return x;\n}\n")
    (root / "package-lock.json").write_text("{ }\n")
    return root


def test_reports_of_other_tools_give_findings(spark, own_tree, tmp_path):
    at = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    report(own_tree, "semgrep.sarif", {"runs": [{"results": [{"ruleId": "taint", "level": "error", "message": {"text": "m"}, "locations": [at(str(own_tree / "src/a.ts"), 2)]}, {"ruleId": "old", "locations": [at("src/a.ts", 3)]}]}]})
    report(own_tree, "gitleaks.json", [{"RuleID": "key", "Description": "d", "File": "src/a.ts", "StartLine": 1}])
    bad = lambda *ids: {"results": [{"packages": [{"package": {"name": "p", "ecosystem": "npm", "version": "1"}, "vulnerabilities": [{"id": i, "summary": "s"} for i in ids]}]}]}
    report(own_tree, "osv.json", bad("V-1", "V-2"))
    report(own_tree, "osv-base.json", bad("V-1"))
    tools = Tools(spark, str(own_tree), str(tmp_path / "home"))
    rows = {r["rule_id"]: r for r in tools.review(NOW)[0].findings.collect()}
    assert rows["semgrep.taint"]["severity"] == "high" and rows["gitleaks.key"]["file"] == "src/a.ts" and rows["supplychain.V-2"]["file"] == "package-lock.json"
    assert "semgrep.old" not in rows and "supplychain.V-1" not in rows  # not on an added line; known before
    assert not any(r.startswith("gitleaks") for r in {x["rule_id"] for x in tools.floor(git.Mode("base", "HEAD")).collect()})


@pytest.mark.parametrize("age,found", [(-3600, True), (3600, False)])
def test_stale_reports_say_nothing(spark, own_tree, tmp_path, age, found):
    (own_tree / "lcov.info").write_text("SF:src/a.ts\nDA:2,0\nend_of_record\n")
    (own_tree / "mutants.out").mkdir()
    (own_tree / "mutants.out/missed.txt").write_text("src/a.ts:2:3: replace f\n")
    now = time.time()
    os.utime(own_tree / "src/a.ts", (now + age, now + age))
    rules = {r["rule_id"] for r in Tools(spark, str(own_tree), str(tmp_path / "home")).floor().collect()}
    assert ("tests.uncovered-added-lines" in rules) == found == ("tests.surviving-mutant" in rules)


def test_audit_traces_changed_exports(spark, own_tree, tmp_path):
    tools = Tools(spark, str(own_tree), str(tmp_path / "home"))
    got, _ = tools.review(NOW)
    kept = [r["id"] for r in got.findings.collect()]
    assert "0/2 changed exports traced" in tools.report(kept)
    tools.inspect("callers", "f")
    text = tools.report(kept)
    assert "1/2 changed exports traced" in text and "never inspected: g (src/a.ts)" in text
    assert "no indexer" in tools.index()


def test_feedback_by_id_alone(spark, own_tree, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "learnings.json").write_text(json.dumps({"version": 1, "entries": [{"fingerprint": "z", "rule_id": "r", "text": "t", "signal": "dismissed", "scope": "finding", "at": NOW}]}))
    tools = Tools(spark, str(own_tree), str(home))
    assert tools.learnings().count() == 1  # an earlier tool's file
    rows = {r["rule_id"]: r["id"] for r in tools.floor().collect()}
    tools.dismiss(rows["hygiene.debug-console"], NOW)
    tools.accept(rows["hygiene.debugger-statement"], NOW)
    tools.dismiss("gone", NOW, rule_id="x.y")
    store = {r["fingerprint"]: r for r in tools.learnings().collect()}
    assert store[rows["hygiene.debug-console"]]["text"].startswith("hygiene.debug-console Debug console")
    assert store["gone"]["rule_id"] == "x.y" and store["gone"]["text"] == "" and "z" in store
    assert tools.recall("debugger statement").first()["kind"] == "accepted"
    got, hidden = tools.review(NOW)
    assert rows["hygiene.debug-console"] in {r["id"] for r in hidden.collect()}
    path = tmp_path / "report.json"
    path.write_text(sinks.report_json(got.findings, got.summary()))
    assert {r["id"] for r in stores.report(spark, str(path)).collect()} == {r["id"] for r in got.findings.collect()} and stores.report(spark, str(tmp_path / "none.json")).count() == 0


def test_modes(work_tree):
    assert "console.log" in git.diff_text(str(work_tree), git.Mode("working"))
    assert git.diff_text(str(work_tree), git.Mode("staged")) == ""
    assert "export function" in git.diff_text(str(work_tree), git.Mode("all"))
    assert git.changed_paths(str(work_tree), git.Mode("working")) == ["src/a.ts"]
    assert len(git.changed_paths(str(work_tree), git.Mode("all"))) == 4
    with pytest.raises(git.GitError):
        git.Mode("base", "--output=x").arguments()


def test_large_changes_rest_the_deep_collectors(spark):
    added = spark.range(30_001).selectExpr("'a.ts' as path", "0 as file_ord", "cast(id as int) as line", "'x' as text")
    files = spark.createDataFrame([("a.ts", 0, 1, False, False)], "path string, removed_count long, added_count long, is_new boolean, is_deleted boolean")
    called = []
    deep = Simple("deep", lambda c: called.append(1), deep=True)
    report = review(Context(spark, files, added), [*COLLECTORS[:2], deep])
    assert report.notes and not called and report.findings.count() == 0


def test_deleted_and_generated_files_are_left_out(spark):
    added = spark.createDataFrame([(p, 0, 1, "console.log(1)") for p in ("a.ts", "gone.ts", "dist/b.ts")], "path string, file_ord int, line int, text string")
    files = spark.createDataFrame([("a.ts", False), ("gone.ts", True), ("dist/b.ts", False)], "path string, is_deleted boolean")
    assert [r["file"] for r in review(Context(spark, files, added)).findings.collect()] == ["a.ts"]


def test_base_contents_by_one_process(tmp_path):
    """Names with blanks, line ends and words of git's own answers; folders and absent paths are null."""
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    files = {"a.txt": "one\n", "b c.txt": "no end", "dir/é.txt": "ü\n\nx", "empty": "", "new\nline.txt": "odd", "x blob 3": "abc"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    run("add", "-A")
    run("commit", "-qm", "x")
    names = [*files, "absent", "absent blob", "absent blob 5", "dir"]
    assert dict(git._blobs(str(tmp_path), "HEAD", names)) == {n: files.get(n) for n in names}
    assert not any(c for _, c in git._blobs(str(tmp_path), "nowhere", names))


def test_sarif_runs_make_findings_once(spark):
    """Counts, rules and results read what was kept, not what makes the findings."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(5).mapInArrow(seen, "id long")
    region = "named_struct('start_line', 1, 'start_col', 0, 'end_line', 1, 'end_col', 0) as region"
    f = rows.selectExpr("cast(id as string) as id", "'r' as rule_id", "'low' as severity", "'f' as file", "'m' as message", region)
    assert len(sinks.sarif_runs(f, rows_per_run=2).collect()) >= 1 and made.value == 5
