from reviewlake.operators import audit
from reviewlake.sources import contract


def test_directives(tmp_path):
    (tmp_path / "REVIEW.md").write_text("# Rules\n- console.log is fine.\n- mute: hygiene.debug-console\nskip: generated/**\n")
    c = contract.load(str(tmp_path), str(tmp_path / "nobody"))
    assert c.source == "repo" and c.muted_rules == ["hygiene.debug-console"] and c.skip_paths == ["generated/**"] and "console.log is fine" in c.raw


def test_user_level_and_none(tmp_path):
    home = tmp_path / "home" / ".review"
    home.mkdir(parents=True)
    (home / "REVIEW.md").write_text("skip: vendored/**")
    c = contract.load(str(tmp_path), str(tmp_path / "home"))
    assert c.source == "user" and c.skip_paths == ["vendored/**"]
    assert contract.load(str(tmp_path), str(tmp_path / "x")) == contract.Contract()


def test_policy_drops_with_a_reason(spark):
    c = contract.Contract("", ["hygiene.debug-console"], ["generated/**"], "repo")
    f = spark.createDataFrame([("a", "hygiene.debug-console", "src/x.ts"), ("b", "s", "generated/db.ts"), ("c", "s", "src/x.ts")], "id string, rule_id string, file string")
    got = {r["id"]: r["reason"] for r in contract.policy(f, c).collect()}
    assert got["c"] is None and "muted" in got["a"] and "skipped" in got["b"]


def ledger(spark, rows):
    return spark.createDataFrame([("r", k, *x) for k, x in enumerate(rows)], "repo string, seq long, event string, key string, value string")


BASE = [("floor", "old", None), ("start", None, None), ("floor", "f1", None), ("floor", "f2", None), ("symbol", "foo", "a.ts"), ("symbol", "bar", "a.ts"), ("inspect", "foo", "callers"), ("inspect", "bar", "definition")]


def test_audit_lists_gaps(spark):
    text = audit.block(ledger(spark, BASE), "r")
    assert "1/2" in text and "never inspected: bar" in text and "2 unaccounted" in text and "INCOMPLETE" in text and "old" not in text and "not declared" in text


def test_audit_clean(spark):
    kept = spark.createDataFrame([("r", "f2")], "repo string, id string")
    rows = BASE + [("inspect", "bar", "blast_radius"), ("dismissed", "f1", None)]
    text = audit.block(ledger(spark, rows), "r", kept)
    assert "2/2" in text and "1 kept" in text and "1 dismissed" in text and "AUDIT CLEAN" in text
    assert "no review" in audit.block(ledger(spark, rows), "other")


def test_symbols_are_parsed(spark):
    df = spark.createDataFrame([("src/a.ts: foo, bar",), ("nothing",), ("b.ts: ,x",)], "line string")
    assert {tuple(r) for r in audit.parse_symbols(df).collect()} == {("src/a.ts", "foo"), ("src/a.ts", "bar"), ("b.ts", "x")}


def test_blocks_of_many_repositories(spark):
    """One plan gives the same texts as a look at each repository, and lists are cut."""
    rows = []
    for r in range(30):
        rows += [(f"r{r}", 0, "floor", "old", None), (f"r{r}", 1, "start", None, None)] if r % 5 else [(f"r{r}", 0, "floor", "early", None)]
        rows += [(f"r{r}", 2 + k, "floor", f"f{k:02d}", None) for k in range(r)]
        rows += [(f"r{r}", 50 + k, "symbol", f"s{k}", "a.ts") for k in range(r % 4)] + [(f"r{r}", 90, "inspect", "s0", "callers")]
        rows += [(f"r{r}", 100 + k, "dismissed", f"f{k:02d}", None) for k in range(r // 2)]
    df = spark.createDataFrame(rows, "repo string, seq long, event string, key string, value string")
    got = {r["repo"]: r["text"] for r in audit.blocks(df).collect()}
    assert set(got) == {f"r{r}" for r in range(30) if r % 5}
    for r in (1, 7, 29):
        assert got[f"r{r}"] == audit.block(df, f"r{r}")
    lines = got["r29"].split("\n")
    assert lines[0] == "Audit: 1/1 changed exports traced, 1 inspect call(s)."
    assert lines[1] == "Floor: 29 finding(s), kept not declared, 14 dismissed, 0 accepted, 15 unaccounted."
    assert lines[2:14] == [f"  unaccounted: f{k}" for k in range(14, 26)] and lines[14:] == ["  and 3 more", "AUDIT INCOMPLETE"]
    assert audit.blocks(df.limit(0)).count() == 0


def test_a_review_begins_without_sorting_the_ledger(spark):
    rows = [("r", 1, "floor", "old", None), ("r", 2, "start", None, None), ("r", 3, "floor", "f", None), ("s", 1, "floor", "none began", None)]
    own = audit.current(spark.createDataFrame(rows, "repo string, seq long, event string, key string, value string"))
    assert sorted(r["seq"] for r in own.collect()) == [2, 3]
    assert "SortMergeJoin" not in own._jdf.queryExecution().executedPlan().toString()
