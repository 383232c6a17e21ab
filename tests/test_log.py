import json
import threading

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import memory
from reviewlake.operators.feedback import MemoryStore, SuppressionStore
from reviewlake.sources import log

NOW = "2026-06-09T00:00:00Z"


def entry(fp, signal="dismissed", scope="finding", at="2026-06-01T00:00:00Z", rule="style.x", text="t"):
    return (fp, rule, text, signal, scope, at)


def learn(spark, *rows):
    return spark.createDataFrame(list(rows), memory.LEARNING_DDL)


def test_two_writers_keep_both_rows(spark, tmp_path, monkeypatch):
    """Both read the same state, and the slower one finds its number taken."""
    one, two = (log.Log(spark, str(tmp_path / "t"), "k string, v int") for _ in range(2))
    assert one.read().count() == 0 and one.compact(lambda rows: rows) is None
    monkeypatch.setattr(log.Log, "_next", lambda self: 1)
    rows = lambda k: spark.createDataFrame([(k, 1)], "k string, v int")
    assert [one.append(rows("a")), two.append(rows("b")), one.append(rows("c"))] == [1, 2, 3]
    assert sorted((r["k"], r["__commit"]) for r in two.read().collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    got: list[int] = []
    write = lambda k: got.append(log.Log(spark, path, "k int").append(spark.createDataFrame([(k,)], "k int")))
    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 9))
    assert sorted(r["k"] for r in log.Log(spark, path, "k int").read().collect()) == list(range(8))


def test_a_snapshot_loses_nothing(spark, tmp_path):
    t = log.Log(spark, str(tmp_path / "t"), "k string, v int")
    rows = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    for v in range(3):
        t.append(rows("a", v))
    before = t.commits()
    assert t.compact(lambda r: r.groupBy("k").agg(F.max("v").alias("v"))) == 4
    assert [tuple(r) for r in t.read().collect()] == [("a", 2, 4)]
    assert t.read(before).count() == 3  # a reader that looked earlier still reads what it saw
    t.append(rows("b", 7))
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 2, 4), ("b", 7, 5)]

    def late(r):  # another writer commits while the snapshot is made
        t.append(rows("c", 9))
        return r.drop("__commit")

    assert t.compact(late) is None
    assert sorted(r["k"] for r in t.read().collect()) == ["a", "b", "c"]


def test_suppression_store(spark, tmp_path):
    store, other = (SuppressionStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert store.list().count() == 0
    store.record(learn(spark, entry("a"), entry("b")))
    other.record(learn(spark, entry("c"), entry("a", "accepted", at="2026-05-01T00:00:00Z")))
    assert {r["fingerprint"]: r["signal"] for r in store.list().collect()} == {"a": "accepted", "b": "dismissed", "c": "dismissed"}
    ask = spark.createDataFrame([("b", "style.x", "quite other words"), ("zz", "style.y", "none of them")], "fingerprint string, rule_id string, text string")
    assert {r["fingerprint"]: r["suppress"] for r in store.evaluate(ask, NOW).collect()} == {"b": True, "zz": False}
    store.forget(F.col("fingerprint") == "b")
    assert sorted(r["fingerprint"] for r in other.list().collect()) == ["a", "c"]
    assert store.compact() == 4 and sorted(r["fingerprint"] for r in other.list().collect()) == ["a", "c"]
    other.record(learn(spark, entry("b")))
    assert other.list().count() == 3


def test_a_seed_is_below_all_commits(spark, tmp_path):
    store = SuppressionStore(spark, str(tmp_path / "s"), learn(spark, entry("a", at="2026-06-08T00:00:00Z"), entry("old")))
    assert store.list().count() == 2
    store.record(learn(spark, entry("a", "accepted")))
    assert {r["fingerprint"]: r["signal"] for r in store.list().collect()} == {"a": "accepted", "old": "dismissed"}
    store.forget(F.col("fingerprint") == "old")
    assert [r["fingerprint"] for r in store.list().collect()] == ["a"] and store.compact() is None


def test_memory_store(spark, tmp_path):
    one, two = (MemoryStore(spark, str(tmp_path / "m")) for _ in range(2))
    note = lambda *texts: spark.createDataFrame([("note", t, None, None) for t in texts], "kind string, text string, scope string, file string")
    one.remember(note("use pnpm to build", "deploys run on fridays"), NOW)
    two.remember(note("use pnpm to build", "the linter is strict"), NOW)
    assert sorted(r["text"] for r in one.list().collect()) == ["deploys run on fridays", "the linter is strict", "use pnpm to build"]
    assert one.recall(F.lit("how to build with pnpm")).first()["text"] == "use pnpm to build"
    assert two.compact() == 3 and one.list().count() == 3


@pytest.mark.parametrize("rows_per_run", [5000, 40])
def test_sarif_in_runs(spark, tmp_path, rows_per_run):
    from reviewlake.operators import findings, heuristics
    from reviewlake.plans import sinks

    lines = spark.createDataFrame([(f"src/f{k}.py", k, 1 + k % 3, t) for k in range(150) for t in ("print(1)", "eval(x)")], "path string, file_ord int, line int, text string")
    f = findings.first_wins(heuristics.run(lines))
    sinks.write_sarif(f, str(tmp_path / "out"), rows_per_run)
    logs = [json.loads(p.read_text()) for p in sorted((tmp_path / "out").glob("shard=*/part-*"))]
    assert len(logs) == (1 if rows_per_run == 5000 else 8)
    rules = [r["id"] for r in logs[0]["runs"][0]["tool"]["driver"]["rules"]]
    assert rules == ["hygiene.python-print", "security.python-eval-exec"]
    results = [r for x in logs for r in x["runs"][0]["results"]]
    assert all(rules[r["ruleIndex"]] == r["ruleId"] for r in results)
    assert sorted(r["partialFingerprints"]["primary"] for r in results) == sorted(r["id"] for r in f.select("id").collect())
    assert max(len(x["runs"][0]["results"]) for x in logs) <= 2 * rows_per_run
    whole = json.loads(sinks.sarif(f).first()["sarif"])["runs"][0]["results"]
    assert len(whole) == len(results) and {k: v for k, v in results[0].items() if k != "ruleIndex"} in whole


def test_texts(spark):
    from reviewlake.plans import sinks
    from reviewlake.sources import contract

    row = spark.createDataFrame([(3, 2, 1, 0, 4), (1, 0, 0, 0, 0)], "files_changed int, must_fix int, concern int, nit int, suppressed int")
    assert [r["line"] for r in sinks.summary_line(row).collect()] == ["Review of 3 changed file(s): 2 must-fix, 1 concern, 0 nit; 4 left out as learned.", "Review of 1 changed file(s): 0 must-fix, 0 concern, 0 nit."]
    c = contract.parse("be kind\nmute: style.x\nskip: gen/**", "repo")
    f = spark.createDataFrame([("style.x", "a.py"), ("style.y", "gen/b.py"), ("style.y", "c.py")], "rule_id string, file string")
    text = sinks.contract_text(c, contract.policy(f, c), 1)
    assert text.splitlines()[:2] == ["Review contract (repo):", "be kind"] and "Dropped by the contract (2):" in text and text.endswith("and 1 more")
    assert sinks.contract_text(contract.Contract(), f.withColumn("reason", F.lit(None))).endswith("the defaults hold.")
