import re

from reviewlake.operators import history
from reviewlake.sources import git


def commits(spark, rows):
    return spark.createDataFrame([(k, s, f) for k, (s, f) in enumerate(rows)], "seq int, subject string, files array<string>")


def changed(spark, *names):
    return spark.createDataFrame([(p, k, 1) for k, p in enumerate(names)], "path string, file_ord int, line int")


def test_log_parser(spark):
    raw = spark.createDataFrame([("\x01fix: a\n\nsrc/a.ts\nsrc/b.ts\n\x01feat: b\n\nsrc/c.ts\n\n",)], "raw string")
    got = [(r["subject"], r["files"]) for r in git.parse_log(raw).orderBy("seq").collect()]
    assert got == [("fix: a", ["src/a.ts", "src/b.ts"]), ("feat: b", ["src/c.ts"])]


def test_churn(spark):
    log = commits(spark, [("fix x", ["a.ts"]), ("bugfix", ["a.ts"]), ("Revert y", ["a.ts"]), ("feat", ["a.ts"]), ("prefix", ["b.ts"])])
    f = history.run(log, changed(spark, "a.ts", "b.ts")).collect()
    assert [r["rule_id"] for r in f] == ["history.fix-churn"] and "3 of the 4" in f[0]["message"] and f[0]["severity"] == "info"


def test_companion(spark):
    log = commits(spark, [("c", ["a.ts", "b.ts", "z.ts"])] * 4 + [("c", ["a.ts", "b.ts"]), ("c", ["a.ts"])])
    f = history.run(log, changed(spark, "a.ts")).collect()
    assert len(f) == 1 and "b.ts" in f[0]["message"] and f[0]["anchor"]["detail"] == "partner=b.ts"
    assert history.run(log, changed(spark, "a.ts", "b.ts", "z.ts")).filter("rule_id like '%co-change%'").count() == 0
    gone = history.run(log, changed(spark, "a.ts"), existing=changed(spark, "a.ts"))
    assert gone.count() == 0


def test_ties_take_the_smallest_and_mass_commits_count_only_for_churn(spark):
    log = commits(spark, [("c", ["a.ts", "z.ts", "b.ts"])] * 5)
    assert history.co_change(log.selectExpr("seq", "false as fix", "files"), changed(spark, "a.ts")).first()["partner"] == "b.ts"
    mass = commits(spark, [("fix", ["a.ts", "b.ts"] + [f"f{k}.ts" for k in range(40)])] * 6)
    got = {r["rule_id"]: r["severity"] for r in history.run(mass, changed(spark, "a.ts")).collect()}
    assert got == {"history.fix-churn": "low"}


def test_pairs_are_dealt_before_they_are_counted(spark):
    """No aggregate stands before the shuffle of pairs: it would hold a task's pairs whole."""
    commits = spark.createDataFrame([(k, ["a", f"b{k}"]) for k in range(9)], "seq long, files array<string>")
    plan = history.co_change(commits, spark.createDataFrame([("a",)], "path string"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM") :]
    assert not re.search(r"HashAggregate\(keys=\[path#\d+, partner#\d+\]", below)
