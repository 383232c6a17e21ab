import pytest
from pyspark.sql import functions as F

from reviewlake.operators import anchors
from reviewlake.sources import unified_diff as ud

TWO_HUNKS = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,3 +1,4 @@\n a\n+b\n c\n-d\n+e\n@@ -10,2 +11,2 @@\n x\n+y\n"
NEW_FILE = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+one\n+two\n\\ No newline at end of file\n"
TRAPS = "diff --git a/t.c b/t.c\n--- a/t.c\n+++ b/t.c\n@@ -1,2 +1,3 @@\n ctx\n+++counter;\n--- old\n+last\n"
GONE = "diff --git a/g.py b/g.py\ndeleted file mode 100644\n--- a/g.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-x\n"


@pytest.fixture(scope="module")
def patches(spark):
    return spark.createDataFrame([("a", TWO_HUNKS), ("b", NEW_FILE), ("c", TRAPS), ("d", GONE), ("e", ""), ("f", TWO_HUNKS + NEW_FILE)], "patch_id string, text string")


def test_added_lines(patches):
    got = {tuple(r) for r in ud.added_lines(patches).select("patch_id", "path", "line", "text").collect()}
    two = {("f.py", 2, "b"), ("f.py", 4, "e"), ("f.py", 12, "y")}
    new = {("n.py", 1, "one"), ("n.py", 2, "two")}
    traps = {("t.c", 2, "++counter;"), ("t.c", 3, "last")}
    assert got == {("a", *x) for x in two} | {("b", *x) for x in new} | {("c", *x) for x in traps} | {("f", *x) for x in two | new}


def test_changed_files(patches):
    got = {(r["patch_id"], r["path"]): (r["removed_count"], r["added_count"], r["is_new"], r["is_deleted"]) for r in ud.changed_files(patches).collect()}
    assert got[("a", "f.py")] == (1, 3, False, False)
    assert got[("b", "n.py")] == (0, 2, True, False)
    assert got[("c", "t.c")] == (1, 2, False, False)
    assert got[("d", "g.py")] == (1, 0, False, True)
    assert [r["path"] for r in ud.changed_list(ud.changed_files(patches).filter("patch_id = 'd'")).collect()] == []


def test_mnemonic_prefixes_and_anchor_index(spark):
    p = spark.createDataFrame([("a", TWO_HUNKS.replace("b/f.py", "w/f.py"))], "patch_id string, text string")
    got = {(r["path"], r["new_line"], r["hunk_idx"]) for r in ud.anchor_index(p).collect()}
    assert got == {("f.py", 1, 0), ("f.py", 2, 0), ("f.py", 3, 0), ("f.py", 4, 0), ("f.py", 11, 1), ("f.py", 12, 1)}


@pytest.mark.parametrize("lo,hi,want", [(2, None, (2, None)), (2, 4, (4, 2)), (4, 2, (4, 2)), (2, 12, (12, None)), (4, 9, (4, None)), (9, 12, (12, None)), (7, 8, (None, None))])
def test_anchor(spark, lo, hi, want):
    index = ud.anchor_index(spark.createDataFrame([("a", TWO_HUNKS)], "patch_id string, text string"))
    f = spark.createDataFrame([("f.py", lo, hi)], "file string, line int, end_line int")
    r = anchors.anchor(f, index).first()
    assert (r["anchor_line"], r["anchor_start"]) == want


def test_payload(spark):
    index = ud.anchor_index(spark.createDataFrame([("a", TWO_HUNKS)], "patch_id string, text string"))
    rows = [("x1", "must-fix", "other.py", 1, None, "gone"), (None, "nit", "f.py", 2, None, "here")]
    f = spark.createDataFrame(rows, "id string, tier string, file string, line int, end_line int, body string")
    r = anchors.payload(f, index, "sum").first()
    assert r["event"] == "REQUEST_CHANGES" and len(r["comments"]) == 1 and r["unanchored"][0]["id"] == "x1"
    assert r["comments"][0]["body"] == "here"
    clean = anchors.payload(f.filter("tier = 'nit'"), index, "s", True).first()
    assert clean["event"] == "APPROVE"
    assert anchors.payload(f.filter("tier = 'nit'").withColumn("id", F.lit("z")), index, "s").first()["comments"][0]["body"].endswith("<!-- review:z -->")


def test_a_payload_makes_its_findings_once(spark):
    """One pass gathers all parts; lines of the diff stream past the findings unsorted."""
    index = ud.anchor_index(spark.createDataFrame([("a", TWO_HUNKS)], "patch_id string, text string"))
    f = spark.range(20).selectExpr("concat('x', id) as id", "if(id = 3, 'must-fix', 'nit') as tier", "'f.py' as file", "cast(id as int) as line", "cast(null as int) as end_line", "'b' as body")
    p = anchors.payload(f, index, "s")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    r = p.first()
    lines = {x["new_line"] for x in index.filter("path = 'f.py'").collect()} & set(range(20))
    assert r["event"] == "REQUEST_CHANGES" and lines
    assert [c["line"] for c in r["comments"]] == sorted(lines) and len(r["unanchored"]) == 20 - len(lines)
    none = anchors.payload(f.limit(0), index, "s").first()
    assert (none["event"], none["comments"], none["unanchored"]) == ("COMMENT", [], [])
