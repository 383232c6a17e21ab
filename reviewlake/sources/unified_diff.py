"""Unified diffs as tables: changed files, added lines and the index of anchor lines.

The parser is a set of running window sums over the lines of a patch.  Windows are keyed by
patch (a commit, a pull request), so work spreads over patches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import strip_diff_prefix

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def patch_lines(patches: DataFrame, key: str = "patch_id", text: str = "text") -> DataFrame:
    """(key, pos, raw) of every line of every patch."""
    return patches.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))


def _states(lines: DataFrame, key: str) -> DataFrame:
    """Number the file sections and hunks, and mark which lines lie in a hunk.

    A section begins at ``diff --git``; a hunk header opens a hunk until the next section.
    """
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    lines = lines.withColumn("is_section", F.startswith(raw, F.lit("diff --git")))
    lines = lines.withColumn("section", F.sum(F.col("is_section").cast("int")).over(run))
    here = Window.partitionBy(key, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_hunk", F.rlike(raw, F.lit(HUNK)))
    lines = lines.withColumn("hunk", F.sum(F.col("is_hunk").cast("int")).over(here))
    lines = lines.withColumn("hunk_idx", F.sum(F.col("is_hunk").cast("int")).over(run) - 1)
    return lines.withColumn("in_hunk", (F.col("hunk") > 0) & ~F.col("is_hunk") & ~F.col("is_section"))


def _numbered(lines: DataFrame, key: str, prefix_only_b: bool) -> DataFrame:
    """Add each section's path and each line's place on the new side."""
    s = _states(lines, key)
    whole = Window.partitionBy(key, "section")
    raw = F.col("raw")
    target = F.when(~F.col("in_hunk") & (F.col("hunk") == 0) & F.startswith(raw, F.lit("+++ ")), F.substr(raw, F.lit(5)))
    source = F.when(~F.col("in_hunk") & (F.col("hunk") == 0) & F.startswith(raw, F.lit("--- ")), F.substr(raw, F.lit(5)))
    s = s.withColumn("target", F.max(target).over(whole)).withColumn("origin", F.max(source).over(whole))
    shown = F.when(F.col("target") == "/dev/null", F.col("origin")).otherwise(F.col("target"))
    s = s.withColumn("path", F.regexp_replace(shown, "^[ab]/", "") if prefix_only_b else strip_diff_prefix(F.col("target")))
    inside = Window.partitionBy(key, "section", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("start", F.max(F.when(F.col("is_hunk"), F.regexp_extract("raw", HUNK, 1).cast("int"))).over(inside))
    marker = F.substr(raw, F.lit(1), F.lit(1))
    new_side = F.col("in_hunk") & ~marker.isin("-", "\\") & ((raw != "") | F.lit(False))
    s = s.withColumn("marker", marker).withColumn("on_new", new_side)
    return s.withColumn("line", F.col("start") + F.sum(F.col("on_new").cast("int")).over(inside) - 1)


def changed_files(patches: DataFrame, key: str = "patch_id", text: str = "text") -> DataFrame:
    """(key, path, removed_count, added_count, is_new, is_deleted), a row for each file section."""
    n = _numbered(patch_lines(patches, key, text), key, True).filter("section > 0 and path is not null and path <> ''")
    return n.groupBy(key, "section", "path").agg(
        F.count_if(F.col("in_hunk") & (F.col("marker") == "-")).alias("removed_count"),
        F.count_if(F.col("in_hunk") & (F.col("marker") == "+")).alias("added_count"),
        F.max(F.col("origin") == "/dev/null").alias("is_new"),
        F.max(F.col("target") == "/dev/null").alias("is_deleted"),
    )


def added_lines(patches: DataFrame, key: str = "patch_id", text: str = "text") -> DataFrame:
    """(key, path, file_ord, ord, line, text) of every added line."""
    n = _numbered(patch_lines(patches, key, text), key, True)
    rows = n.filter(F.col("in_hunk") & (F.col("marker") == "+") & F.col("path").isNotNull() & (F.col("path") != ""))
    return rows.select(key, "path", F.col("section").alias("file_ord"), F.col("pos").alias("ord"), "line", F.substr("raw", F.lit(2)).alias("text"))


def anchor_index(patches: DataFrame, key: str = "patch_id", text: str = "text") -> DataFrame:
    """(key, path, new_line, hunk_idx) of every line that a comment can stand on."""
    n = _numbered(patch_lines(patches, key, text), key, False)
    rows = n.filter(F.col("on_new") & F.col("marker").isin("+", " ") & (F.col("target") != "/dev/null"))
    return rows.select(key, "path", F.col("line").alias("new_line"), "hunk_idx")


def changed_list(files: DataFrame) -> DataFrame:
    """Paths that still exist after the change."""
    return files.filter(~F.col("is_deleted")).select("path").distinct()
