"""Findings as review comments on the lines of a diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_event(must_fix: Column, approve_when_clean: bool = False) -> Column:
    return F.when(must_fix > 0, "REQUEST_CHANGES").otherwise("APPROVE" if approve_when_clean else "COMMENT")


def comment_marker(fid: Column, name: str = "review") -> Column:
    """A hidden comment by which a later review finds its own remarks."""
    return F.concat(F.lit(f"<!-- {name}:"), fid, F.lit(" -->"))


def anchor(findings: DataFrame, index: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add anchor_line and anchor_start to (file, line, end_line) findings.

    Both ends in one hunk: a range.  Otherwise the end line if it is in the diff, else the
    start line.  Neither: both are null, the finding has no anchor.
    """
    keys = keys or []
    end = F.coalesce("end_line", "line")
    rows = findings.withColumn("__lo", F.least("line", end)).withColumn("__hi", F.greatest("line", end))
    at = index.groupBy(*keys, F.col("path").alias("file"), "new_line").agg(F.min("hunk_idx").alias("hunk_idx"))
    for side in ("lo", "hi"):
        own = at.withColumnRenamed("new_line", f"__{side}").withColumnRenamed("hunk_idx", f"__h{side}")
        # Findings are few beside the lines of a diff, which stream past a table of them unsorted.
        rows = rows.hint("shuffle_hash").join(own, [*keys, "file", f"__{side}"], "left")
    low, high = F.col("__hlo"), F.col("__hhi")
    line = F.when(high.isNotNull(), F.col("__hi")).when(low.isNotNull(), F.col("__lo"))
    start = F.when((low == high) & (F.col("__lo") < F.col("__hi")), F.col("__lo"))
    return rows.withColumn("anchor_line", line).withColumn("anchor_start", start).drop("__lo", "__hi", "__hlo", "__hhi")


def comment(marker: str = "review") -> Column:
    """The Reviews-API comment of an anchored finding."""
    body = F.when(F.col("id").isNotNull(), F.concat("body", F.lit("\n\n"), comment_marker(F.col("id"), marker))).otherwise(F.col("body"))
    return F.struct(F.col("file").alias("path"), F.col("anchor_line").alias("line"), F.lit("RIGHT").alias("side"), F.col("anchor_start").alias("start_line"), body.alias("body"))


def payload(findings: DataFrame, index: DataFrame, summary: str, approve_when_clean: bool = False) -> DataFrame:
    """One row: event, body, comments, unanchored, and all of it as JSON.

    Findings are made and anchored once: one pass gathers all parts.
    """
    placed = F.col("anchor_line").isNotNull()
    rest = F.struct("file", "line", "end_line", "tier", "body", "id")
    out = anchor(findings, index).agg(
        review_event(F.count_if(F.col("tier") == "must-fix"), approve_when_clean).alias("event"),
        F.array_sort(F.collect_list(F.when(placed, comment()))).alias("comments"),
        F.array_sort(F.collect_list(F.when(~placed, rest))).alias("unanchored"),
    )
    out = out.select("event", F.lit(summary).alias("body"), "comments", "unanchored")
    return out.withColumn("json", F.to_json(F.struct("event", "body", "comments"), {"ignoreNullFields": "true"}))
