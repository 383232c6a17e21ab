"""Cognitive complexity before and after a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import findings
from .graph import touched

# Scores of complex and very complex functions, and steps that matter.
HIGH, VERY_HIGH, STEP, BIG_STEP, SMALL_BASE_STEP = 15, 30, 5, 15, 10


def classify(head: Column, base: Column) -> Column:
    """The severity of a function's score given its former one (null: new); null if unremarkable."""
    step = head - base
    new = F.when(head >= VERY_HIGH, "medium").when(head >= HIGH, "low")
    old = F.when((head >= HIGH) & (step >= STEP), F.when((head >= VERY_HIGH) | (step >= BIG_STEP), "medium").otherwise("low")).when(step >= SMALL_BASE_STEP, "low")
    return F.when(base.isNull(), new).otherwise(old)


def with_base(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head functions with ``base_score``: the first function of that name in the old file."""
    w = Window.partitionBy("file", "name").orderBy("start_line")
    first = base.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("file", "name", F.col("score").alias("base_score"))
    return head.join(first, ["file", "name"], "left")


def worst(functions: DataFrame) -> DataFrame:
    """(file, most, functions, worst): the largest score of a file, how many functions it has, and the first with that score."""
    best = F.struct((-F.col("score")).alias("score"), "start_line", "name")
    return functions.groupBy("file").agg(F.max("score").alias("most"), F.count("*").alias("functions"), F.min(best)["name"].alias("worst"))


def complexity_findings(head: DataFrame, base: DataFrame, added: DataFrame) -> DataFrame:
    """Touched functions (file, name, start_line, end_line, score) that became hard to follow."""
    rows = with_base(touched(head, added), base).withColumn("level", classify(F.col("score"), F.col("base_score"))).filter("level is not null")
    was = F.when(F.col("base_score").isNull(), "new").otherwise(F.concat(F.lit("was "), F.col("base_score").cast("string")))
    rows = rows.withColumn("line_ord", F.col("start_line")).withColumn("was", was)
    message = F.concat(F.col("name"), F.lit(" has cognitive complexity "), F.col("score").cast("string"), F.lit(" ("), F.col("was"), F.lit(")"))
    return findings.make(rows, rule_id="maintainability.cognitive-complexity", category="maintainability", severity="level", confidence=0.85, start="start_line", title="Complex function", message=message, anchor_kind="metric", anchor_detail=F.concat(F.col("score").cast("string"), F.lit(" "), F.col("was")), source="complexity", key=F.concat_ws("::", "file", "name"))
