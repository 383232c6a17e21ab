"""What a repository's history says about changed files: fix churn and missing companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import spread
from . import findings

# Words of fixing commits; thresholds of churn and of companions; caps.
FIXING = r"(?i)\b(fix(es|ed)?|bug|bugfix|hotfix|regression|revert(s|ed)?)\b"
CHURN, CHURN_LOW = 3, 6
MASS_COMMIT, LEAST_COMMITS, LEAST_TOGETHER, RATE_NUM, RATE_DEN = 30, 5, 4, 3, 5
SHOWN = 8


def is_fix(subject: F.Column) -> F.Column:
    return F.rlike(subject, F.lit(FIXING))


def fix_churn(commits: DataFrame, changed: DataFrame, least: int = CHURN) -> DataFrame:
    """(path, n_total, n_fix) of changed files that fixing commits touched often.

    ``commits`` has (seq, fix, files); every commit counts, mass commits too.
    """
    touched = commits.select("seq", "fix", F.explode(F.array_distinct("files")).alias("path"))
    hit = touched.join(changed.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("path").agg(F.count("*").alias("n_total"), F.count_if("fix").alias("n_fix")).filter(F.col("n_fix") >= least)


def co_change(commits: DataFrame, changed: DataFrame, mass: int = MASS_COMMIT, least_commits: int = LEAST_COMMITS, least_together: int = LEAST_TOGETHER, rate: tuple[int, int] = (RATE_NUM, RATE_DEN)) -> DataFrame:
    """(path, partner, together, n_stat): the companion of a changed file that is not in the change.

    The most frequent partner wins, the smallest name on ties.  Mass commits say nothing, so a
    commit yields at most ``mass`` partners for each changed file.
    """
    some = commits.filter(F.size("files") <= mass).withColumn("files", F.array_distinct("files"))
    own = changed.select("path").distinct()
    rows = some.select("seq", "files", F.explode("files").alias("path")).join(own, "path", "left_semi")
    stat = rows.groupBy("path").agg(F.count("*").alias("n_stat")).filter(F.col("n_stat") >= least_commits)
    pairs = rows.select("path", F.explode("files").alias("partner")).filter("partner <> path")
    pairs = pairs.join(own.withColumnRenamed("path", "partner"), "partner", "left_anti").filter(~paths.is_generated(F.col("partner")))
    # Most pairs are rare: counted where they are made, they would fill a task's memory and shrink little.
    count = spread(pairs, "path", "partner").groupBy("path", "partner").agg(F.count("*").alias("together"))
    w = Window.partitionBy("path").orderBy(F.desc("together"), "partner")
    best = count.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    num, den = rate
    return best.join(stat, "path").filter((F.col("together") >= least_together) & (F.col("together") * den >= F.col("n_stat") * num)).select("path", "partner", "together", "n_stat")


def run(commits: DataFrame, changed: DataFrame, existing: DataFrame | None = None, shown: int = SHOWN) -> DataFrame:
    """Findings from (seq, subject, files) commits and (path, file_ord, line) changed files."""
    log = commits.withColumn("fix", is_fix(F.col("subject")))
    place = changed.groupBy("path").agg(F.min("file_ord").alias("file_ord"), F.min("line").alias("line"))
    churn = fix_churn(log, changed).join(place, "path").withColumn("level", F.when(F.col("n_fix") >= CHURN_LOW, "low").otherwise("info"))
    # Whole-report lists of a few rows: the limits are the feature.
    churn = churn.orderBy(F.desc("level"), "path").limit(shown)
    a = findings.make(churn, rule_id="history.fix-churn", category="impact", severity="level", confidence=0.6, file="path", title="Often fixed file", message=F.concat(F.col("n_fix").cast("string"), F.lit(" of the "), F.col("n_total").cast("string"), F.lit(" recent commits to this file were fixes")), anchor_kind="metric", anchor_detail=F.concat_ws("/", F.col("n_fix").cast("string"), F.col("n_total").cast("string")), source="history", key=F.concat(F.col("path"), F.lit("::fix-churn")))
    pairs = co_change(log, changed)
    if existing is not None:
        pairs = pairs.join(existing.select(F.col("path").alias("partner")).distinct(), "partner", "left_semi")
    pairs = pairs.join(place, "path").orderBy("file_ord", "path").limit(shown).withColumn("rule_ord", F.lit(1))
    b = findings.make(pairs, rule_id="history.co-change-missing", category="impact", severity="low", confidence=0.55, file="path", title="Usual companion unchanged", message=F.concat(F.col("partner"), F.lit(" changed with this file in "), F.col("together").cast("string"), F.lit(" of its "), F.col("n_stat").cast("string"), F.lit(" commits, but not here")), anchor_kind="metric", anchor_detail=F.concat(F.lit("partner="), F.col("partner")), source="history", key=F.concat(F.col("path"), F.lit("::co-change::"), F.col("partner")))
    return a.unionByName(b)
