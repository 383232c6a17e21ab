"""Findings from coverage and mutation reports on added lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import fmt_ranges
from ..runtime import checkpoint
from . import findings

# Uncovered lines that make a concern; mutants shown for a file.
MANY_UNCOVERED, MUTANTS_SHOWN = 8, 5


def resolve_paths(changed: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, key): the report's name of each changed path: equal, else a tail of one another.

    Among several tails the smallest wins.  Tails are found by an equality join on the last
    path segment, so no pair of unrelated paths is looked at.
    """
    a = changed.select("path").distinct().withColumn("tail", paths.basename(F.col("path")))
    b = keys.select("key").distinct().withColumn("tail", paths.basename(F.col("key")))
    both = a.join(b, "tail").withColumn("level", F.when(F.col("path") == F.col("key"), 0).when(paths.suffix_match(F.col("path"), F.col("key")), 1)).filter("level is not null")
    return both.groupBy("path").agg(F.min_by("key", F.struct("level", "key")).alias("key"))


def islands(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """(by, lo, hi): runs of consecutive numbers."""
    w = Window.partitionBy(*by).orderBy(line)
    runs = lines.select(*by, line).distinct().withColumn("__g", F.col(line) - F.row_number().over(w))
    return runs.groupBy(*by, "__g").agg(F.min(line).alias("lo"), F.max(line).alias("hi")).drop("__g")


def fresh(files: DataFrame, modified: str, reported: str) -> DataFrame:
    """Without files that changed after their report; unknown times pass."""
    return files.filter(F.coalesce(F.col(modified) <= F.col(reported), F.lit(True)))


def uncovered(added: DataFrame, coverage: DataFrame) -> DataFrame:
    """(path, key, instrumented, uncovered, lines) by changed file."""
    names = resolve_paths(added, coverage.select(F.col("file").alias("key")))
    hit = added.select("path", "line").distinct().join(names, "path").join(coverage.select(F.col("file").alias("key"), "line", "hits"), ["key", "line"])
    return hit.groupBy("path", "key").agg(F.count("*").alias("instrumented"), F.count_if(F.col("hits") == 0).alias("uncovered"), F.array_sort(F.collect_list(F.when(F.col("hits") == 0, F.col("line")))).alias("lines"))


def coverage_findings(added: DataFrame, coverage: DataFrame, label: str, many: int = MANY_UNCOVERED) -> DataFrame:
    """One finding for each file with added lines that no test ran."""
    rows = uncovered(added.filter(~paths.is_generated(F.col("path"))), coverage).filter("uncovered > 0")
    runs = islands(rows.select("path", F.explode("lines").alias("line")), ["path"])
    runs = runs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    order = added.groupBy("path").agg(F.min("file_ord").alias("file_ord"))
    rows = rows.join(runs, "path").join(order, "path").withColumn("share", F.concat_ws("/", F.col("uncovered").cast("string"), F.col("instrumented").cast("string")))
    message = F.concat(F.col("share"), F.lit(" instrumented added lines were never run by a test (lines "), fmt_ranges(F.col("runs")), F.lit(f"), says {label}"))
    return findings.make(rows, rule_id="tests.uncovered-added-lines", category="maintainability", severity=F.when(F.col("uncovered") >= many, "medium").otherwise("low"), confidence=0.9, file="path", start=F.get("runs", F.lit(0))["lo"], end=F.get("runs", F.lit(0))["hi"], title="Untested added lines", message=message, anchor_kind="metric", anchor_detail=F.concat(F.lit(f"{label}: "), F.col("share")), source="coverage", key=F.concat(F.col("path"), F.lit("::uncovered-added")))


def capped(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of every group; the last row kept says how many more there were (``more``)."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("__all", F.count("*").over(w))
    more = F.when(F.col("__n") == most, F.col("__all") - most).otherwise(F.lit(0))
    return rows.filter(F.col("__n") <= most).withColumn("more", more).drop("__n", "__all")


def mutation_findings(added: DataFrame, mutants: DataFrame, most: int = MUTANTS_SHOWN) -> DataFrame:
    """Mutants on added lines that no test noticed, a few for each file and report."""
    # Counted by line first: a file shows the mutants of its first lines, those of the others are only counted.
    own = checkpoint(mutants.groupBy("report", F.col("file").alias("key"), "line").agg(F.count("*").alias("__own")))
    places = checkpoint(added.groupBy("path", "line").agg(F.min("file_ord").alias("file_ord"))).filter(~paths.is_generated(F.col("path")))
    places = places.join(resolve_paths(places, own.select("key")), "path").join(own, ["key", "line"])
    file = Window.partitionBy("report", "path")
    before = F.sum("__own").over(file.orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    first = places.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__all", F.sum("__own").over(file)).filter(F.col("__before") < most)
    first = first.select(F.col("report").alias("__report"), "path", "key", "line", "file_ord", "__all")
    hit = mutants.withColumnRenamed("file", "key").join(first.hint("shuffle_hash"), ["key", "line"]).filter(F.col("report").eqNullSafe(F.col("__report")))
    # The rank alone is cut, so that Spark cuts it before rows move, too.
    hit = hit.withColumn("__n", F.row_number().over(file.orderBy("line", "desc"))).filter(F.col("__n") <= most)
    rows = hit.withColumn("more", F.when(F.col("__n") == most, F.col("__all") - most).otherwise(F.lit(0))).drop("__report", "__n", "__all").withColumn("line_ord", F.col("line"))
    missed = F.col("no_coverage")
    tail = F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more in this file)"))).otherwise(F.lit(""))
    message = F.concat(F.when(missed, "No test runs this line: ").otherwise("Tests pass with this change: "), F.col("desc"), tail)
    return findings.make(rows, rule_id=F.when(missed, "tests.mutant-no-coverage").otherwise("tests.surviving-mutant"), category="maintainability", severity=F.when(missed, "low").otherwise("medium"), confidence=0.85, file="path", title=F.when(missed, "Mutant without coverage").otherwise("Surviving mutant"), message=message, anchor_kind="metric", anchor_detail="desc", source="mutation", key=F.concat_ws(":", "path", F.col("line").cast("string"), "desc"))
