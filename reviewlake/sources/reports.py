"""Coverage and mutation reports as tables.

Every reader takes (report, text) rows, so that many reports are read in one job; a report
that cannot be read gives no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import truncate
from .git import first_existing

# Where reports are looked for, in this order.
COVERAGE_PLACES = ["lcov.info", "coverage/lcov.info", "coverage/lcov/lcov.info", "coverage/coverage-final.json", "coverage/cobertura-coverage.xml", "coverage/coverage.xml", "coverage.xml", "cobertura.xml", "coverage.out", "cover.out"]
STRYKER_PLACES = ["reports/mutation/mutation.json", "reports/mutation.json", "mutation.json"]
CARGO_PLACE = "mutants.out/missed.txt"

ISTANBUL = "map<string,struct<statementMap:map<string,struct<start:struct<line:bigint>>>,s:map<string,bigint>>>"
STRYKER = "struct<files:map<string,struct<mutants:array<struct<status:string,mutatorName:string,replacement:string,location:struct<start:struct<line:bigint>>>>>>>"


def _lines(reports: DataFrame, sep: str = "\n") -> DataFrame:
    return reports.select("report", F.posexplode(F.split("text", sep)).alias("pos", "raw"))


def _merged(rows: DataFrame) -> DataFrame:
    """The highest count of every line that any report instruments."""
    return rows.filter("file is not null and line is not null and hits is not null").groupBy("report", "file", F.col("line").cast("int").alias("line")).agg(F.max(F.col("hits").cast("bigint")).alias("hits"))


def lcov(reports: DataFrame) -> DataFrame:
    """``SF:`` opens a file, ``DA:line,hits`` counts, ``end_of_record`` closes it."""
    rows = _lines(reports).withColumn("raw", F.trim("raw"))
    run = Window.partitionBy("report").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.startswith("raw", F.lit("SF:")), F.substr("raw", F.lit(4))).when(F.col("raw") == "end_of_record", F.lit(""))
    rows = rows.withColumn("file", F.last(mark, ignorenulls=True).over(run)).filter("file <> ''")
    da = r"^DA:\s*(\d+)\s*,\s*(\d+)"
    found = rows.filter(F.rlike("raw", F.lit(da)))
    return _merged(found.select("report", "file", F.regexp_extract("raw", da, 1).cast("bigint").alias("line"), F.regexp_extract("raw", da, 2).cast("bigint").alias("hits")))


def istanbul(reports: DataFrame) -> DataFrame:
    """Statement counts at the line where each statement starts; a missing count is 0."""
    files = reports.select("report", F.explode(F.from_json("text", ISTANBUL)).alias("file", "v"))
    stmts = files.select("report", "file", F.col("v.s").alias("s"), F.explode("v.statementMap").alias("id", "at"))
    return _merged(stmts.select("report", "file", F.col("at.start.line").alias("line"), F.coalesce(F.try_element_at("s", F.col("id")), F.lit(0)).alias("hits")))


def attribute(tag: Column, name: str) -> Column:
    """The first value of an XML attribute, else null."""
    got = F.regexp_extract(tag, rf'(?:^|\s){name}="([^"]*)"', 1)
    return F.when(F.rlike(tag, F.lit(rf'(?:^|\s){name}="')), got)


def cobertura(reports: DataFrame) -> DataFrame:
    """``class`` elements name a file, ``line`` elements below them count."""
    tags = _lines(reports, "<")
    run = Window.partitionBy("report").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.startswith("raw", F.lit("class ")), attribute(F.col("raw"), "filename"))
    tags = tags.withColumn("file", F.last(name, ignorenulls=True).over(run))
    found = tags.filter(F.startswith("raw", F.lit("line ")))
    number = lambda a: F.expr(f"try_cast({a} as bigint)")
    found = found.withColumn("n", attribute(F.col("raw"), "number")).withColumn("h", attribute(F.col("raw"), "hits"))
    return _merged(found.select("report", "file", number("n").alias("line"), number("h").alias("hits")))


def go_profile(reports: DataFrame) -> DataFrame:
    """``file:l.c,l.c statements count``: the count holds for every line of the block."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)\s*$"
    rows = _lines(reports).filter(~F.startswith("raw", F.lit("mode:")) & F.rlike("raw", F.lit(pattern)))
    part = lambda k: F.regexp_extract("raw", pattern, k)
    low, high = part(2).cast("bigint"), part(3).cast("bigint")
    return _merged(rows.select("report", part(1).alias("file"), F.explode(F.sequence(low, F.greatest(low, high))).alias("line"), part(4).cast("bigint").alias("hits")))


def coverage(reports: DataFrame, path: str) -> DataFrame:
    """(report, file, line, hits) by the report's extension; unknown ones give no rows."""
    reader = {".info": lcov, ".json": istanbul, ".xml": cobertura, ".out": go_profile}.get(os.path.splitext(path)[1])
    return reader(reports) if reader else _merged(reports.select("report", F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("hits")).limit(0))


def stryker(reports: DataFrame) -> DataFrame:
    """(report, file, line, desc, no_coverage) of surviving and never executed mutants."""
    files = reports.select("report", F.explode(F.from_json("text", STRYKER)["files"]).alias("file", "v"))
    m = files.select("report", "file", F.explode("v.mutants").alias("m")).filter(F.col("m.status").isin("Survived", "NoCoverage"))
    swap = F.when(F.coalesce("m.replacement", F.lit("")) != "", F.concat(F.lit(": replaced with "), truncate(F.col("m.replacement"), 40))).otherwise(F.lit(""))
    rows = m.select("report", "file", F.col("m.location.start.line").cast("int").alias("line"), F.concat(F.coalesce("m.mutatorName", F.lit("mutant")), swap).alias("desc"), (F.col("m.status") == "NoCoverage").alias("no_coverage"))
    return rows.filter("line is not null")


def cargo_mutants(reports: DataFrame) -> DataFrame:
    """``path:line[:column]: description`` lines of missed mutants."""
    pattern = r"^([^:]+):(\d+):(?:(\d+):)?\s*(.+)$"
    rows = _lines(reports).withColumn("raw", F.trim("raw")).filter(F.rlike("raw", F.lit(pattern)))
    return rows.select("report", F.regexp_extract("raw", pattern, 1).alias("file"), F.regexp_extract("raw", pattern, 2).cast("int").alias("line"), F.regexp_extract("raw", pattern, 4).alias("desc"), F.lit(False).alias("no_coverage"))


def normalized(rows: DataFrame, root: str) -> DataFrame:
    """Files relative to the root, with forward slashes."""
    return rows.withColumn("file", paths.relative(F.col("file"), root))


def find_coverage(root: str) -> str | None:
    return first_existing(root, COVERAGE_PLACES, "COVERAGE_FILE")


def find_mutation(root: str) -> list[str]:
    found = [first_existing(root, STRYKER_PLACES), first_existing(root, [CARGO_PLACE])]
    return [p for p in found if p]


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(report, text) of one report file."""
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("report"), F.col("value").alias("text"))
