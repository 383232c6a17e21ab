"""Learnings and memories on disk; what is missing or cannot be read counts as empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import DDL as FINDING_DDL
from ..operators.memory import LEARNING_DDL, MEMORY_DDL


def _entries(spark: SparkSession, path: str, ddl: str, wrapped: bool) -> DataFrame:
    kind = f"struct<version:int,entries:array<struct<{_fields(ddl)}>>>" if wrapped else f"array<struct<{_fields(ddl)}>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], ddl)
    parsed = F.from_json("value", kind)
    return text.select(F.explode(parsed["entries"] if wrapped else parsed).alias("e")).select("e.*")


def _fields(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def learnings(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON object with an ``entries`` array."""
    return _entries(spark, path, LEARNING_DDL, True).filter("rule_id is not null")


def memories(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array."""
    return _entries(spark, path, MEMORY_DDL, False).filter("id is not null")


def save(df: DataFrame, path: str) -> None:
    """Write a store as Parquet: the form for stores that many reviews share."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def report_rows(rows: DataFrame, col: str) -> DataFrame:
    """Findings from a column of JSON documents, one a finding; other documents give none."""
    return rows.select(F.from_json(F.col(col), FINDING_DDL).alias("f")).select("f.*").filter("id is not null")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a report that was written as JSON; none if it is missing or cannot be read."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], FINDING_DDL)
    parsed = F.from_json("value", "findings array<string>")["findings"]
    return report_rows(text.select(F.explode(parsed).alias("json")), "json")
