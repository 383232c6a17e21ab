"""The finding table: its columns, how rows are made, first-wins dedup, order and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.hashing import fingerprint

REGION = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
BLAST = "struct<symbol:string,direct_callers:int,transitive_callers:int,files_affected:array<string>,crosses_api_boundary:boolean,resolution_confidence:float,resolution_method:string>"
DDL = (
    "id string, rule_id string, category string, severity string, tier string, confidence float, file string, "
    f"region {REGION}, title string, message string, anchor struct<kind:string,detail:string>, introduced boolean, "
    f"source string, suggestion string, blast_radius {BLAST}"
)
ORDINALS = ("collector_ord", "file_ord", "line_ord", "rule_ord")
#: Collectors in the order in which equal fingerprints win.
COLLECTORS = ("secrets", "heuristics", "external", "coverage", "mutation", "history", "blast-radius", "complexity")


def make(
    rows: DataFrame,
    *,
    rule_id,
    category,
    severity,
    confidence,
    file: str = "file",
    start="line",
    end=None,
    title,
    message,
    anchor_kind: str,
    anchor_detail,
    source: str,
    key,
    blast: Column | None = None,
    suggestion: Column | None = None,
    collector: str | None = None,
) -> DataFrame:
    """Findings from rows; strings that name columns are columns, other values are literals.

    ``key`` is what, with rule and file, tells findings apart: never the line number.
    """
    have = set(rows.columns)

    def c(x) -> Column:
        return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) and x in have else F.lit(x)

    level, first = c(severity), c(start).cast("int")
    region = F.struct(first.alias("start_line"), F.lit(0).alias("start_col"), (c(end) if end is not None else first).cast("int").alias("end_line"), F.lit(0).alias("end_col"))
    at = COLLECTORS.index(collector or source)
    order = [F.col(o).cast("int") if o in have else F.lit(0) for o in ORDINALS[1:]]
    return rows.select(
        fingerprint(c(rule_id), c(file), c(key)).alias("id"),
        c(rule_id).alias("rule_id"),
        c(category).alias("category"),
        level.alias("severity"),
        sev.tier(level).alias("tier"),
        c(confidence).cast("float").alias("confidence"),
        c(file).alias("file"),
        region.alias("region"),
        c(title).alias("title"),
        c(message).alias("message"),
        F.struct(F.lit(anchor_kind).alias("kind"), c(anchor_detail).alias("detail")).alias("anchor"),
        F.lit(True).alias("introduced"),
        F.lit(source).alias("source"),
        (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"),
        (blast if blast is not None else F.lit(None)).cast(BLAST).alias("blast_radius"),
        F.lit(at).alias("collector_ord"),
        *[o.alias(n) for o, n in zip(order, ORDINALS[1:], strict=True)],
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_wins(findings: DataFrame) -> DataFrame:
    """One row per fingerprint: the first by collector, file, line and rule."""
    w = Window.partitionBy("id").orderBy(*ORDINALS, F.col("region.start_line"), "file", "rule_id")
    return findings.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def in_order(findings: DataFrame) -> DataFrame:
    """Most severe first, then file and line; ties stay in collector order."""
    return findings.orderBy(F.desc(sev.rank(F.col("severity"))), "file", "region.start_line", *ORDINALS, "id")


def summary(findings: DataFrame, suppressed: int = 0) -> DataFrame:
    """One row of counts by tier."""
    tiers = [F.count_if(F.col("tier") == t).alias(t.replace("-", "_")) for t in sev.TIERS]
    return findings.agg(F.count("*").alias("total"), *tiers).withColumn("suppressed", F.lit(suppressed).cast("long"))


def on_added_lines(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Rows (file, line) that stand on an added line."""
    return rows.join(added.select(F.col("path").alias("file"), "line").distinct(), ["file", "line"], "left_semi")


def reaches(findings: DataFrame, least: str) -> DataFrame:
    """Findings at or above a severity: a gate fails if there is one."""
    return findings.filter(sev.rank(F.col("severity")) >= sev.RANK[least])
