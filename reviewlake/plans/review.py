"""A review from a change set to ordered findings and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import complexity, external, findings, graph, heuristics, history, reports
from ..sources.external import absent

# Change sizes beyond which the deep collectors rest.
MAX_FILES, MAX_LINES = 600, 30_000


def change_size(added: DataFrame) -> DataFrame:
    """One row: files and lines of a change set's (path, line) rows."""
    return added.agg(F.count_distinct("path").alias("files"), F.count("*").alias("lines"))


def too_large(files: Column, lines: Column) -> Column:
    return (files > MAX_FILES) | (lines > MAX_LINES)


@dataclass
class Context:
    """The tables of one review; those that are missing leave their collectors silent."""

    spark: SparkSession
    files: DataFrame  # path, removed_count, added_count, is_new, is_deleted
    added: DataFrame  # path, file_ord, line, text
    mode: str = "working"
    coverage: list[tuple] = field(default_factory=list)  # (report, file, line, hits), label, epoch seconds of the report
    mutants: list[tuple] = field(default_factory=list)  # (report, file, line, desc, no_coverage), epoch seconds of the report
    modified: DataFrame | None = None  # path, modified: when changed files were last written
    commits: DataFrame | None = None
    existing: DataFrame | None = None
    tools: dict[str, DataFrame] = field(default_factory=dict)
    vulnerabilities: tuple[DataFrame, DataFrame | None, str] | None = None
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    occurrences: DataFrame | None = None
    functions: tuple[DataFrame, DataFrame] | None = None

    def reviewable(self) -> DataFrame:
        """Added lines of files that exist and were not generated."""
        live = self.files.filter(~F.col("is_deleted") & ~paths.is_generated(F.col("path"))).select("path").distinct()
        return self.added.join(live, "path", "left_semi")

    def reported(self, when: float | None) -> DataFrame:
        """Reviewable lines of files that did not change after a report; unknown times pass."""
        lines = self.reviewable()
        if when is None or self.modified is None:
            return lines
        timed = lines.join(self.modified.select("path", "modified"), "path", "left").withColumn("__at", F.timestamp_micros(F.lit(int(when * 1e6))))
        return reports.fresh(timed, "modified", "__at").drop("modified", "__at")


class Collector(Protocol):
    name: str
    deep: bool

    def run(self, ctx: Context) -> DataFrame | None: ...


@dataclass(frozen=True)
class Simple:
    """A collector from a function."""

    name: str
    fn: Callable[[Context], DataFrame | None]
    deep: bool = False

    def run(self, ctx: Context) -> DataFrame | None:
        return self.fn(ctx)


def _external(ctx: Context) -> DataFrame | None:
    parts = [external.tool_findings(rows, tool, ctx.added, ctx.mode) for tool, rows in ctx.tools.items()]
    if ctx.vulnerabilities:
        parts.append(external.vulnerability_findings(*ctx.vulnerabilities))
    return findings.union(parts) if parts else None


def _history(ctx: Context) -> DataFrame | None:
    if ctx.commits is None or ctx.mode == "all":
        return None
    changed = ctx.reviewable().select("path", "file_ord", "line")
    return history.run(ctx.commits, changed, ctx.existing)


COLLECTORS: list[Collector] = [
    Simple("secrets", lambda c: heuristics.secrets(c.reviewable())),
    Simple("heuristics", lambda c: heuristics.run(c.reviewable())),
    Simple("external", _external),
    Simple("coverage", lambda c: findings.union([reports.coverage_findings(c.reported(when), rows, label) for rows, label, when in c.coverage]) if c.coverage else None),
    Simple("mutation", lambda c: findings.union([reports.mutation_findings(c.reported(when), rows) for rows, when in c.mutants]) if c.mutants else None),
    Simple("history", _history),
    Simple("blast-radius", lambda c: graph.blast_findings(c.symbols, c.reviewable(), c.edges, c.occurrences) if c.symbols is not None and c.edges is not None else None, deep=True),
    Simple("complexity", lambda c: complexity.complexity_findings(*c.functions, c.reviewable()) if c.functions else None, deep=True),
]


@dataclass
class Report:
    findings: DataFrame
    notes: list[str]
    collectors_run: list[str]
    adapters_absent: list[str]

    def summary(self, suppressed: int = 0) -> DataFrame:
        return findings.summary(self.findings, suppressed)


def review(ctx: Context, collectors: list[Collector] | None = None, deep: bool = True, home: str | None = None) -> Report:
    """Run the collectors, keep the first of equal findings, and put them in order.

    The size check is the one action; everything else is one lazy plan.
    """
    notes: list[str] = []
    size = change_size(ctx.added).select("files", "lines", too_large(F.col("files"), F.col("lines")).alias("large")).first()
    if size["large"]:
        deep = False
        notes.append(f"large change ({size['files']} files, {size['lines']} lines): deep analysis was left out")
    parts, ran = [], []
    for c in collectors if collectors is not None else COLLECTORS:
        if c.deep and not deep:
            continue
        out = c.run(ctx)
        if out is not None:
            parts.append(out)
            ran.append(c.name)
    rows = findings.union(parts) if parts else ctx.spark.createDataFrame([], findings.DDL)
    kept = findings.in_order(findings.first_wins(rows)).drop(*findings.ORDINALS) if parts else rows
    return Report(kept, notes, ran, absent(home))

