"""Findings from other tools' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import findings

#: Category and confidence by tool, and whether its findings must stand on added lines.
KINDS = {"semgrep": ("security", 0.7, True), "ast-grep": ("correctness", 0.7, True), "gitleaks": ("security", 0.9, False)}
#: Modes in which a secret scanner's report speaks of the change.
SECRET_MODES = ("staged", "working")


def tool_findings(rows: DataFrame, tool: str, added: DataFrame, mode: str = "working") -> DataFrame:
    """From (rule, file, line, severity, message) rows of one tool."""
    category, confidence, only_added = KINDS[tool]
    if tool == "gitleaks" and mode not in SECRET_MODES:
        rows = rows.limit(0)
    if only_added:
        rows = findings.on_added_lines(rows, added)
    rows = rows.withColumn("line_ord", F.col("line"))
    return findings.make(rows, rule_id=F.concat(F.lit(f"{tool}."), F.col("rule")), category=category, severity="severity", confidence=confidence, title="rule", message="message", anchor_kind="external", anchor_detail="rule", source=tool, collector="external", key=F.concat_ws(":", "file", "rule", F.col("line").cast("string")))


def introduced(head: DataFrame, base: DataFrame | None) -> DataFrame:
    """Vulnerabilities of the head that the base did not have; without a base all of them."""
    return head if base is None else head.join(base, ["id", "ecosystem", "name", "version"], "left_anti")


def vulnerability_findings(head: DataFrame, base: DataFrame | None, lock_file: str) -> DataFrame:
    new = introduced(head, base).withColumn("file", F.lit(lock_file)).withColumn("line", F.lit(1))
    package = F.concat_ws("@", "name", "version")
    return findings.make(new, rule_id=F.concat(F.lit("supplychain."), F.col("id")), category="supplychain", severity="high", confidence=0.85, title=F.concat(F.lit("Vulnerable dependency "), package), message=F.concat(package, F.lit(" ("), F.col("ecosystem"), F.lit("): "), F.col("summary")), anchor_kind="external", anchor_detail="id", source="osv-scanner", collector="external", key=F.concat_ws(":", "file", "id", "ecosystem", "name", "version"))
