"""Reports of other tools as tables; the tools themselves are never started."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, severity

TOOLS = ("semgrep", "ast-grep", "gitleaks", "osv-scanner")
#: Where reports are looked for, and their names.
PLACE = ".review/reports"
REPORTS = {"semgrep": "semgrep.sarif", "ast-grep": "ast-grep.json", "gitleaks": "gitleaks.json", "osv": "osv.json", "osv-base": "osv-base.json"}
SARIF = "struct<runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>>>>>"
AST_GREP = "array<struct<ruleId:string,file:string,range:struct<start:struct<line:bigint>>,message:string,severity:string>>"
GITLEAKS = "array<struct<RuleID:string,Description:string,File:string,StartLine:bigint>>"
OSV = "struct<results:array<struct<packages:array<struct<package:struct<name:string,ecosystem:string,version:string>,vulnerabilities:array<struct<id:string,summary:string>>>>>>>"


def absent(home: str | None = None) -> list[str]:
    """Tools that cannot run here, for the report's note: not installed, or a scanner without a local rule set."""
    out = [t for t in TOOLS if shutil.which(t) is None]
    if home and "semgrep" not in out and offline_ruleset(home) is None:
        out.append("semgrep (no local rule set)")
    return out


def offline_ruleset(home: str, variable: str = "RULESET") -> str | None:
    """A local rule set for a scanner: what the environment names, else a file below ``home``."""
    own = os.environ.get(variable)
    if own:
        return own if os.path.exists(own) else None
    default = os.path.join(home, "rules")
    return default if os.path.exists(default) else None


def find(root: str, folder: str = PLACE) -> dict[str, str]:
    """The reports that tools left below a root, by tool; ``osv-base`` is the one of the base."""
    found = {tool: os.path.join(root, folder, name) for tool, name in REPORTS.items()}
    return {tool: path for tool, path in found.items() if os.path.isfile(path)}


def read(reports: DataFrame, tool: str, root: str) -> DataFrame:
    """(rule, file, line, severity, message) of one tool's (text) reports, files relative to the root."""
    rows = sarif(reports, root) if tool == "semgrep" else ast_grep(reports) if tool == "ast-grep" else gitleaks(reports)
    return rows.withColumn("file", paths.relative(F.col("file"), root))


def _or(c: str, default) -> F.Column:
    return F.coalesce(F.col(c), F.lit(default))


def sarif(reports: DataFrame, root: str = "") -> DataFrame:
    """(rule, file, line, severity, message): the first location of every result."""
    runs = reports.select(F.explode(F.from_json("text", SARIF)["runs"]).alias("r"))
    rows = runs.select(F.explode("r.results").alias("x")).withColumn("at", F.get("x.locations", F.lit(0))["physicalLocation"])
    file = paths.relative(F.col("at.artifactLocation.uri"), root) if root else F.col("at.artifactLocation.uri")
    rows = rows.select(_or("x.ruleId", "rule").alias("rule"), file.alias("file"), _or("at.region.startLine", 1).cast("int").alias("line"), severity.from_level(_or("x.level", "warning")).alias("severity"), _or("x.message.text", "").alias("message"))
    return rows.filter("file is not null")


def ast_grep(reports: DataFrame) -> DataFrame:
    """Matches; their lines count from 0."""
    rows = reports.select(F.explode(F.from_json("text", AST_GREP)).alias("x")).filter("x.file is not null")
    return rows.select(_or("x.ruleId", "rule").alias("rule"), F.col("x.file").alias("file"), (_or("x.range.start.line", 0) + 1).cast("int").alias("line"), severity.from_level(_or("x.severity", "warning")).alias("severity"), _or("x.message", "").alias("message"))


def gitleaks(reports: DataFrame) -> DataFrame:
    rows = reports.select(F.explode(F.from_json("text", GITLEAKS)).alias("x")).filter("x.File is not null")
    return rows.select(_or("x.RuleID", "secret").alias("rule"), F.col("x.File").alias("file"), _or("x.StartLine", 1).cast("int").alias("line"), F.lit("critical").alias("severity"), _or("x.Description", "").alias("message"))


def osv(reports: DataFrame) -> DataFrame:
    """(id, ecosystem, name, version, summary) of every vulnerability of every package."""
    pkgs = reports.select(F.explode(F.from_json("text", OSV)["results"]).alias("r")).select(F.explode("r.packages").alias("p"))
    rows = pkgs.select("p.package", F.explode("p.vulnerabilities").alias("v"))
    return rows.select(_or("v.id", "VULN").alias("id"), _or("package.ecosystem", "unknown").alias("ecosystem"), _or("package.name", "dependency").alias("name"), _or("package.version", "unknown").alias("version"), _or("v.summary", "Known vulnerability").alias("summary"))
