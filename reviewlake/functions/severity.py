"""Severities, tiers and the level names of other formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from most to least, their ranks and tiers.
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
TIER = {"critical": "must-fix", "high": "must-fix", "medium": "concern", "low": "nit", "info": "nit"}
TIERS = ("must-fix", "concern", "nit")
CATEGORIES = ("security", "correctness", "impact", "maintainability", "hygiene", "supplychain")


def lookup(key: Column, table: dict, default=None) -> Column:
    """A literal table as a chain of conditions: constant, code-generated, null-safe."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def parse(s: Column) -> Column:
    """The severity of that name in any case, else null."""
    return F.when(F.lower(s).isin(*RANK), F.lower(s))


def rank(s: Column) -> Column:
    return lookup(s, RANK)


def tier(s: Column) -> Column:
    return lookup(s, TIER)


def from_level(level: Column) -> Column:
    """SARIF and adapter levels to severities."""
    return lookup(level, {"error": "high", "warning": "medium"}, "low")


def to_level(severity: Column) -> Column:
    return lookup(severity, {"critical": "error", "high": "error", "medium": "warning"}, "note")


def category_tag(category: Column) -> Column:
    return F.when(category == "supplychain", F.lit("supply-chain")).otherwise(category)
