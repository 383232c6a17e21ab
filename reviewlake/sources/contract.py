"""A repository's review contract: muted rules and skipped paths in a text file."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex

DIRECTIVE = re.compile(r"^\s*(?:-\s*)?(mute|skip):\s*(\S+)", re.MULTILINE)
NAME = "REVIEW.md"


@dataclass(frozen=True)
class Contract:
    raw: str = ""
    muted_rules: list[str] = field(default_factory=list)
    skip_paths: list[str] = field(default_factory=list)
    source: str = "none"


def parse(raw: str, source: str) -> Contract:
    found = DIRECTIVE.findall(raw)
    return Contract(raw, [v for k, v in found if k == "mute"], [v for k, v in found if k == "skip"], source)


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def load(repo: str, home: str, name: str = NAME, home_folder: str = ".review") -> Contract:
    """The repository's contract over the user's: both hold, the repository's text comes last."""
    own, user = _read(os.path.join(repo, name)), _read(os.path.join(home, home_folder, name))
    parts = [p for p in (user, own) if p is not None]
    return parse("\n".join(parts), "repo" if own is not None else "user" if user is not None else "none")


def policy(findings: DataFrame, contract: Contract) -> DataFrame:
    """Findings with ``reason``: why the contract drops them, null if it does not."""
    reason = F.lit(None).cast("string")
    for g in reversed(contract.skip_paths):
        reason = F.when(F.rlike("file", F.lit(glob_regex(g))), F.lit(f"path is skipped: {g}")).otherwise(reason)
    if contract.muted_rules:
        reason = F.when(F.col("rule_id").isin(*contract.muted_rules), F.concat(F.lit("rule is muted: "), F.col("rule_id"))).otherwise(reason)
    return findings.withColumn("reason", reason)
