"""Structured Streaming twins whose state is bounded by watermarks alone: fingerprint dedup and ledger counts.

``stateful`` has those that need timers: decay, first-wins with a lifetime, and the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_findings(stream: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Findings whose fingerprint was not seen within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def ledger_counts(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Ledger events by repository, kind and window of time."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), "repo", "event").agg(F.count("*").alias("n"))
