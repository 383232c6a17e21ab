"""Stores of learned feedback that several reviews write to at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import Log
from . import memory


class SuppressionStore:
    """Dismissals, acceptances and mutes: ``evaluate`` findings, ``record`` entries, ``list`` what holds.

    Every record is a commit of its own, so writers do not undo each other; of a key the entry
    of the last commit holds.  ``seed`` is what an earlier store held.
    """

    def __init__(self, spark: SparkSession, path: str, seed: DataFrame | None = None):
        self.log = Log(spark, path, f"{memory.LEARNING_DDL}, gone boolean")
        self.seed = seed

    def _fold(self, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c != "__commit"]
        last = rows.groupBy(memory.learning_key().alias("__key")).agg(F.max(F.struct("__commit", "at", *[c for c in fields if c != "at"])).alias("e"))
        return last.select("e.*").select(*fields)

    def list(self) -> DataFrame:
        rows = self.log.read()
        if self.seed is not None:
            rows = self.seed.withColumn("gone", F.lit(False)).withColumn("__commit", F.lit(0).cast("long")).select(*rows.columns).union(rows)
        return self._fold(rows).filter("not gone").drop("gone")

    def record(self, entries: DataFrame) -> int:
        return self.log.append(memory.upsert(entries.limit(0), entries).withColumn("gone", F.lit(False)))

    def forget(self, where: Column) -> int:
        """Remove what holds and meets a condition."""
        return self.log.append(self.list().filter(F.coalesce(where, F.lit(False))).withColumn("gone", F.lit(True)))

    def evaluate(self, candidates: DataFrame, now: str, **options) -> DataFrame:
        """One decision for each (fingerprint, rule_id, text); see ``memory.decide``."""
        return memory.decide(candidates, self.list(), now, **options)

    def compact(self) -> int | None:
        """Fold all commits in one; keys that are gone leave the log."""
        return self.log.compact(lambda rows: self._fold(rows).filter("not gone")) if self.seed is None else None


class MemoryStore:
    """Notes and accepted findings; near copies of what is remembered add nothing.

    Two writers that remember near copies at the same moment both succeed; equal ids are one.
    """

    def __init__(self, spark: SparkSession, path: str, seed: DataFrame | None = None):
        self.log = Log(spark, path, memory.MEMORY_DDL)
        self.seed = seed

    def _fold(self, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c != "__commit"]
        return rows.groupBy("id").agg(F.min(F.struct("__commit", *[c for c in fields if c != "id"])).alias("e")).select("id", "e.*").select(*fields)

    def list(self) -> DataFrame:
        rows = self.log.read()
        if self.seed is not None:
            rows = self.seed.withColumn("__commit", F.lit(0).cast("long")).select(*rows.columns).union(rows)
        return self._fold(rows)

    def remember(self, new: DataFrame, now: str, **options) -> int:
        return self.log.append(memory.added(self.list(), new, now, **options))

    def recall(self, query: Column, limit: int = memory.RECALL_LIMIT, **options) -> DataFrame:
        return memory.recall(self.list(), query, limit, **options)

    def compact(self) -> int | None:
        return self.log.compact(self._fold) if self.seed is None else None
