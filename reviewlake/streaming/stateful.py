"""Stateful streams: suppressions that decay by themselves, first-wins findings, and the review ledger.

Each is a ``transformWithState`` processor.  State lives in the RocksDB store, keyed and read
entry by entry, so that a key with many entries does not meet in memory; timers and state TTL
end what is over, so that state is bounded by what is alive, not by what was ever seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.audit import TRACES
from ..operators.memory import EXACT_DAYS, SEMANTIC_DAYS, learning_key
from ..runtime import ship

DAY_MS = 86_400_000
#: Repositories whose ledger heard nothing for so long are forgotten.
QUIET_DAYS = 30
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session's streams keep state in RocksDB, which processors with timers and TTL need."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None))


class Decay(StatefulProcessor):
    """The latest feedback of a key, and what time makes of it.

    A key holds at most one entry.  An entry that is as new as the stored one or newer replaces
    it, whatever its signal.  Timers fire at the end of either lifetime; the second removes the
    entry.  Mutes of a rule have no timers.
    """

    def __init__(self, exact_ms: int, semantic_ms: int):
        self.exact_ms, self.semantic_ms = exact_ms, semantic_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, signal string, scope string")

    def _out(self, key, state: str, at: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "state": [state], "at": [stamp(at)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            for at, signal, scope in zip(part["at_ms"].tolist(), part["signal"], part["scope"], strict=True):
                best = max(best or (at, signal, scope), (at, signal, scope))
        old = self.last.get() if self.last.exists() else None
        if best is None or (old is not None and old[0] > best[0]):
            return
        at, signal, scope = best
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        if signal == "accepted":
            self.last.update((at, signal, scope))
            self.handle.registerTimer(max(now, at + self.exact_ms))
            yield from self._out(key, "accepted", at)
        elif scope == "rule":
            self.last.update((at, signal, scope))
            yield from self._out(key, "muted", at)
        elif at + self.exact_ms <= now:
            self.last.clear()
            yield from self._out(key, "expired", at)
        else:
            self.last.update((at, signal, scope))
            self.handle.registerTimer(at + self.exact_ms)
            if at + self.semantic_ms > now:
                self.handle.registerTimer(at + self.semantic_ms)
                yield from self._out(key, "live", at)
            else:
                yield from self._out(key, "exact-only", at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        at, signal, _ = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= at + self.exact_ms:
            self.last.clear()
            yield from self._out(key, "forgotten" if signal == "accepted" else "expired", at)
        else:
            yield from self._out(key, "exact-only", at)

    def close(self) -> None:
        pass


def suppressions(feedback: DataFrame, exact_days: float = EXACT_DAYS, semantic_days: float = SEMANTIC_DAYS) -> DataFrame:
    """Changes (key, state, at) of the suppressions in a stream of (fingerprint, rule_id, signal, scope, at).

    ``at`` is a timestamp.  States: ``live`` (suppresses the finding and those like it),
    ``exact-only`` (the shorter lifetime is over), ``expired`` (both are, and the entry left the
    state), ``muted`` (never ages), ``accepted`` (no suppression) and ``forgotten`` (an accepted
    entry that left the state).  Rows without a time or a key say nothing.
    """
    with_state(feedback.sparkSession)
    rows = feedback.select(learning_key().alias("key"), F.unix_millis("at").alias("at_ms"), F.coalesce("signal", F.lit("dismissed")).alias("signal"), F.coalesce("scope", F.lit("finding")).alias("scope"))
    rows = rows.filter("key is not null and at_ms is not null")
    decay = Decay(int(exact_days * DAY_MS), int(semantic_days * DAY_MS))
    return rows.groupBy("key").transformWithStateInPandas(decay, "key string, state string, at timestamp_ntz", "update", "processingTime")


class First(StatefulProcessor):
    """Passes the first row of a key on; a key that was not seen again for ``keep_ms`` is forgotten.

    Rows come one by one: a key has few, and a frame for each key costs far more than its rows.
    """

    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, first, latest = None, None, 0
        for row in rows:
            *values, us, order = row[-len(self.columns) - 2 :]  # by place: computed columns come without their names
            at, latest = (us, order is None, order), max(latest, us) if first else us
            if first is None or at[:2] < best[:2] or (at[:2] == best[:2] and not at[1] and at[2] < best[2]):
                best, first = at, values
        until = latest // 1000 + self.keep_ms
        old = self.seen.get() if self.seen.exists() else None
        if old is None:
            yield Row(*self.columns)(*first)
            self.seen.update((until,))
            self.handle.registerTimer(until)
        elif until > old[0]:
            self.seen.update((until,))  # the timer that is set finds it and sets the next

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            (until,) = self.seen.get()
            if until <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1):
                self.seen.clear()
            else:
                self.handle.registerTimer(until)
        yield from ()

    def close(self) -> None:
        pass


def first_wins(findings: DataFrame, ts: str = "ts", key: str = "id", order: str | None = None, delay: str = "10 minutes", keep_days: float = QUIET_DAYS) -> DataFrame:
    """The first finding of every fingerprint, while the fingerprint keeps coming.

    Of the rows of one batch the earliest wins, of equal times the smallest ``order``.  A
    fingerprint is forgotten when event time is ``keep_days`` past its last row, so that a
    finding that went and came back is reported again.
    """
    with_state(findings.sparkSession)
    columns = findings.columns
    rows = findings.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__ord", F.col(order) if order else F.lit(0))
    out = StructType([f for f in findings.schema if f.name in columns])
    return rows.groupBy(key).transformWithState(First(columns, int(keep_days * DAY_MS)), out, "append", "eventTime")


class Ledger(StatefulProcessor):
    """One repository's review: floor findings and their fates, changed exports and their looks.

    Entries are read and written one by one, once a batch however many events they have; the counts
    of a repository are kept beside them, so that an event costs the same however long the review
    is.  A ``start`` drops what came before.
    """

    COUNTS = ("floor", "dismissed", "accepted", "symbols", "traced", "inspect_calls")

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # TTL drops every entry that was not written for so long, the counts with the rest.
        self.fate = handle.getMapState("fate", "id string", "fate string", self.quiet_ms)
        self.users = handle.getMapState("users", "symbol string", "files long, traced boolean", self.quiet_ms)
        self.exports = handle.getMapState("exports", "file string, symbol string", "n long", self.quiet_ms)
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in self.COUNTS), self.quiet_ms)

    @staticmethod
    def _gather(rows) -> tuple[bool, dict, dict, set, set, int]:
        """What a batch says after its last start: whether there is one, and each entry once.

        The order of events matters to starts and fates alone, so rows are folded as they come,
        each entry with its last place; places before the last start fall away at the end.
        """
        start, floor, fate, pairs, seen, looks = None, {}, {}, {}, {}, []
        for n, row in enumerate(rows):
            seq, event, k, value = row[-4:]
            at = (float("inf") if seq is None else seq, n)
            if event == "start":
                start = max(start or at, at)
            elif event == "inspect":
                looks.append(at)
                if k is not None and value in TRACES:
                    seen[k] = max(seen.get(k, at), at)
            elif k is None:
                pass
            elif event == "floor":
                floor[k] = max(floor.get(k, at), at)
            elif event in ("dismissed", "accepted"):
                fate[k] = max(fate.get(k, (at, event)), (at, event))
            elif event == "symbol":
                pairs[value or "", k] = max(pairs.get((value or "", k), at), at)
        late = lambda at: start is None or at > start
        last = {k: event for k, (at, event) in fate.items() if late(at)}
        floor, pairs, seen = ({k for k, at in x.items() if late(at)} for x in (floor, pairs, seen))
        return start is not None, last, floor, pairs, seen, sum(map(late, looks))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        begun, fates, floor, pairs, seen, looks = self._gather(rows)
        # Entries are never younger than the counts: without counts there is nothing to read or to drop.
        known = self.counts.exists()
        if begun:
            if known:
                for state in (self.fate, self.users, self.exports):
                    state.clear()
            known, c = False, dict.fromkeys(self.COUNTS, 0)
        elif known:
            c = dict(zip(self.COUNTS, self.counts.get(), strict=True))
        else:  # nothing counts before a review began
            return
        c["inspect_calls"] += looks
        for k in floor | fates.keys():
            # A fate may come before its finding; it counts once the finding is there.
            old = self.fate.getValue((k,))[0] if known and self.fate.containsKey((k,)) else ""
            had, was = old[:1] == "+", old.lstrip("+")
            has, now = had or k in floor, fates.get(k, was)
            if had and was:
                c[was] -= 1
            if has and now:
                c[now] += 1
            c["floor"] += has - had
            if k in fates or has != had:
                self.fate.updateValue((k,), ("+" * has + now,))
        new = [p for p in pairs if not (known and self.exports.containsKey(p))]
        more = Counter(k for _, k in new)
        c["symbols"] += len(new)
        for pair in new:
            self.exports.updateValue(pair, (1,))
        for k in more.keys() | seen:
            files, was = self.users.getValue((k,)) if known and self.users.containsKey((k,)) else (0, False)
            now = was or k in seen
            c["traced"] += (files + more[k]) * now - files * was
            if more[k] or now != was:
                self.users.updateValue((k,), (files + more[k], now))
        self.counts.update(tuple(int(c[x]) for x in self.COUNTS))
        row = {"repo": key[0], **{x: int(c[x]) for x in self.COUNTS}}
        row["unaccounted"] = row["floor"] - row["dismissed"] - row["accepted"]
        row["untraced"] = row["symbols"] - row["traced"]
        row["clean"] = row["unaccounted"] == 0 and row["untraced"] == 0
        yield Row(**row)

    def close(self) -> None:
        pass


def ledger(events: DataFrame, quiet_days: float = QUIET_DAYS) -> DataFrame:
    """The audit's ratios of every repository, anew after each batch with events of it.

    ``events`` is a stream of (repo, seq, event, key, value) as in ``operators.audit``; a batch's
    events count in the order of ``seq``.  Exports are told apart by file and symbol; findings
    by id.  A repository whose ledger heard nothing for ``quiet_days`` is forgotten entry by
    entry, and counts again from its next start.
    """
    with_state(events.sparkSession)
    out = "repo string, " + ", ".join(f"{c} long" for c in Ledger.COUNTS) + ", unaccounted long, untraced long, clean boolean"
    rows = events.filter("repo is not null").select("repo", "seq", "event", "key", "value")
    return rows.groupBy("repo").transformWithState(Ledger(int(quiet_days * DAY_MS)), out, "update", "processingTime")

