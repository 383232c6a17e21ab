import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import audit
from reviewlake.streaming import stateful

FEEDBACK = "fingerprint string, rule_id string, signal string, scope string, at timestamp"
EVENTS = "repo string, seq long, event string, key string, value string"


class Feed:
    """A stream over files that a test adds, into a table in memory."""

    def __init__(self, spark, folder, ddl, make, mode, name):
        self.spark, self.folder, self.ddl, self.name, self.n = spark, folder, ddl, name, 0
        (folder / "in").mkdir()
        stateful.with_state(spark)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2000")
        stream = spark.readStream.schema(ddl).parquet(str(folder / "in"))
        self.rows_in = 0
        self.query = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "state")).trigger(processingTime="1 second").start()

    def add(self, *rows):
        """One file, until its batch is done.  Timers of the clock make batches without end, so it is rows that count."""
        self.n += 1
        self.spark.createDataFrame(list(rows), self.ddl).coalesce(1).write.parquet(str(self.folder / f"part{self.n}"))
        (file,) = (self.folder / f"part{self.n}").glob("*.parquet")
        file.rename(self.folder / "in" / f"{self.n}.parquet")
        self.rows_in += len(rows)
        self.wait(lambda: sum(p["numInputRows"] for p in self.query.recentProgress) >= self.rows_in)

    def rows(self):
        return [tuple(r) for r in self.spark.table(self.name).collect()]

    def wait(self, done, seconds=60):
        end = time.monotonic() + seconds
        while time.monotonic() < end and self.query.isActive and not done():
            time.sleep(0.3)
        assert done(), (self.query.exception(), self.rows())

    def state_rows(self):
        last = self.query.lastProgress
        return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0


@pytest.fixture
def feed(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    made = []

    def start(*args):
        made.append(Feed(spark, tmp_path, *args))
        return made[-1]

    yield start
    for f in made:
        f.query.stop()
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_suppression_ends_by_itself(feed):
    """Both lifetimes pass on the clock, without another event, and the entry leaves the state."""
    f = feed(FEEDBACK, lambda s: stateful.suppressions(s, exact_days=40 / 86400, semantic_days=20 / 86400), "update", "decay")
    now = datetime.now()
    old = now - timedelta(days=1)
    f.add(("a", "r", "dismissed", "finding", now), ("b", "r", "dismissed", "finding", old), ("", "r", "dismissed", "rule", old), ("c", "r", "accepted", "finding", now), (None, "r", "dismissed", "finding", now), ("d", "r", "dismissed", "finding", None))
    assert sorted((k, s) for k, s, _ in f.rows()) == [("fp:a", "live"), ("fp:b", "expired"), ("fp:c", "accepted"), ("rule:r", "muted")]
    f.wait(lambda: ("fp:a", "expired") in [r[:2] for r in f.rows()] and ("fp:c", "forgotten") in [r[:2] for r in f.rows()])
    assert [s for k, s, _ in f.rows() if k == "fp:a"] == ["live", "exact-only", "expired"]
    assert [s for k, s, _ in f.rows() if k == "rule:r"] == ["muted"]
    f.add(("e", "r", "dismissed", "finding", old))
    left = f.query.recentProgress
    assert left[-1]["stateOperators"][0]["numRowsRemoved"] >= 0
    assert f.state_rows() < max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in left)


def test_the_latest_feedback_holds(feed):
    f = feed(FEEDBACK, stateful.suppressions, "update", "latest")
    now = datetime.now()
    at = lambda days: now - timedelta(days=days)
    f.add(("a", "r", "dismissed", "finding", at(100)), ("b", "r", "dismissed", "finding", at(10)))
    f.add(("a", "r", "dismissed", "finding", at(5)), ("b", "r", "accepted", "finding", at(50)))
    f.add(("a", "r", "accepted", "finding", at(1)))
    got = [r[:2] for r in f.rows()]
    assert sorted(got[:2]) == [("fp:a", "exact-only"), ("fp:b", "live")]
    assert got[2:] == [("fp:a", "live"), ("fp:a", "accepted")]  # the older word about b changes nothing


def test_first_findings(feed):
    ddl = "id string, ts timestamp, ord int, file string"
    f = feed(ddl, lambda s: stateful.first_wins(s, order="ord", delay="0 seconds", keep_days=1), "append", "firsts")
    day = lambda d, h=0: datetime(2026, 6, d, h)
    f.add(("x", day(1), 2, "late"), ("x", day(1), 1, "won"), ("y", day(1, 1), 1, "won"), (None, day(1), 1, "no"))
    f.add(("x", day(1, 12), 0, "again"), ("z", day(1, 13), 1, "won"))
    f.add(("w", day(4), 1, "won"))
    f.add(("v", day(4, 1), 1, "won"))  # the watermark is past the first day's keys now
    f.add(("x", day(4, 2), 1, "back"), ("w", day(4, 3), 0, "again"))
    assert sorted((i, file) for i, _, _, file in f.rows()) == [("v", "won"), ("w", "won"), ("x", "back"), ("x", "won"), ("y", "won"), ("z", "won")]


def test_the_ledger_agrees_with_the_batch(spark, feed):
    f = feed(EVENTS, stateful.ledger, "update", "ledger")
    one = [("r", 0, "floor", "early", None), ("r", 1, "start", None, None), ("r", 2, "floor", "f1", None), ("r", 3, "floor", "f2", None), ("r", 4, "floor", "f1", None), ("r", 5, "symbol", "go", "a.ts"), ("r", 6, "symbol", "go", "b.ts"), ("r", 7, "symbol", "run", "a.ts"), ("s", 1, "floor", "none began", None)]
    two = [("r", 8, "inspect", "go", "callers"), ("r", 9, "inspect", "run", "definition"), ("r", 10, "dismissed", "f1", None), ("r", 11, "accepted", "f1", None), ("r", 12, "accepted", "f9", None), ("s", 2, "start", None, None), ("s", 3, "floor", "g", None), ("s", 4, "accepted", "g", None)]
    three = [("r", 13, "floor", "f9", None), ("s", 5, "start", None, None)]
    seen = []
    for batch in (one, two, three):
        f.add(*batch)
        seen += batch
        ledger = audit.current(spark.createDataFrame(seen, EVENTS))
        names = ["repo", "floor", "symbols", "inspect_calls", "dismissed", "unaccounted", "untraced", "traced", "clean"]
        fates = audit.fates(ledger).join(ledger.filter("event = 'floor'").select("repo", F.col("key").alias("id")).distinct(), ["repo", "id"], "left_semi")
        want = {r["repo"]: r for r in audit.ratios(ledger).collect()}
        fated = {(r["repo"], r["fate"]): r["count"] for r in fates.groupBy("repo", "fate").count().collect()}
        last = {}
        for r in f.spark.table("ledger").collect():
            last[r["repo"]] = r
        for repo, w in want.items():
            got = last.get(repo)
            if got is None:
                assert w["floor"] == w["symbols"] == 0
                continue
            if w["floor"] + w["symbols"] + w["inspect_calls"]:
                assert [got[n] for n in names if n != "dismissed"] == [w[n] for n in names if n != "dismissed"], repo
                assert (got["dismissed"], got["accepted"]) == (fated.get((repo, "dismissed"), 0), fated.get((repo, "accepted"), 0))
    assert last["s"]["floor"] == 0 and last["s"]["clean"]


def test_a_quiet_ledger_is_forgotten(feed):
    f = feed(EVENTS, lambda s: stateful.ledger(s, quiet_days=8 / 86400), "update", "quiet")
    f.add(("r", 1, "start", None, None), ("r", 2, "floor", "f1", None))
    time.sleep(9)
    f.add(("r", 3, "floor", "f2", None))
    assert [r[1] for r in f.rows()] == [1]


class Counted:
    """State in a dict that counts how often it is asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._call(() in self.held)

    def get(self):
        return self._call(self.held.get(()))

    def update(self, value):
        self._call(self.held.update({(): value}))

    def containsKey(self, k):
        return self._call(k in self.held)

    def getValue(self, k):
        return self._call(self.held.get(k))

    def updateValue(self, k, value):
        self._call(self.held.update({k: value}))

    def clear(self):
        self._call(self.held.clear())

    def registerTimer(self, at):
        self._call()

    deleteTimer = registerTimer


def test_a_known_fingerprint_costs_a_look_and_a_write():
    """Rows come without a frame for each key, and the timer moves only when it fires."""
    p = stateful.First(["id", "file"], 1000)
    p.seen, p.handle = Counted(), Counted()
    rows = [("x", "late", 7000, 2), ("x", "none", 7000, None), ("x", "won", 7000, 1), ("x", "newest", 9000, 0)]
    assert [tuple(r) for r in p.handleInputRows(("x",), iter(rows), None)] == [("x", "won")]
    assert list(p.handleInputRows(("x",), iter([("x", "again", 8_000_000, 0)]), None)) == []
    assert (p.seen.held[()], p.handle.calls) == ((9000,), 1)


def test_a_ledger_entry_is_written_once_a_batch():
    """However many events an entry has; without a review before there is nothing to read."""
    p = stateful.Ledger(1000)
    p.fate, p.users, p.exports, p.counts = (Counted() for _ in range(4))
    rows = [("r", 0, "floor", "early", None), ("r", 1, "start", None, None)]
    for n in range(2, 302):
        event, value = [("floor", None), ("dismissed", None), ("accepted", None), ("symbol", "a.ts"), ("inspect", "callers")][n % 5]
        rows.append(("r", n, event, f"k{n % 3}", value))
    (got,) = p.handleInputRows(("r",), iter(rows[::-1]), None)
    assert got.asDict() | {"repo": "r", "floor": 3, "symbols": 3, "traced": 3, "inspect_calls": 60, "unaccounted": 0, "untraced": 0, "clean": True} == got.asDict()
    assert (got["dismissed"], got["accepted"]) == (2, 1)  # the last words are 299, 297 and 298... by key
    assert p.fate.calls + p.users.calls + p.exports.calls == 9
    (got,) = p.handleInputRows(("r",), iter([("r", 400, "dismissed", "k0", None), ("r", 401, "accepted", "k0", None)]), None)
    assert got["accepted"] + got["dismissed"] == 3 and p.fate.held["k0",] == ("+accepted",)
