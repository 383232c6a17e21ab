"""Learned feedback: suppression, reinforcement, decay, recall and the stores' upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import memory_id
from ..functions.text import age_days, dot, feature_hash, round3
from ..runtime import checkpoint, ship, spread
from .components import components
from .similarity import LOW_ROWS, alike, earlier_near, fronts, matrix, near, near_forest, similarity_pairs, turned

# Similarities and lifetimes in days.
SAME_RULE, ANY_RULE, REINFORCE, DUPLICATE = 0.82, 0.93, 0.80, 0.97
EXACT_DAYS, SEMANTIC_DAYS = 180, 90
EXEMPT = r"^(secret|security)\."
RECALL_LIMIT, RECALL_LEAST = 5, 0.2

LEARNING_DDL = "fingerprint string, rule_id string, text string, signal string, scope string, at string"
MEMORY_DDL = "id string, kind string, text string, scope string, file string, ts string, embedding array<double>"
#: Rows of a component that one task settles, and of those too large for that the rows of a round.
GIANT_ROWS, GIANT_BLOCK = 20_000, 4096
#: Rows, the first in order, that are settled before all others, and numbers that they hold at most.
FIRST_ROWS, FIRST_NUMBERS = 8192, 1 << 22

Embedder = Callable[[Column], Column]


def eligible(rule_id: Column) -> Column:
    return ~F.rlike(rule_id, F.lit(EXEMPT))


def decide(candidates: DataFrame, learnings: DataFrame, now: str, embed: Embedder = feature_hash, same_rule: float = SAME_RULE, any_rule: float = ANY_RULE, reinforce: float = REINFORCE, exact_days: float = EXACT_DAYS, semantic_days: float = SEMANTIC_DAYS) -> DataFrame:
    """One decision for each different candidate (fingerprint, rule_id, text).

    In this order: a fresh exact dismissal, a muted rule, a fresh similar dismissal, a stale
    dismissal (to validate again), similarity to an accepted finding, nothing.  Texts are
    compared once, however many candidates and learnings share them; they are named by hashes
    of their own, so that a retried task names them alike.
    """
    clock = F.lit(now)
    dismissed = learnings.filter("signal <> 'accepted'").withColumn("age", age_days(F.col("at"), clock))
    exact = dismissed.filter("scope <> 'rule'").groupBy("fingerprint").agg(F.max("at").alias("exact_at"))
    muted = dismissed.filter("scope = 'rule'").select("rule_id", F.lit(True).alias("muted")).distinct()
    cand = candidates.select("fingerprint", "rule_id", "text").distinct().withColumn("__text", F.xxhash64("text"))

    def texts(rows: DataFrame) -> DataFrame:
        return rows.select("text").distinct().select(F.xxhash64("text").alias("id"), embed(F.col("text")).alias("vec"))

    fresh = F.col("age") <= semantic_days
    entries = dismissed.groupBy("rule_id", "text").agg(F.max(fresh).alias("fresh"), F.max(F.when(~fresh, F.col("at"))).alias("stale_at"))
    entries = entries.select(F.col("rule_id").alias("er"), "fresh", "stale_at", F.xxhash64("text").alias("r"))
    asking = cand.filter(eligible(F.col("rule_id")))
    sims = similarity_pairs(texts(asking), texts(dismissed), min(same_rule, any_rule)).join(entries, "r")
    sims = sims.join(asking.select("rule_id", F.col("__text").alias("l")).distinct(), "l")
    same, sim, stale = F.col("er") == F.col("rule_id"), F.col("sim"), F.col("stale_at").isNotNull()
    best = sims.groupBy(F.col("l").alias("__text"), "rule_id").agg(
        F.max(F.when(F.col("fresh"), sim)).alias("best"),
        F.max(F.when(F.col("fresh") & same, sim)).alias("best_same"),
        F.max(F.when(stale, sim)).alias("stale_best"),
        F.max(F.when(stale & same, sim)).alias("stale_same"),
        F.max(F.when(stale, F.struct(sim, "stale_at")))["stale_at"].alias("stale_at"),
    )
    good = similarity_pairs(texts(cand), texts(learnings.filter("signal = 'accepted'")), reinforce)
    good = good.groupBy(F.col("l").alias("__text")).agg(F.max("sim").alias("reinforcement"))
    full = cand.join(exact, "fingerprint", "left").join(muted, "rule_id", "left").join(best, ["__text", "rule_id"], "left").join(good, "__text", "left")
    return cascade(full, clock, same_rule, any_rule, exact_days).select("fingerprint", "rule_id", "suppress", "kind", "similarity", "revalidate", "stale_since", "reinforce", F.when(F.col("reinforce"), F.col("reinforcement")).alias("reinforcement"))


def cascade(rows: DataFrame, clock: Column, same_rule: float = SAME_RULE, any_rule: float = ANY_RULE, exact_days: float = EXACT_DAYS) -> DataFrame:
    """The decision from its parts: exact_at, muted, best.., stale.., reinforcement."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    exact_fresh = F.coalesce(F.col("exact_at").isNotNull() & (age_days(F.col("exact_at"), clock) <= exact_days), F.lit(False))
    exact_stale = F.col("exact_at").isNotNull() & ~exact_fresh
    similar = (zero("best_same") >= same_rule) | (zero("best") >= any_rule)
    stale_similar = (zero("stale_same") >= same_rule) | (zero("stale_best") >= any_rule)
    muted = F.coalesce(F.col("muted"), F.lit(False))
    suppress = exact_fresh | muted | similar
    stale = ~suppress & (exact_stale | stale_similar)
    kind = F.when(exact_fresh, "exact").when(muted, "rule").when(similar, "semantic").when(exact_stale, "exact").when(stale_similar, "semantic")
    return (
        rows.withColumn("suppress", suppress)
        .withColumn("kind", kind)
        .withColumn("similarity", F.when(F.col("kind").eqNullSafe("semantic") & suppress, F.col("best")))
        .withColumn("revalidate", stale)
        .withColumn("stale_since", F.when(stale, F.when(exact_stale, F.col("exact_at")).otherwise(F.col("stale_at"))))
        .withColumn("reinforce", ~suppress & ~stale & F.col("reinforcement").isNotNull())
    )


def candidate_text() -> Column:
    """What findings are compared by."""
    return F.concat_ws(" ", "rule_id", "title", "message")


def apply(findings: DataFrame, learnings: DataFrame, now: str, **options) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) findings with the decision's columns beside them."""
    decided = decide(findings.select(F.col("id").alias("fingerprint"), "rule_id", candidate_text().alias("text")), learnings, now, **options)
    both = findings.join(decided.drop("rule_id").withColumnRenamed("fingerprint", "id"), "id", "left")
    return both.filter(~F.col("suppress")), both.filter("suppress")


# --- stores ------------------------------------------------------------------------------


def learning_key(scope: str = "scope", rule: str = "rule_id", fingerprint: str = "fingerprint") -> Column:
    return F.when(F.col(scope) == "rule", F.concat(F.lit("rule:"), F.col(rule))).otherwise(F.concat(F.lit("fp:"), F.col(fingerprint)))


def upsert(learnings: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace those of the same scope and key, whatever the signal; the latest new one wins.

    Of new entries with the same time the one with the greatest other fields wins.
    """
    fields = ["at", *[c for c in learnings.columns if c != "at"]]
    last = new.groupBy(learning_key().alias("__key")).agg(F.max(F.struct(*fields)).alias("e")).select("__key", "e.*")
    old = learnings.withColumn("__key", learning_key()).join(last.select("__key"), "__key", "left_anti")
    return old.drop("__key").unionByName(last.drop("__key").select(*learnings.columns))


def forget(learnings: DataFrame, where: Column) -> DataFrame:
    return learnings.filter(~F.coalesce(where, F.lit(False)))


def live(learnings: DataFrame, now: str, exact_days: float = EXACT_DAYS, semantic_days: float = SEMANTIC_DAYS) -> DataFrame:
    """With exact_live and semantic_live; mutes of a rule never age."""
    age = age_days(F.col("at"), F.lit(now))
    mute = F.col("scope") == "rule"
    return learnings.withColumn("exact_live", mute | (age <= exact_days)).withColumn("semantic_live", mute | (age <= semantic_days))


def _first(rows: DataFrame, many: int) -> tuple[int, pa.Table] | None:
    """The ``many`` rows of the smallest ids, and the last of these; ids are found first, so that no task gathers vectors."""
    last = rows.select("id").orderBy("id").limit(many).agg(F.max("id")).first()[0]
    return None if last is None else (last, rows.filter(F.col("id") <= last).toArrow().sort_by("id"))


def _wide(column: pa.ChunkedArray | pa.Array) -> int:
    return max(1, pc.max(pc.list_value_length(column)).as_py() or 0)


def _in_blocks(rest: DataFrame, least: float) -> DataFrame:
    """``later_copies`` of (id, vec) rows of components that are too large for one task.

    The first rows in order are settled at once; those that stay, GIANT_BLOCK vectors at most,
    go to every task, and what is near them goes.  So a round settles a block of rows that
    stay, and a large group of near copies is gone with its first row.
    """
    ship(rest.sparkSession)
    gone = None
    while found := _first(rest.select("id", "vec"), GIANT_BLOCK):
        last, rows = found
        wide = _wide(rows.column("vec"))
        x = matrix(rows.column("vec"), wide)
        out = earlier_near(x, least)
        stay = x[~out]

        def near_stay(batches, stay=stay, wide=wide):
            for b in batches:
                v = matrix(b.column(1), wide)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v @ stay.T >= least).any(axis=1))], ["id", "vec", "out"])

        left = checkpoint(rest.filter(F.col("id") > last).select("id", "vec").mapInArrow(near_stay, "id long, vec array<double>, out boolean"))
        first = rest.sparkSession.createDataFrame([(i,) for i in rows.column("id").filter(pa.array(out)).to_pylist()], "id long")
        found = left.filter("out").select("id").union(first)
        gone = found if gone is None else gone.union(found)
        rest = left.filter("not out").drop("out")
    return gone if gone is not None else rest.select("id")


def _small(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has few rows of few numbers, so that vectors stay where they are."""
    return F.broadcast(df) if df.count() <= LOW_ROWS else df


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which rows have a direction)."""
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
        some = np.isfinite(size) & (size > 0)
        return x / np.where(some, size, 1.0)[:, None], some


def _after_first(rows: DataFrame, least: float) -> DataFrame:
    """(id, kind, same, vec, gone) of (id, kind, vec) rows, once the first rows in order are settled.

    The FIRST_ROWS rows of the smallest ids are settled at once, and what is near to one that
    stays is gone: so are large groups of near copies, whose first row is among them.  ``vec``
    has length 1 and is null where nothing is left to tell; ``same`` names equal vectors.
    """
    ship(rows.sparkSession)
    rows = rows.select("id", "kind", F.col("vec").cast("array<double>").alias("vec")).filter(F.col("kind").isNotNull() & F.exists("vec", lambda x: x != 0))
    wide = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    found = _first(rows, max(1, min(FIRST_ROWS, FIRST_NUMBERS // wide)))
    last, stay, basis = None, {}, np.eye(wide)
    first: set[int] = set()
    if found:
        last, table = found
        x, some = _unit(matrix(table.column("vec"), wide))
        ids, kinds = table.column("id").to_numpy(), np.array(table.column("kind").to_pylist(), object)
        basis = turned(x[some])
        for kind in set(kinds[some]):
            at = np.flatnonzero(some & (kinds == kind))
            out = earlier_near(x[at], least)
            first.update(ids[at[out]].tolist())
            mine = x[at[~out]]
            stay[kind] = mine, fronts(mine @ basis)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 1024):
                b = big.slice(k, 1024)
                raw = matrix(b.column(2), wide)
                x, some = _unit(raw)
                ids, kinds = b.column(0).to_numpy(), b.column(1).to_pylist()
                gone, early = np.array([i in first for i in ids.tolist()]), ids <= last
                groups: dict[str, list[int]] = {}
                for r in np.flatnonzero(some & ~early).tolist():
                    groups.setdefault(kinds[r], []).append(r)
                for kind, members in groups.items():
                    if kind in stay:
                        mine, ahead = stay[kind]
                        y = x[members]
                        for i, _ in near(y, mine, (fronts(y @ basis), ahead), least):
                            gone[np.array(members)[i]] = True
                same = [hashlib.sha256(kind.encode() + b"\n" + v.tobytes()).digest() for kind, v in zip(kinds, raw + 0.0, strict=True)]
                left = some & ~early & ~gone
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(left, wide, 0))].astype(np.int32)), pa.array(x[left].ravel()), mask=pa.array(~left))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), lists, pa.array(gone)], ["id", "kind", "same", "vec", "gone"])

    return checkpoint(rows.mapInArrow(settle, "id long, kind string, same binary, vec array<double>, gone boolean"))


def _by_component(members: DataFrame, least: float) -> DataFrame:
    """Ids of (component, id, vec) rows that go, each component settled by one ordered pass."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def gone() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            out = earlier_near(matrix(rows.column("vec"), _wide(rows.column("vec"))), least)
            return pa.RecordBatch.from_arrays([rows.column("id").filter(pa.array(out)).combine_chunks()], ["id"])

        for b in batches:
            who = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if who[lo] != now and held:
                    yield gone()
                    held = []
                now = who[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield gone()

    return spread(members.select("component", "id", "vec"), "component").sortWithinPartitions("component", "id").mapInArrow(settle, "id long")


def later_copies(rows: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """Ids of (id, kind, vec) rows that add nothing when rows come one by one in the order of ids.

    A row adds nothing if an earlier row of its kind that stayed has a cosine of ``least`` or
    more with it.  The first rows are settled before the others.  Rows near each other,
    directly or through others, form components; what goes depends on nothing outside a
    component, and within it one ordered pass settles all rows, however long a chain is.
    Components of more than GIANT_ROWS rows go by blocks.
    """
    after = _after_first(rows, least)
    # Equal vectors share their near ones, so the first stands for all; those of zeros are near to none.
    low = after.groupBy("same").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1").select("same", "low")
    equal = checkpoint(after.select("id", "same").join(low, "same").filter("id > low").select("id"))
    rest = after.filter(F.col("vec").isNotNull()).join(_small(equal), "id", "left_anti").select("id", "kind", "vec")
    members = components(near_forest(rest, least, by=("kind",))).withColumnRenamed("node", "id")
    many = members.groupBy("component").count()
    members = checkpoint(rest.drop("kind").join(_small(members.join(many, "component")), "id"))
    settled = _by_component(members.filter(F.col("count") <= GIANT_ROWS), least)
    giants = _in_blocks(members.filter(F.col("count") > GIANT_ROWS).select("id", "vec"), least)
    return checkpoint(equal.union(after.filter("gone").select("id")).union(settled).union(giants).distinct())


def remember(memories: DataFrame, new: DataFrame, now: str, embed: Embedder = feature_hash) -> DataFrame:
    """Memories with those of ``new`` that add something."""
    return memories.unionByName(added(memories, new, now, embed))


def added(memories: DataFrame, new: DataFrame, now: str, embed: Embedder = feature_hash) -> DataFrame:
    """The (kind, text, scope, file) rows that are remembered; near copies of the same kind add nothing.

    New rows come one after another by their column ``seq`` (unique longs), or by a hash of
    kind and text where there is none, and are compared with the old ones and with those new
    ones before them that stayed.
    """
    order = F.min("seq") if "seq" in new.columns else F.xxhash64("kind", "text")
    rows = new.withColumn("scope", F.coalesce("scope", F.lit("repo"))).groupBy("kind", "text")
    fresh = rows.agg(order.alias("no"), F.min(F.struct(*[c for c in ("seq",) if c in new.columns], "scope", "file")).alias("e"))
    fresh = checkpoint(fresh.select("no", "kind", "text", "e.scope", "e.file").withColumn("embedding", embed(F.col("text"))))
    vectors = fresh.select(F.col("no").alias("id"), "kind", F.col("embedding").alias("vec"))
    old = memories.select("id", "kind", F.col("embedding").alias("vec"))
    if not old.isEmpty():
        vectors = checkpoint(vectors.join(alike(vectors, old, DUPLICATE, by=("kind",)), "id", "left_anti"))
        fresh = fresh.join(vectors.select(F.col("id").alias("no")), "no", "left_semi")
    rows = fresh.join(_small(later_copies(vectors).select(F.col("id").alias("no"))), "no", "left_anti")
    rows = rows.withColumn("id", memory_id(F.col("kind"), F.col("text"))).withColumn("ts", F.lit(now))
    return rows.select(*memories.columns)


def recall(memories: DataFrame, query: Column, limit: int = RECALL_LIMIT, least: float = RECALL_LEAST, embed: Embedder | None = feature_hash) -> DataFrame:
    """The memories most like the query (a text, or a vector if ``embed`` is None), best first."""
    q = embed(query) if embed else query
    hits = memories.withColumn("__s", dot(F.col("embedding"), q)).filter(F.col("__s") >= least).orderBy(F.desc("__s"), "id").limit(limit)
    return hits.select("id", "kind", "text", "file", round3(F.col("__s")).alias("score"))
