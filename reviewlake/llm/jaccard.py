"""Exact set-similarity self-join on word shingles: universe partition with the pigeonhole.

Two sets with Jaccard similarity p/q or more differ in at most H tokens, H following from
their sizes.  Sets fall into bands by size; for a band, tokens (the universe) are hashed into
segments.  If a set allots weight 1 to a segment (indexed as it is) or weight 2 (indexed with
its one-deletion neighbourhood), and its weights add up to more than H, then a similar set
must match in one of the allotted segments: equal where the weight is 1, at most one token
apart where it is 2.  Small bands use weight 2, larger ones weight 1, and weight 0 is left
over for a set's costliest segments.

The steps: (1) sets that are equal become one class; (2) class representatives emit segment
signatures, packed by bucket into binary rows, and a bucket keeps those that two sets share;
(3) every set is compared with one pivot, a set that shares many signatures, and verified
links give first components; (4) sets of one pivot can be similar only as the sum of their
distances allows, or if they differ from the pivot in the same tokens: the rare ones among
those yield candidates; (5) signatures whose group lies within one component or one pivot
cost nothing; a set pays for the cheapest others that its weights still need, and only those
yield candidates; all candidates are verified on the whole texts.  No step emits all pairs
of a group of copies, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, input_bytes, mix64, only_ids, portions, release, session, stored, text_bytes

#: MB of input text for each bucket of signatures, and the most buckets that 24 bits can name.
BUCKET_MB, MOST_BUCKETS = 2.0, 1 << 24
#: Sets in bands up to this size get one-deletion neighbourhoods.
SMALL = 64
INDEX, PROBE = 0x4000, 0x8000
#: Deltas to a pivot are kept up to so many times the distance of a link.
REACH = 4
#: Bytes of one Arrow batch handed to Python: pairs travel with two texts, so rows alone do not bound a worker.
BATCH_BYTES = 4 << 20
WHOLE = 0xFFFF  # unit number of a signature that is a unit of its own

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
    return _PLACE


# --- shingle sets ------------------------------------------------------------------------


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text, sorted within it, and the texts' bounds.

    Words are runs of bytes other than ASCII white space, A-Z folded to a-z.  A text with
    fewer than ``width`` words has its whole sequence as one shingle, one without words none.
    """
    n = len(offs) - 1
    space = _SPACE[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & ~space) if len(raw) else np.zeros(0, np.int64)
    stop = np.ones(len(raw) + 1, bool)
    stop[1:-1] = space[1:]
    stop[offs] = True
    ends = np.flatnonzero(stop[1:] & ~space) + 1 if len(raw) else starts
    size = ends - starts
    keep = np.flatnonzero(~space)
    values = _BYTE[_LOWER[raw[keep]]]
    inside = np.arange(len(keep)) - np.repeat(np.cumsum(size) - size, size)
    values *= _places(int(size.max(initial=0)) + 1)[inside]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    at = np.cumsum(size)
    words = mix64(total[at] - total[at - size] + size.astype(np.uint64) * _U(0xA0761D6478BD642F))
    first = np.searchsorted(starts, offs)
    many = np.diff(first)
    odd = _PLACE[1 : width + 1]
    m = len(words) - width + 1
    if m > 0:
        grams = np.zeros(m, np.uint64)
        for k in range(width):
            grams += words[k : k + m] * odd[k]
        grams = mix64(grams)
    out = []
    for d in range(n):
        a, w = first[d], many[d]
        if w >= width:
            out.append(np.unique(grams[a : a + w - width + 1]))
        elif w:
            out.append(mix64((words[a : a + w] * odd[:w]).sum(keepdims=True) + np.array([w], np.uint64) * _U(0xE7037ED1A0B428DB)))
        else:
            out.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


# --- bands, segments and weights ---------------------------------------------------------


class Bands:
    """Sizes fall into bands half as wide again as they begin; p/q is the least similarity."""

    def __init__(self, p: int, q: int, most: int = 1 << 40):
        self.p, self.q = p, q
        lows = [1, 8]
        while lows[-1] < most:
            lows.append(-(-lows[-1] * 3 // 2))
        if lows[1] * p < lows[0] * q or 3 * p < 2 * q:
            raise ValueError("bands are laid out for similarities of 2/3 and more")
        self.lows = np.array(lows, np.int64)
        top = self.lows[1:] - 1
        self.weight = np.where(self.lows[1:] <= SMALL, 2, 1)
        need = self.apart(top) + 1
        self.segments = np.where(self.weight == 2, -(-need // 2) + (need > 2), -(-need * 4 // 3))

    def apart(self, n: np.ndarray) -> np.ndarray:
        """Most tokens by which a set of n tokens differs from a similar one not smaller."""
        return (n + n * self.q // self.p) * (self.q - self.p) // (self.q + self.p)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1


def signatures(tokens: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """(signature, row, flags, unit) of every set, and each set's number of spare units.

    A set indexes the segments of its own band and probes those of its own and of the next
    smaller band, as far as a similar smaller set can lie there.
    """
    n = np.diff(bounds)
    sig, row, flag, unit = [], [], [], []
    spare = np.zeros(len(n), np.int64)
    own = bands.of(n)
    for back in (0, 1):
        k = own - back
        rows = np.flatnonzero((n > 0) & (k >= 0) & ((back == 0) | (-(-n * bands.p // bands.q) < bands.lows[own])))
        if not len(rows):
            continue
        band, m = k[rows], bands.segments[k[rows]]
        base = np.concatenate([[0], np.cumsum(m)])
        size = n[rows]
        at = np.repeat(np.arange(len(rows)), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[rows], size)
        tok = tokens[pos]
        place = mix64(tok + band[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(33)
        flat = base[at] + ((place * m[at].astype(np.uint64)) >> _U(31)).astype(np.int64)
        worth = mix64(tok ^ _U(0x5851F42D4C957F2D))
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, flat, worth)
        count = np.bincount(flat, minlength=base[-1])
        of = np.repeat(np.arange(len(rows)), m)
        seg = np.arange(base[-1]) - base[of]
        name = mix64((band[of] * 4096 + 7).astype(np.uint64) * _U(0xD1B54A32D192ED03) + seg.astype(np.uint64) * _U(0x2545F4914F6CDD1D))
        heavy = bands.weight[band] == 2
        # Units: segments with tokens; all of them, should those not suffice.
        need = -(-(bands.apart(size) + 1) // bands.weight[band])
        full = np.add.reduceat((count > 0).astype(np.int64), base[:-1])
        short = full < need
        is_unit = (count > 0) | short[of]
        if back == 0:
            spare[rows] = np.where(short, m, full) - need

        def emit(value, segs, kind, flags):
            sig.append(mix64(value + name[segs] + np.array([kind], np.uint64) * _U(0xA24BAED4963EE407)))
            row.append(rows[of[segs]])
            flag.append(flags)
            unit.append(np.where(heavy[of[segs]], seg[segs], WHOLE))

        segs = np.arange(base[-1])
        emit(sums, segs, 0, np.where(is_unit & (back == 0), INDEX | PROBE, PROBE))
        small = np.flatnonzero(heavy[of])
        if len(small):
            emit(sums[small], small, 1, np.full(len(small), PROBE))
            tiny = np.flatnonzero(heavy[at])
            less = sums[flat[tiny]] - worth[tiny]
            emit(less, flat[tiny], 2, np.full(len(tiny), PROBE))
            if back == 0:
                emit(less, flat[tiny], 1, np.full(len(tiny), INDEX))
                used = small[is_unit[small]]
                emit(sums[used], used, 2, np.full(len(used), INDEX))
    if not sig:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, spare
    return np.concatenate(sig), np.concatenate(row), np.concatenate(flag), np.concatenate(unit), spare


# --- Spark stages ------------------------------------------------------------------------


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """id, n and two 64-bit sums that equal sets share."""

    def run(batches):
        for b in (p for whole in batches for p in portions(whole, 1)):
            tokens, bounds = shingle_sets(*text_bytes(b.column(1)), width)
            k1 = _sum_by(mix64(tokens ^ _U(0x243F6A8885A308D3)), bounds).astype(np.int64)
            k2 = _sum_by(mix64(tokens + _U(0x13198A2E03707344)), bounds).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(k1), pa.array(k2)], ["id", "n", "k1", "k2"])
        release()

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long")


def _shared_signatures(docs: DataFrame, bands: Bands, width: int, buckets: int) -> DataFrame:
    """kind 0: (signature, id, flags, unit) that sets share; kind 1: (first id, id, groups);
    kind 2: (id, n, spare)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in (p for whole in batches for p in portions(whole, 1)):
            ids = b.column(0).to_numpy()
            tokens, bounds = shingle_sets(*text_bytes(b.column(1)), width)
            sig, row, flag, unit, spare = signatures(tokens, bounds, bands)
            bucket = ((sig >> _U(40)) % _U(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")
            held, edges = np.unique(bucket[order], return_index=True)
            edges = np.append(edges, len(order))
            low = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            who, mark, part = ids[row[order]], flag[order].astype("<u2"), unit[order].astype("<u2")
            cols: list[list] = [[], [], [], [], [], [], []]
            for k, a, z in zip(held.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                base = int(who[a:z].min())
                off = who[a:z] - base
                off = off.astype("<u4" if off.max() < 1 << 32 else "<i8")
                for c, x in zip(cols, (k, base, low[a:z].tobytes(), off.tobytes(), mark[a:z].tobytes(), part[a:z].tobytes(), None), strict=True):
                    c.append(x)
            turn += 1
            info = np.stack([ids, np.diff(bounds), spare]).astype("<i8").tobytes()
            for c, x in zip(cols, (turn % buckets, 0, None, None, None, None, info), strict=True):
                c.append(x)
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "base", "sig", "ids", "flags", "units", "info"])
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "c", "d"]

        def rows(kind, a, b, c, d):
            for i in range(0, len(a), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[s]), kind, np.int32)), pa.array(a[s].astype(np.int64)), pa.array(b[s].astype(np.int64)), pa.array(c[s].astype(np.int64)), pa.array(d[s].astype(np.int32))], names)

        sigs, whos, flags, units = [], [], [], []
        for b in batches:
            for bucket, base, sig, ids, flag, unit, info in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if info is not None:
                    x = np.frombuffer(info, "<i8").reshape(3, -1)
                    yield from rows(2, x[0], x[1], x[2], np.zeros(x.shape[1]))
                    continue
                n = len(sig) // 5
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(sig, np.uint8).reshape(n, 5)
                sigs.append(wide.view("<u8").ravel() + _U(bucket << 40))
                whos.append(np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<i8").astype(np.int64) + base)
                flags.append(np.frombuffer(flag, "<u2"))
                units.append(np.frombuffer(unit, "<u2"))
        if not sigs:
            return
        sig, who, flag, unit = map(np.concatenate, (sigs, whos, flags, units))
        del sigs, whos, flags, units
        # First drop what stands alone, then sort the rest.
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        sig, who, flag, unit = sig[keep], who[order], flag[order], unit[order]
        if not len(sig):
            return
        _, group = np.unique(group, return_inverse=True)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least, most = np.minimum.reduceat(who, begin), np.maximum.reduceat(who, begin)
        asked = np.bitwise_or.reduceat(flag, begin)
        keep = ((least != most) & (asked & INDEX > 0))[group]
        sig, who, flag, unit, first = sig[keep], who[keep], flag[keep], unit[keep], least[group[keep]]
        yield from rows(0, sig, who, flag, unit)
        pairs = np.stack([first, who], axis=1)[first != who]
        if len(pairs):
            pairs, times = np.unique(pairs, axis=0, return_counts=True)
            yield from rows(1, pairs[:, 0], pairs[:, 1], times, np.zeros(len(times)))
        del sig, who, flag, unit, first, order, group, keep
        release()

    flat = docs.mapInArrow(spread, "bucket int, base long, sig binary, ids binary, flags binary, units binary, info binary")
    return flat.repartition(max(8, buckets // 4), "bucket").mapInArrow(meet, "kind int, a long, b long, c long, d int")


def with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of a stored table with both texts, ta and tb.

    A set may be compared with a third of all others.  The ``a`` of more than a ten-thousandth
    of all pairs (at least 64) are at most 10 000; their text goes to several tasks, each of
    which meets so many of the others.
    """
    limit = max(64, pairs.count() // 10_000)
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    hot = F.broadcast(hot.select("a", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    pairs = pairs.join(hot, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = only_ids(docs, ids, "left_semi")
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(hot, "a", "left")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    left = pairs.join(first, ["a", "salt"])
    return left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")


def compared(docs: DataFrame, pairs: DataFrame, width: int, p: int, q: int, reach: int = 0) -> DataFrame:
    """(a, b, na, nb, apart, linked, delta) of pairs: sizes, tokens in which the sets differ,
    whether they are similar enough, and those tokens if they are at most ``reach`` times as
    many as a link allows."""

    def run(batches):
        for b in (x for whole in batches for y in portions(whole, 1) for x in portions(y, 3)):
            sets = []
            for k in (1, 3):
                _, place, back = np.unique(b.column(k - 1).to_numpy(), return_index=True, return_inverse=True)
                sets.append((*shingle_sets(*text_bytes(b.column(k).take(pa.array(place))), width), back))
            (ta, ba, ia), (tb, bb, ib) = sets
            rows: list[list] = [[], [], [], [], []]
            for i, j in zip(ia.tolist(), ib.tolist(), strict=True):
                x, y = ta[ba[i] : ba[i + 1]], tb[bb[j] : bb[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                apart = len(x) + len(y) - 2 * both
                near = apart * (q + p) <= reach * (q - p) * (len(x) + len(y))
                for c, v in zip(rows, (len(x), len(y), apart, both > 0 and q * both >= p * (len(x) + len(y) - both), np.setxor1d(x, y, assume_unique=True).astype(np.int64) if near else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], ["a", "b", "na", "nb", "apart", "linked", "delta"])
        release()

    full = with_texts(docs, pairs)
    return full.select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long, na long, nb long, apart long, linked boolean, delta array<long>")


def verified(docs: DataFrame, pairs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose whole texts' shingle sets are similar enough, as (u, v)."""
    return compared(docs, pairs, width, p, q).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def pivots(stars: DataFrame) -> DataFrame:
    """(a, b): one set to compare each set b with: of those that share at least half as many
    signatures as the best does, the one that most others are compared with."""
    popular = stars.groupBy("a").agg(F.count("*").alias("popular"))
    best = stars.groupBy("b").agg(F.max("times").alias("best"))
    some = stars.join(best, "b").filter("times * 2 >= best").join(popular, "a")
    return some.groupBy("b").agg(F.max_by("a", F.struct("popular", -F.col("a"))).alias("a")).select("a", "b")


def _around_pivots(near: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """What follows for sets compared with the same pivot: certain links, and candidates.

    ``near`` has (a, b, na, nb, apart, delta).  The sets of a pivot differ from each other in
    at most the sum of their distances to it; where that suffices, a link is certain, and all
    such links are implied by those with the set of least surplus.  Any other similar pair
    must share tokens of both deltas: so many that, with rare tokens first, one lies far
    enough to the front of both.  Surplus: (q + p) apart - (q - p) n.
    """
    surplus = lambda d, n: (q + p) * F.col(d) - (q - p) * F.col(n)
    members = near.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("apart").alias("d"), surplus("apart", "nb").alias("k"))
    own = near.groupBy(F.col("a").alias("pivot")).agg((-(q - p) * F.first("na")).alias("k")).select("pivot", F.col("pivot").alias("id"), "k")
    least = members.select("pivot", "id", "k").union(own).groupBy("pivot").agg(F.min_by("id", F.struct("k", "id")).alias("low"), F.min("k").alias("low_k"))
    every = members.select("pivot", "id", "k").union(own).join(least, "pivot")
    certain = every.filter("k + low_k <= 0 and id <> low").select(F.col("low").alias("u"), F.col("id").alias("v"))
    rows = near.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.explode("delta").alias("token"))
    often = rows.groupBy("pivot", "token").agg(F.count("*").alias("often"))
    members = members.join(least.select("pivot", "low_k"), "pivot")  # a row for each set, not for each token
    rows = rows.join(often, ["pivot", "token"]).join(members, ["pivot", "id"])
    w = Window.partitionBy("pivot", "id").orderBy("often", "token")
    rest = F.col("d") - F.row_number().over(w) + 1  # most that can be shared from this token on
    rows = rows.withColumn("rest", rest).filter("often > 1")
    most = F.floor((F.col("n") + F.floor(F.col("n") * q / p)) * (q - p) / (q + p))
    least_shared = F.greatest(F.lit(1), F.col("d") - most, F.ceil((F.col("k") + F.greatest(F.col("low_k"), 1 - F.col("k"))) / (2 * (q + p))))
    return certain, rows.filter(F.col("rest") >= least_shared).select("pivot", "token", "id", "n", "k", "rest")


def _delta_candidates(rows: DataFrame, names: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of one pivot in different components whose deltas may share enough tokens."""
    rows = rows.join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("pivot", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("pivot", "token")
    rows = rows.join(mixed, ["pivot", "token"], "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    shared = F.greatest(F.lit(1), F.ceil((F.col("x.k") + F.col("y.k")) / (2 * (q + p))))
    fits = (F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p) & (F.least("x.rest", "y.rest") >= shared)
    meet = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & fits
    return x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _candidates(shared: DataFrame, info: DataFrame, names: DataFrame, groups: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of different components and pivots in the cheapest signatures a set must pay for."""
    who = info.join(names, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("pivot", F.coalesce("pivot", "id"))
    rows = shared.join(who, "id")
    probe = (F.col("flags").bitwiseAND(PROBE) > 0).cast("long")
    by = rows.groupBy("sig", "component", "pivot").agg(F.sum(probe).alias("probes"))
    over = lambda *c: F.sum("probes").over(Window.partitionBy(*c))
    by = by.withColumn("cost", over("sig") - over("sig", "component") - over("sig", "pivot") + F.col("probes")).filter("cost > 0").select("sig", "component", "pivot", "cost")
    index = rows.filter(F.col("flags").bitwiseAND(INDEX) > 0).join(by, ["sig", "component", "pivot"])
    index = index.withColumn("unit_key", F.when(F.col("unit") == WHOLE, F.col("sig")).otherwise(F.col("unit").cast("long")))
    units = index.groupBy("id", "unit_key").agg(F.sum("cost").alias("cost"), F.first("spare").alias("spare"))
    order = Window.partitionBy("id").orderBy("cost", "unit_key")
    units = units.withColumn("no", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy("id")))
    chosen = units.filter("no <= many - spare").select("id", "unit_key")
    pays = index.join(chosen, ["id", "unit_key"]).select("sig", F.col("id").alias("r"), F.col("component").alias("cr"), F.col("pivot").alias("pr"), F.col("n").alias("nr"))
    asked = pays.select("sig").distinct()
    probes = rows.filter(probe > 0).join(asked, "sig", "left_semi").select("sig", F.col("id").alias("s"), F.col("component").alias("cs"), F.col("pivot").alias("ps"), F.col("n").alias("ns"))
    fits = (F.col("cr") != F.col("cs")) & (F.col("pr") != F.col("ps")) & (F.col("nr") * bands.q >= F.col("ns") * bands.p) & ((F.col("nr") < F.col("ns")) | ((F.col("nr") == F.col("ns")) & (F.col("r") != F.col("s"))))
    return pays.join(probes, "sig").filter(fits).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def _apart(docs: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, names) where each text of an id in ``several`` is a node of its own.

    ``names`` has (id, doc): the node, a hash of id and text, and the id it belongs to.  It is
    filled for those nodes only.
    """
    if several.count() <= BROADCAST_IDS:
        several = F.broadcast(several)
    docs = docs.join(several.withColumn("many", F.lit(True)), "id", "left")
    docs = docs.select(F.when(F.col("many"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("id"), "text", F.when(F.col("many"), F.col("id")).alias("doc"))
    names = docs.filter("doc is not null").select("id", "doc").distinct()
    return docs.select("id", "text"), names


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable.

    Documents link when their shingle sets have Jaccard similarity p/q or more.  Null texts
    and texts without words have no shingles and link with nothing.  Rows that share an id
    are one node with several texts: each text finds its links as if it had an id of its own,
    then those of one id are tied together.  Rows with a null id come back with a null component.
    """
    session(df).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = stored(profiles(docs, width), "profiles")
    # Ids with unlike sets; sets that are equal need no names of their own.
    unlike = F.struct("n", "k1", "k2")
    several = profile.filter("id is not null").groupBy("id").agg((F.min(unlike) != F.max(unlike)).alias("many")).filter("many").select("id")
    several = stored(several, "several")
    if several.isEmpty():
        final = _components(docs, profile, width, p, q, input_bytes(df), None).withColumnRenamed("node", "id")
        out = profile.join(final, "id", "left")
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    docs, names = _apart(docs, several)
    names = stored(names, "texts")
    profile = stored(profiles(docs, width), "profiles")
    ties = names.select(F.col("doc").alias("u"), F.col("id").alias("v"))
    final = stored(_components(docs, profile, width, p, q, input_bytes(df), ties).withColumnRenamed("node", "id"), "names")
    real = final.join(names, "id", "left_anti").groupBy("component").agg(F.min("id").alias("low"))
    out = profile.join(final.join(real, "component"), "id", "left").join(names, "id", "left")
    doc = F.coalesce("doc", "id")
    return out.select(doc.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", doc).alias("component_id"))


def _components(docs: DataFrame, profile: DataFrame, width: int, p: int, q: int, size: int, ties: DataFrame | None) -> DataFrame:
    """(node, component) of (id, text) rows in which an id has one set; ``ties`` are links of other kinds."""
    bands = Bands(p, q)
    known = docs.filter("id is not null")
    # (1) equal sets: the smallest id of a class stands for it
    sets = profile.filter("n > 0 and id is not null")
    classes = sets.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last")
    copies = stored(sets.join(classes, ["n", "k1", "k2"]).filter("id <> rep").select("id", "rep"), "copies")
    empty = profile.filter("n = 0 and id is not null").select("id")
    # (2) signatures of representatives
    alone = only_ids(known, copies.select("id").union(empty).distinct(), "left_anti")
    buckets = int(min(MOST_BUCKETS, max(32, size / (BUCKET_MB * 1e6))))
    found = stored(_shared_signatures(alone, bands, width, buckets), "signatures")
    shared = found.filter("kind = 0").select(F.col("a").alias("sig"), F.col("b").alias("id"), F.col("c").alias("flags"), F.col("d").alias("unit"))
    info = found.filter("kind = 2").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n"), F.min("c").alias("spare"))
    # (3) every set against a pivot
    stars = found.filter("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("times"))
    sizes = info.select("id", "n")
    stars = stars.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    stars = stored(pivots(stars.filter((low * q >= high * p) & (F.col("times") * 40 >= low)).select("a", "b", "times")), "stars")
    near = stored(compared(known, stars, width, p, q, REACH), "pivots")
    direct = near.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    certain, rows = _around_pivots(near.filter("delta is not null"), p, q)
    links = stored(direct.union(certain), "links")
    names = stored(connected_components(links).withColumnRenamed("node", "id"), "names")
    # (4) sets of one pivot, by the tokens in which they differ from it
    within = stored(verified(known, stored(_delta_candidates(rows, names, p, q), "pairs"), width, p, q), "links")
    links = links.union(within)
    groups = near.filter("delta is not null").select(F.col("b").alias("id"), F.col("a").alias("pivot"))
    groups = groups.union(groups.select(F.col("pivot").alias("id"), "pivot").distinct().join(groups.select("id"), "id", "left_anti"))
    # (5) what may still link different components and pivots
    more = stored(verified(known, stored(_candidates(shared, info, names, groups, bands), "pairs"), width, p, q), "links")
    same = copies.select(F.col("rep").alias("u"), F.col("id").alias("v"))
    every = links.union(more).union(same)
    return connected_components(every if ties is None else every.union(ties))
