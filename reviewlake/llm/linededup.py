"""Near-duplicate lines: segment-partition edit join.

Lines are compared after every run of ASCII white space became one space and the ends were
trimmed; empty ones give no row.  Two lines of at least 3 TAU + 1 code points link when their
edit distance is at most ``TAU``; shorter ones are only told equal or not.  A line is split into TAU + 1 even segments; if a
line is within TAU edits of it, one segment occurs unchanged in that line, near its own place
(the window depends on the segment's number and on both lengths).  Segments of the shorter
line are indexed by length and number, substrings of the longer one probe them, and pairs are
verified by a banded bit-parallel edit distance over many pairs at a time.

Equal lines are one line from the start: a task folds its own copies before it emits
anything.  A group of lines that share a segment yields its pairs only while it is small; the
lines of a larger one meet in a grid over their counts of characters, which keeps apart what
differs too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, input_bytes, joined_by_size, mix64, only_ids, portions, release, session, stored
from .jaccard import INDEX, MOST_BUCKETS, PROBE

#: Edits, and the least code points of a line that gets a row.
TAU, MIN_CHARS = 2, 1
#: Classes of characters that are counted to tell far lines apart cheaply (a power of two).
BAG = 16
#: Pairs that a group may yield at once, for each of its rows.
PAIRS_PER_ROW = 8
#: Characters of padded lines that are compared at a time.
CELLS = 1 << 21
BUCKET_MB = 4.0

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def lines_of(text: str | None) -> list[str]:
    """The lines of a text as they are compared."""
    return [b" ".join(s.split()).decode() for s in (text or "").encode().split(b"\n")]


def near_chars(tau: int, min_chars: int) -> int:
    """The least code points of a line in the near join; a line of 3 tau may share no segment with a near one."""
    return max(min_chars, 3 * tau + 1)


def line_key(line: str) -> int:
    """64-bit name of a line in the near join."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


# --- segments and substrings -------------------------------------------------------------


def segments(length: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (segments x lines) of the even partition; later segments are longer."""
    parts = tau + 1
    small = length // parts
    longer = length - small * parts
    no = np.arange(parts)[:, None]
    extra = np.maximum(0, no - (parts - longer))
    return no * small + extra, small + (no >= parts - longer)


def signatures(lines: list[str], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, line, flag): indexed segments and probing substrings of every line."""
    if not lines:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = _powers(int(size.max()) + 1)
    place = np.arange(len(code)) - np.repeat(begin[:-1], size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(code + _U(1)) * up[place])])
    who = np.arange(len(lines))
    sig, line, flag = [], [], []

    def emit(rows, start, width, length, no, mark):
        a = begin[rows] + start
        h = (total[a + width] - total[a]) * down[start]
        sig.append(mix64(h + (length * 64 + no).astype(np.uint64) * _U(0xD1B54A32D192ED03)))
        line.append(rows)
        flag.append(np.full(len(rows), mark))

    starts, widths = segments(size, tau)
    for i in range(tau + 1):
        emit(who, starts[i], widths[i], size, i, INDEX)
    for delta in range(tau + 1):
        rows = who[size - delta > tau]
        shorter = size[rows] - delta
        starts, widths = segments(shorter, tau)
        for i in range(tau + 1):
            low = np.maximum(np.maximum(starts[i] - i, starts[i] + delta - (tau - i)), 0)
            high = np.minimum(np.minimum(starts[i] + i, starts[i] + delta + (tau - i)), size[rows] - widths[i])
            for k in range(2 * tau + 1):
                ok = low + k <= high
                if not ok.any():
                    break
                emit(rows[ok], (low + k)[ok], widths[i][ok], shorter[ok], i, PROBE)
    return np.concatenate(sig), np.concatenate(line), np.concatenate(flag)


# --- banded bit-parallel edit distance ---------------------------------------------------


def edit_distances(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Edit distances of pairs, tau + 1 where they exceed tau; all pairs go column by column.

    One machine word a pair holds the vertical differences of the 2 tau + 1 diagonals about
    the main one; the word follows the diagonal, so the window moves one down each column.
    """
    out = np.full(len(left), tau + 1, np.int64)
    a = [x if len(x) >= len(y) else y for x, y in zip(left, right, strict=True)]
    b = [y if len(x) >= len(y) else x for x, y in zip(left, right, strict=True)]
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    live = np.flatnonzero((m - n <= tau) & (m > 0))
    out[m == 0] = 0
    few = live[m[live] <= tau]  # at most tau characters: replacing all of them is near enough to need counting
    for i in few.tolist():
        row = list(range(len(b[i]) + 1))
        for c in a[i]:
            old, row[0] = row[0], row[0] + 1
            for j, d in enumerate(b[i], 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != d))
        out[i] = min(row[-1], tau + 1)
    live = live[m[live] > tau]
    live = live[np.argsort(-n[live], kind="stable")]
    lo = 0
    while lo < len(live):  # as many pairs at a time as their padded rows leave room for
        some = live[lo : lo + max(1, CELLS // (int(m[live[lo]]) + tau + 66))]
        lo += len(some)
        pm, pn = m[some], n[some]
        wide = int(pm.max()) + 2 * tau + 66
        ca, cb = np.zeros((len(some), wide), np.uint32), np.zeros((len(some), int(pn.max()) + 1), np.uint32)
        for k, i in enumerate(some.tolist()):
            ca[k, tau : tau + m[i]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), "<u4") + 1
            cb[k, : n[i]] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), "<u4") + 1
        one = _U(1)
        vp = np.full(len(some), ~_U(0) << _U(64 - tau - 1), np.uint64)
        vn = np.zeros(len(some), np.uint64)
        dist = np.full(len(some), tau, np.int64)
        for j in range(int(pn.max())):
            r = int(np.searchsorted(-pn, -j, "left"))  # pairs whose shorter line has a column j
            p, q = vp[:r], vn[:r]
            eq = np.zeros(r, np.uint64)
            col = cb[:r, j]
            for d in range(2 * tau + 1):  # characters j - tau .. j + tau of the longer line
                eq |= (ca[:r, j + d] == col).astype(np.uint64) << _U(63 - 2 * tau + d)
            d0 = (((eq & p) + p) ^ p) | eq | q
            hp, hn = q | ~(d0 | p), d0 & p
            slope = j < pm[:r] - tau  # the band's lowest cell is on the diagonal; below the last row it moves along it
            shift = (62 - np.maximum(0, j - (pm[:r] - tau))).astype(np.uint64)
            dist[:r] += np.where(slope, (d0 >> _U(63)) == 0, ((hp >> shift) & one).astype(np.int64) - ((hn >> shift) & one).astype(np.int64))
            down = d0 >> one
            vp[:r], vn[:r] = hn | ~(down | hp), down & hp
        out[some] = np.minimum(dist, tau + 1)
    return out


# --- Spark stages ------------------------------------------------------------------------


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, line_no and two hashes of every line that gets a row."""

    def run(batches):
        for b in batches:
            ids, no, low, high = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, s in enumerate(lines_of(t)):
                    if len(s) >= min_chars:
                        ids.append(i)
                        no.append(k)
                        low.append(line_key(s))
                        high.append(xxhash.xxh64_intdigest(s, 77) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "line_no", "key", "check"])

    return docs.mapInArrow(run, "id long, line_no int, key long, check long")


def _meeting(docs: DataFrame, tau: int, min_chars: int, buckets: int) -> DataFrame:
    """kind 0: (signature, key, flag) of large groups; kind 1: (key, key) to verify."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (p for whole in batches for p in portions(whole, 0)):
            fresh: dict[int, str] = {}
            for t in b.column(0).to_pylist():
                for s in lines_of(t):
                    if len(s) >= min_chars and (k := line_key(s)) not in seen:
                        seen.add(k)
                        fresh[k] = s
            keys = np.array(list(fresh), np.int64)
            sig, line, flag = signatures(list(fresh.values()), tau)
            bucket = ((sig >> _U(40)) % _U(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")
            held, edges = np.unique(bucket[order], return_index=True)
            edges = np.append(edges, len(order))
            low = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            who, mark = keys[line[order]].astype("<i8"), flag[order].astype("<u2")
            cols: list[list] = [[], [], [], []]
            for k, a, z in zip(held.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for c, x in zip(cols, (k, low[a:z].tobytes(), who[a:z].tobytes(), mark[a:z].tobytes()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "sig", "keys", "flags"])
        seen.clear()
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, whos, flags = [], [], []
        for b in batches:
            for bucket, sig, keys, flag in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(sig) // 5
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(sig, np.uint8).reshape(n, 5)
                sigs.append(wide.view("<u8").ravel() + _U(bucket << 40))
                whos.append(np.frombuffer(keys, "<i8"))
                flags.append(np.frombuffer(flag, "<u2"))
        if not sigs:
            return
        sig, who, flag = map(np.concatenate, (sigs, whos, flags))
        del sigs, whos, flags
        order = np.lexsort((flag, who, sig))
        sig, who, flag = sig[order], who[order], flag[order]
        same = np.zeros(len(sig), bool)  # copies of a line from other tasks
        same[1:] = (sig[1:] == sig[:-1]) & (who[1:] == who[:-1]) & (flag[1:] == flag[:-1])
        sig, who, flag = sig[~same], who[~same], flag[~same]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        end = np.concatenate([begin[1:], [len(sig)]])
        least, most = np.minimum.reduceat(who, begin), np.maximum.reduceat(who, begin)
        asked = np.bitwise_or.reduceat(flag, begin)
        left, right, large = [], [], []
        for g in np.flatnonzero((least != most) & (asked == INDEX | PROBE)).tolist():
            w, f = who[begin[g] : end[g]], flag[begin[g] : end[g]]
            idx, prb = w[f == INDEX], w[f == PROBE]
            if len(idx) * len(prb) <= PAIRS_PER_ROW * len(w):
                left.append(np.repeat(idx, len(prb)))
                right.append(np.tile(prb, len(idx)))
            else:
                large.append(g)
                others = np.unique(w)
                left.append(np.full(len(others) - 1, others[0]))
                right.append(others[1:])
        names = ["kind", "a", "b", "c"]
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            keep = a != b
            pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], axis=1), axis=0)
            for i in range(0, len(pairs), 100_000):
                p = pairs[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(np.zeros(len(p), np.int32))], names)
        for g in large:
            s = slice(begin[g], end[g])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(end[g] - begin[g], np.int32)), pa.array(sig[s].astype(np.int64)), pa.array(who[s]), pa.array(flag[s].astype(np.int32))], names)
        del sig, who, flag, order, same
        release()

    flat = docs.select("text").mapInArrow(spread, "bucket int, sig binary, keys binary, flags binary")
    return flat.repartition(max(8, buckets // 4), "bucket").mapInArrow(meet, "kind int, a long, b long, c int")


def fetched(docs: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """(id, line, bag) of the lines with the given keys; a bag counts characters by ``BAG`` hashes."""

    def texts(batches):
        seen: set[int] = set()
        for b in batches:
            keys, lines = [], []
            for t in b.column(0).to_pylist():
                for s in lines_of(t):
                    if len(s) >= min_chars and (k := line_key(s)) not in seen:
                        seen.add(k)
                        keys.append(k)
                        lines.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])

    def bags(batches):
        for b in batches:
            rows = [np.bincount((np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)) >> np.uint32(33 - BAG.bit_length()), minlength=BAG).astype(np.int32) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], ["id", "line", "bag"])

    lines = only_ids(docs.select("text").mapInArrow(texts, "id long, line string"), ids, "left_semi")
    return stored(lines.groupBy("id").agg(F.min("line").alias("line")).mapInArrow(bags, "id long, line string, bag array<int>"), "lines")


def verified(lines: DataFrame, pairs: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of line keys whose lines are at most tau edits apart."""

    def run(batches):
        for b in batches:
            mask = pa.array(edit_distances(b.column(1).to_pylist(), b.column(3).to_pylist(), tau) <= tau)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(2).filter(mask)], ["u", "v"])
        release()

    full = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    return full.select("a", "la", "b", "lb").mapInArrow(run, "u long, v long")


def _across(large: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """Pairs of lines of a large group that may be near, from their bags of characters.

    An edit moves a line's bag by at most two.  Two of the bag's sums are a grid in the join
    key, so a line meets those in its own and the next cells only; the whole bag is compared
    as the rows meet, so that few pairs come out that are no links.
    """
    bag = F.col("bag")
    half = lambda ks: sum((bag[k] for k in ks), F.lit(0))
    known = lines.select("id", *[bag[k].alias(f"b{k}") for k in range(BAG)], half(range(0, BAG, 2)).alias("p"), half(k for k in range(BAG) if not k & 2).alias("q"))
    rows = large.join(known, "id")
    wide = 2 * tau + 1
    cell = lambda c, d: F.floor((F.col(c) + d) / wide).cast("int")
    index = rows.filter(F.col("flag") == INDEX).withColumn("cp", cell("p", 0)).withColumn("cq", cell("q", 0))
    probe = rows.filter(F.col("flag") == PROBE)
    for c, at in (("cp", "p"), ("cq", "q")):
        probe = probe.withColumn(c, F.explode(F.array_distinct(F.array(cell(at, -tau), cell(at, tau)))))
    i, j = index.alias("i"), probe.alias("j")
    apart = sum((F.abs(F.col(f"i.b{k}") - F.col(f"j.b{k}")) for k in range(BAG)), F.lit(0))
    meet = (F.col("i.sig") == F.col("j.sig")) & (F.col("i.cp") == F.col("j.cp")) & (F.col("i.cq") == F.col("j.cq")) & (F.col("i.id") != F.col("j.id")) & (apart <= 2 * tau)
    return i.join(j, meet).select(F.least("i.id", "j.id").alias("a"), F.greatest("i.id", "j.id").alias("b")).distinct()


def near_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line: id, line_no, class_id, class_line_no, class_size, n_links, kept.

    Lines are equal or linked (edit distance at most ``tau``) within a class; class_id and
    class_line_no are the first place, by id and line number, of any line of the class, which
    is the only one kept.  n_links counts the different lines that a line links with; lines of at
    most 3 ``tau`` code points link with none, and equal ones are a class.  Null and empty
    texts and lines shorter than ``min_chars`` give no row.  Rows that share an id
    count as one place line by line.  Rows with a null id take no part.
    """
    session(df)
    near = near_chars(tau, min_chars)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    every = stored(occurrences(docs, min_chars), "occurrences")
    buckets = int(min(MOST_BUCKETS, max(32, input_bytes(df) / (BUCKET_MB * 1e6))))
    met = stored(_meeting(docs, tau, near, buckets), "segments")
    pairs = met.filter("kind = 1").select("a", "b").distinct()
    lines = fetched(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), near)
    links = first = stored(verified(lines, pairs, tau), "links")
    large = met.filter("kind = 0").select(F.col("a").alias("sig"), F.col("b").alias("id"), F.col("c").alias("flag"))
    if not large.isEmpty():
        links = stored(first.union(verified(lines, _across(large, lines, tau), tau)).distinct(), "links")
    names = connected_components(links).select(F.col("node").alias("key"), F.col("component").alias("class"))
    degree = links.select(F.col("u").alias("key")).union(links.select(F.col("v").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    linked = names.join(degree, "key")
    # Different lines first, so that only one join meets all occurrences.  Lines without links
    # are named by both hashes, linked ones by their component.
    place = F.struct("id", "line_no")
    distinct = every.groupBy("key", "check").agg(F.min(place).alias("own"), F.count("*").alias("times"))
    named = distinct.join(linked, "key", "left").withColumn("alone", F.col("class").isNull())
    named = named.withColumn("second", F.when(F.col("alone"), F.col("check")).otherwise(F.lit(0))).withColumn("class", F.coalesce("class", "key"))
    named = stored(named, "lines")
    groups = named.groupBy("class", "second", "alone").agg(F.min("own").alias("first"), F.sum("times").alias("size"), F.count("*").alias("lines")).filter("size > 1")
    lined = joined_by_size(named, stored(groups, "groups"), ["class", "second", "alone"], "lines", named.count())
    some = lined.filter("size is not null").select("key", "check", "first", "size", "n_links", "times")
    out = joined_by_size(every, stored(some, "classes"), ["key", "check"], "times", every.count())
    head = F.coalesce("first", place)
    return out.select(
        F.col("id").alias(id_col),
        "line_no",
        head["id"].alias("class_id"),
        head["line_no"].alias("class_line_no"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (head == place).alias("kept"),
    )


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """The table with later lines of every class cut out of ``text_col``.

    A document that had lines and has no text left is a copy of earlier ones and
    goes; documents without text, and those with a null id, stay as they are.  Of documents
    that share an id each loses the lines that its id loses.
    """
    gone = near_lines(df, id_col, text_col, tau, min_chars).filter("not kept").groupBy(F.col(id_col).alias("id")).agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row"))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda s, k: ~F.array_contains("gone", k)), "\n")
    cut = rows.join(gone, "id", "left").withColumn("left", F.when(F.col("gone").isNotNull(), left))
    cut = cut.filter(F.col("left").isNull() | (F.trim(F.regexp_replace("left", r"[\x20\x09-\x0D]+", " ")) != ""))
    return cut.select(*[F.coalesce("left", "text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
