"""Exact joins of vectors by inner product, with pruning.

The left side is an inverted file: a bounded number of its own vectors are leaders, and every
vector is posted in the cell of the leader it is most like.  A cell knows the range of its
vectors' angles to every leader, a right vector its own angles to them.  Two vectors cannot be
closer in angle than their angles to a leader differ, so the cell's own leader and those that
the right vector is most like bound its inner product with all of the cell; it visits only
cells whose bound reaches the threshold.  Where it visits, the components of greatest energy are multiplied
first; the inner product of the rest is at most the product of the rests' norms (the
suffix-norm bound), and only pairs whose bound still reaches the threshold are multiplied
whole.  Both bounds lose no pair.

Neighbouring cells share a block of a bounded size, a large cell is cut in several.  A vector is
sent once for each block that it visits, with the numbers of the cells there, not once for each
cell.  A task holds one block; what visits it streams by, and pairs are written as they are found.

Near copies (``near_forest``) are too alike to each other for angles to leaders to tell them
apart.  There, vectors are turned so that the components of most energy come first, and one
product of single precision of those bounds the whole; blocks and visitors are of 16-bit numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import checkpoint, ship, spread
from .components import spanning

#: Left vectors in a task, rows of them that are multiplied at a time, visitors of a batch, pairs of one that is written.
BLOCK_ROWS, STRIP_ROWS, VISITORS, PAIRS = 32_000, 512, 4096, 1 << 16
#: Tasks for each core, where the rows allow.
TURNS = 3
#: Vectors for each leader, the most leaders, and how many of them bound a right vector's products.
CELL_ROWS, LEADERS, NEAREST = 16, 512, 8
#: Leaders are no more alike than this, so that a large group of near copies has one of them.
UNLIKE = 0.95
#: Stars, three numbers each, that are broadcast; more are joined by a shuffle.
LOW_ROWS = 200_000
Meet = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray, Iterator[tuple[slice, np.ndarray]]], Iterator[pa.RecordBatch]]
#: What rounding may add to an inner product of unit vectors.
SLACK = 1e-9
#: Components, of all, that bound a product of near vectors; vectors that the turn is fitted on.
FRONT, FITTED = 3 / 8, 4096
#: Rows of a block of near vectors at most, and where there are few; what a component is multiplied with to be a whole number.
NEAR_ROWS, FEW_ROWS, WHOLE = 100_000, 8192, 32_767


class Cells(NamedTuple):
    """Of every cell: its leader's direction, least and largest angles to all leaders, range of lengths, and vectors."""

    leaders: np.ndarray
    least: np.ndarray
    most: np.ndarray
    length: np.ndarray
    rows: np.ndarray


def matrix(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if len(flat) == len(column) * wide and not flat.null_count and pc.all(pc.equal(pc.list_value_length(column), wide)).as_py():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, wide).astype(np.float64, copy=False)
    out = np.zeros((len(column), wide))
    for k, r in enumerate(column.to_pylist()):
        out[k, : len(r)] = r
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def angles(unit: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ leaders.T, -1, 1))


def visits(x: np.ndarray, cells: Cells, least: float) -> np.ndarray:
    """Which cells may hold a vector with an inner product of ``least`` or more, for every row of ``x``."""
    unit, length = directions(x)
    at = angles(unit, cells.leaders)
    own = np.arange(len(cells.rows))
    gap = np.maximum(0, np.maximum(at - cells.most[own, own], cells.least[own, own] - at))
    for leader in np.argsort(at, axis=1)[:, :NEAREST].T:  # one leader of each row at a time
        to = np.take_along_axis(at, leader[:, None], axis=1)
        gap = np.maximum(gap, np.maximum(to - cells.most[:, leader].T, cells.least[:, leader].T - to))
    cosine = np.cos(np.maximum(0, gap - 1e-7))
    bound = length[:, None] * np.where(cosine >= 0, cells.length[:, 1], cells.length[:, 0]) * cosine
    return (bound >= least - SLACK * np.maximum(1, length[:, None] * cells.length[:, 1])) & (cells.rows > 0)


def earlier_near(x: np.ndarray, least: float) -> np.ndarray:
    """Which rows, taken in order, have an inner product of ``least`` or more with an earlier row that stayed."""
    gone, kept, n = np.zeros(len(x), bool), np.zeros_like(x), 0
    for lo in range(0, len(x), STRIP_ROWS):
        some = x[lo : lo + STRIP_ROWS]
        out = (some @ kept[:n].T >= least).any(axis=1)
        for k in np.flatnonzero(~out).tolist():
            if not out[k]:
                out[k + 1 :] |= some[k + 1 :] @ some[k] >= least
        gone[lo : lo + len(some)] = out
        kept[n : n + (~out).sum()] = some[~out]
        n += int((~out).sum())
    return gone


def products(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, column, inner product) of at least ``least``, and pairs multiplied whole, a strip at a time."""
    order = np.argsort(-np.sqrt((x * x).sum(axis=0)) * np.sqrt((y * y).sum(axis=0)), kind="stable")
    x, y = x[:, order], y[:, order]
    front = max(2, x.shape[1] // 4)
    rest = [np.sqrt((m[:, front:] ** 2).sum(axis=1)) for m in (x, y)]
    slack = SLACK * max(1.0, np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1])
    for lo in range(0, len(x), STRIP_ROWS):
        some = x[lo : lo + STRIP_ROWS]
        part = some[:, :front] @ y[:, :front].T
        i, j = np.nonzero(part + rest[0][lo : lo + STRIP_ROWS, None] * rest[1] >= least - slack)
        if len(i) * 4 > part.size:
            sims = (part + some[:, front:] @ y[:, front:].T)[i, j]
        else:
            sims = part[i, j]
            for k in range(0, len(i), 1 << 15):
                at = slice(k, k + (1 << 15))
                sims[at] += np.einsum("ij,ij->i", some[i[at], front:], y[j[at], front:])
        near = sims >= least
        yield i[near] + lo, j[near], sims[near], len(i)


def _own(x: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    """The cell of every row."""
    return np.argmax(directions(x)[0] @ leaders.T, axis=1)


class Blocks(NamedTuple):
    """How the left side is cut: every cell's first block and how many it has, blocks, and turns of the right side."""

    first: np.ndarray
    many: np.ndarray
    blocks: int
    turns: int


def cut(cells: Cells, tasks: int) -> Blocks:
    """Cells next to each other share a block of BLOCK_ROWS rows at most; a larger cell has blocks of its own.

    A left row is sent once for each turn, a right row once for each block that holds a cell it
    visits; few rows are cut in about as many blocks as turns.
    """
    n, k = int(cells.rows.sum()), len(cells.rows)
    most = max(1, min(BLOCK_ROWS, -(-n // max(1, math.isqrt(tasks)))))
    like, order, rest = cells.leaders @ cells.leaders.T, [0], set(range(1, k))
    while rest:
        order.append(max(rest, key=lambda c: like[order[-1], c]))
        rest.remove(order[-1])
    first, many, at, held = np.zeros(k, np.int64), np.ones(k, np.int64), 0, 0
    for c in order:
        rows = int(cells.rows[c])
        if held and held + rows > most:
            at, held = at + 1, 0
        first[c], many[c] = at, max(1, -(-rows // most))
        if many[c] > 1:
            at, held = at + int(many[c]), 0
        else:
            held += rows
    return Blocks(first, many, at + 1, max(1, -(-tasks // (at + 1))))


def _posted(left: DataFrame, cells: Cells, blocks: Blocks, wide: int) -> DataFrame:
    """Left rows with their cell and their block."""
    names, leaders = left.columns, cells.leaders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _own(matrix(b.column(names.index("vec")), wide), leaders)
            block = blocks.first[cell] + b.column(names.index("__h")).to_numpy() % blocks.many[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))], [*names, "cell", "block"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in left.dtypes)
    return left.mapInArrow(run, f"{ddl}, cell int, block int")


def _visiting(right: DataFrame, cells: Cells, blocks: Blocks, wide: int, least: float) -> DataFrame:
    """Right rows once for each block that they visit, with the cells that they visit there."""
    names = right.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                b = big.slice(lo, 1024)
                x = matrix(b.column(names.index("vec")), wide)
                row, cell = np.nonzero(visits(x, cells, least))
                many = blocks.many[cell]
                at = np.repeat(np.arange(len(row)), many)
                block = blocks.first[cell[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                row, cell = row[at], cell[at]
                order = np.lexsort((cell, block, row))
                row, cell, block = row[order], cell[order], block[order]
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(cell.astype(np.int16)))
                for k in range(0, len(start), 4096):
                    s = slice(k, k + 4096)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(row[start[s]])).columns, pa.array(block[start[s]].astype(np.int32)), lists[s]], [*names, "block", "cells"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in right.dtypes)
    return right.mapInArrow(run, f"{ddl}, block int, cells array<smallint>")


def inverted_file(left: DataFrame, n: int, wide: int) -> Cells:
    """Leaders and what their cells hold.

    Leaders are the vectors of the smallest hashes, one for CELL_ROWS and LEADERS at most, less
    those that are like an earlier one.
    """
    some = left.orderBy("__h").limit(min(LEADERS, -(-n // CELL_ROWS))).select("vec").toArrow()
    leaders, length = directions(matrix(some.column(0), wide))
    leaders = leaders[length > 0]
    leaders = leaders[~earlier_near(leaders, UNLIKE)]
    if not len(leaders):
        leaders = np.eye(1, wide)
    at, k = left.columns.index("vec"), len(leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full((k, k + 1), np.inf), np.full((k, k + 1), -np.inf)
        rows = np.zeros(k, np.int64)
        for b in batches:
            unit, length = directions(matrix(b.column(at), wide))
            cosine = unit @ leaders.T
            cell = np.argmax(cosine, axis=1)
            seen = np.hstack([np.arccos(np.clip(cosine, -1, 1)), length[:, None]])
            np.minimum.at(least, cell, seen)
            np.maximum.at(most, cell, seen)
            rows += np.bincount(cell, minlength=k)
        for cell in np.flatnonzero(rows).tolist():
            columns = [np.full(k + 1, cell), np.arange(k + 1), least[cell], most[cell], np.full(k + 1, rows[cell])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "leader", "least", "most", "n"])

    found = left.mapInArrow(run, "cell long, leader long, least double, most double, n long").groupBy("cell", "leader").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).toArrow()
    cell, leader, least, most, many = (found.column(i).to_numpy() for i in range(5))
    low, high, rows = np.zeros((k, k + 1)), np.zeros((k, k + 1)), np.zeros(k, np.int64)
    low[cell, leader], high[cell, leader], rows[cell] = least, most, many
    return Cells(leaders, low[:, :k], high[:, :k], np.stack([low[:, k], high[:, k]], axis=1), rows)


def _dealt(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame, Blocks, int]:
    """(left rows by cell and block, right rows where they visit, how they are cut, dimensions)."""
    spark = left.sparkSession
    ship(spark)
    keep = lambda df: checkpoint(df.filter(F.col("vec").isNotNull()).withColumn("__h", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))))
    one = keep(left)
    sides = [one, one if right is left else keep(right)]
    sizes = [df.agg(F.max(F.size("vec")), F.count("*")).first() for df in sides]
    wide = max(1, *(s[0] or 0 for s in sizes))
    cells = inverted_file(sides[0], sizes[0][1], wide)
    blocks = cut(cells, TURNS * spark.sparkContext.defaultParallelism)
    return _posted(sides[0], cells, blocks, wide), _visiting(sides[1], cells, blocks, wide, least), blocks, wide


def _streamed(posted: DataFrame, visiting: DataFrame, blocks: Blocks, wide: int, by: tuple[str, ...], meet: Meet, ddl: str) -> DataFrame:
    """``meet(left ids, left vectors, right ids, right vectors, cells)`` for every block and its visitors, a batch of them at a time.

    A task holds one block of the left side; the right side's rows come after it and are never
    held together, so that its memory is bounded, however many rows visit or pairs are found.
    ``cells`` are the right rows that visit, and the left rows, of each cell.
    """
    if by:  # a visit to a block without rows of the kind is not sent
        there = posted.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("block").alias("__block")).distinct()
        there = F.broadcast(there) if there.count() <= LOW_ROWS else there
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("block") == F.col("__block")]
        visiting = visiting.join(there, reduce(and_, same), "left_semi")
    turn = lambda c: c.cast("int").alias("turn")
    none = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c])
    x = posted.select(*by, "block", F.explode(F.sequence(F.lit(0), F.lit(blocks.turns - 1))).alias("turn"), F.lit(0).alias("side"), F.col("id").alias("l"), none(visiting, "id").alias("r"), "vec", "cell", none(visiting, "cells").alias("cells"))
    y = visiting.select(*by, "block", turn(F.col("__h") % blocks.turns), F.lit(1).alias("side"), none(posted, "id").alias("l"), F.col("id").alias("r"), "vec", none(posted, "cell").alias("cell"), "cells")
    keys = [*by, "block", "turn"]
    rows = spread(x.unionByName(y), *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, places, held = None, [], [], [], None
        for b in batches:
            who = list(zip(*(b.column(c).to_pylist() for c in (*keys, "side")), strict=True))
            cuts = [0, *(k for k in range(1, len(who)) if who[k] != who[k - 1]), len(who)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                *key, side = who[lo]
                if key != now:
                    now, ids, vectors, places, held = key, [], [], [], None
                part = b.slice(lo, hi - lo)
                if side == 0:
                    ids.append(part.column("l"))
                    vectors.append(matrix(part.column("vec"), wide))
                    places.append(part.column("cell").to_numpy())
                    continue
                if not ids:
                    continue
                if held is None:
                    at = np.concatenate(places)
                    order = np.argsort(at, kind="stable")
                    held = pa.concat_arrays(ids).take(pa.array(order)), np.concatenate(vectors)[order], at[order]
                    vectors, places = [], []
                for k in range(0, part.num_rows, VISITORS):
                    some = part.slice(k, VISITORS)
                    lists = some.column("cells")
                    row, cell = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
                    order = np.argsort(cell, kind="stable")
                    named, start = np.unique(cell[order], return_index=True)
                    asking = np.split(row[order], start[1:])
                    ends = zip(np.searchsorted(held[2], named, "left").tolist(), np.searchsorted(held[2], named, "right").tolist(), asking, strict=True)
                    yield from meet(held[0], held[1], some.column("r"), matrix(some.column("vec"), wide), ((slice(i, j), rows) for i, j, rows in ends if i < j))

    return rows.mapInArrow(run, ddl)


def _found(x: np.ndarray, y: np.ndarray, cells: Iterator[tuple[slice, np.ndarray]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(row, column, inner product, pairs multiplied whole, pairs of the strip) of all cells."""
    for own, rows in cells:
        for i, j, sims, whole in products(x[own], y[rows], least):
            yield i + own.start, rows[j], sims, whole, (own.stop - own.start) * len(rows)


def _met(left: DataFrame, right: DataFrame, least: float, by: tuple[str, ...], meet: Meet, ddl: str) -> DataFrame:
    posted, visiting, blocks, wide = _dealt(left, right, least)
    return _streamed(posted, visiting, blocks, wide, by, meet, ddl)


def _side(df: DataFrame, vec: str, by: tuple[str, ...]) -> DataFrame:
    return df.select("id", *by, F.col(vec).cast("array<double>").alias("vec"))


def similarity_pairs(left: DataFrame, right: DataFrame, least: float, vec: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (l, r, sim) of ids whose vectors have an inner product of at least ``least``.

    Rows meet only where the columns ``by`` are equal.  Shorter vectors count as filled up
    with zeros; rows without a vector have no pair.
    """
    kinds = [(n, df.schema["id"].dataType, dict(df.dtypes)["id"]) for n, df in (("l", left), ("r", right))]
    schema = pa.schema([*((n, to_arrow_type(t)) for n, t, _ in kinds), ("sim", pa.float64())])

    def meet(l: pa.Array, x: np.ndarray, r: pa.Array, y: np.ndarray, cells) -> Iterator[pa.RecordBatch]:  # noqa: E741
        some, n = [], 0
        for i, j, sims, *_ in _found(x, y, cells, least):
            for k in range(0, len(i), PAIRS):
                some.append((i[k : k + PAIRS], j[k : k + PAIRS], sims[k : k + PAIRS]))
                n += len(some[-1][0])
                if n >= PAIRS:
                    yield batch(l, r, some)
                    some, n = [], 0
        if n:
            yield batch(l, r, some)

    def batch(l: pa.Array, r: pa.Array, some: list) -> pa.RecordBatch:  # noqa: E741
        i, j, sims = (np.concatenate(p) for p in zip(*some, strict=True))
        return pa.RecordBatch.from_arrays([l.take(pa.array(i)).cast(schema.field(0).type), r.take(pa.array(j)).cast(schema.field(1).type), pa.array(sims)], schema=schema)

    one = _side(left, vec, by)
    return _met(one, one if right is left else _side(right, vec, by), least, by, meet, f"l {kinds[0][2]}, r {kinds[1][2]}, sim double")


def multiplied(left: DataFrame, right: DataFrame, least: float, vec: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """(visited, multiplied) pairs of every task of ``similarity_pairs``: what pruning left."""

    def meet(l: pa.Array, x: np.ndarray, r: pa.Array, y: np.ndarray, cells) -> Iterator[pa.RecordBatch]:  # noqa: E741
        cells = list(cells)
        whole = sum(f[3] for f in _found(x, y, iter(cells), least))
        yield pa.RecordBatch.from_pydict({"visited": [sum((own.stop - own.start) * len(rows) for own, rows in cells)], "multiplied": [int(whole)]})

    return _met(_side(left, vec, by), _side(right, vec, by), least, by, meet, "visited long, multiplied long")


def alike(left: DataFrame, right: DataFrame, least: float, vec: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """Ids of the left side that have a partner; a task names each at most once for a batch of partners, whatever the pairs."""
    kind = to_arrow_type(left.schema["id"].dataType)

    def meet(l: pa.Array, x: np.ndarray, r: pa.Array, y: np.ndarray, cells) -> Iterator[pa.RecordBatch]:  # noqa: E741
        hit = np.zeros(len(x), bool)
        for i, *_ in _found(x, y, cells, least):
            hit[i] = True
        yield pa.RecordBatch.from_arrays([l.filter(pa.array(hit)).cast(kind)], ["id"])

    return _met(_side(left, vec, by), _side(right, vec, by), least, by, meet, f"id {dict(left.dtypes)['id']}").distinct()


def turned(some: np.ndarray) -> np.ndarray:
    """An orthonormal basis, the directions of most energy in the rows first."""
    return np.linalg.eigh(some.T @ some)[1][:, ::-1]


def fronts(x: np.ndarray) -> np.ndarray:
    """Of turned rows, the first components and the length of the rest.

    An inner product of two such rows is at least that of the whole rows, but for single precision.
    """
    front = max(1, int(x.shape[1] * FRONT))
    rest = np.sqrt((x[:, front:] ** 2).sum(axis=1))
    return np.hstack([x[:, :front], rest[:, None]]).astype(np.float32)


def near(x: np.ndarray, y: np.ndarray, ahead: tuple[np.ndarray, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of ``x`` and ``y`` with an inner product of ``least`` or more, a strip at a time; ``ahead`` are their fronts."""
    floor = np.float32(least - x.shape[1] * 2.0**-22)
    for lo in range(0, len(x), STRIP_ROWS):
        bound = ahead[0][lo : lo + STRIP_ROWS] @ ahead[1].T
        i, j = np.divmod(np.flatnonzero(bound.ravel() >= floor), len(y))
        if len(i) * 8 > bound.size:
            close = (x[lo : lo + STRIP_ROWS] @ y.T)[i, j] >= least
        else:
            close = np.empty(len(i), bool)
            for k in range(0, len(i), 1 << 14):
                at = slice(k, k + (1 << 14))
                close[at] = np.einsum("ij,ij->i", x[i[at] + lo], y[j[at]]) >= least
        yield i[close] + lo, j[close]


def _stars(i: np.ndarray, j: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges, fewer than rows, that join the ids ``u`` and ``v`` of rows as the pairs (i, j) do."""
    rows, at = np.unique(i, return_inverse=True)
    columns, to = np.unique(j, return_inverse=True)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, mark = label.copy(), np.full(len(columns), len(rows))
        np.minimum.at(mark, to, label[at])
        np.minimum.at(label, at, mark[to])
    edges = zip(u[rows].tolist() + v[columns].tolist(), u[rows[label]].tolist() + u[rows[mark]].tolist(), strict=True)
    return [e for e in edges if e[0] != e[1]]


def near_forest(rows: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(u, v) edges that join all rows that have a cosine of ``least`` or more.

    ``rows`` has long ids and vectors of length 1.  Components are sent as 16-bit numbers, so
    that pairs a hair less alike (less than 1e-3 at 256) may be joined too; who needs the exact rule tells
    within a component.  Of one kind, every block of rows meets itself and half of the other
    blocks, in turns; a task holds one block and gives fewer edges than it sees rows.  Rows
    come by their angle to the direction of most energy: near ones differ there by no more than
    their own angle, so that visitors, some at a time, meet only a part of the block.
    """
    spark = rows.sparkSession
    ship(spark)
    side = _side(rows, "vec", by).filter(F.col("vec").isNotNull()).withColumn("__h", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)))
    wide, n = side.agg(F.max(F.size("vec")), F.count("*")).first()
    if not n or not wide:
        return spark.createDataFrame([], "u long, v long")
    fit = side.filter(F.col("__h") % -(-n // FITTED) == 0).select("vec").toArrow()
    basis, slack = turned(matrix(fit.column(0), wide)), math.sqrt(wide) / WHOLE + wide * 2.0**-22
    tasks = TURNS * spark.sparkContext.defaultParallelism
    most = min(NEAR_ROWS, max(FEW_ROWS, -(-n // math.isqrt(2 * tasks))))
    turns = max(1, min(-(-tasks // -(-n // most)), n // FEW_ROWS))
    at = side.columns.index("vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(at), wide) @ basis
            columns = [pa.array([r.tobytes() for r in np.rint(x * WHOLE).astype(np.int16)], pa.binary()) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arccos(np.clip(x[:, 0], -1, 1)))], [*b.schema.names, "angle"])

    small = side.mapInArrow(pack, ", ".join(f"`{c}` {'binary' if c == 'vec' else t}" for c, t in side.dtypes) + ", angle double")
    many = side.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("__many"))
    if by:
        many = many.select(*[F.col(c).alias(f"__{c}") for c in by], "__many")
        many = F.broadcast(many) if many.count() <= LOW_ROWS else many
        small = small.join(many, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]))
    else:
        small = small.crossJoin(F.broadcast(many))
    own, turn = (F.col("__h") % F.col("__many")).cast("int"), (F.shiftright("__h", 24) % turns).cast("int")
    place = lambda block, turn, side: F.struct(block.cast("int").alias("block"), turn.alias("turn"), side.alias("side"))
    held = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: place(F.col("own"), t, F.lit(0)))
    # Where the blocks are even, those opposite each other meet once: the later visits the earlier.
    others = F.filter(F.sequence(F.lit(0), F.floor(F.col("__many") / 2).cast("int")), lambda d: (d == 0) | (d * 2 != F.col("__many")) | (F.col("own") >= d))
    visits = F.transform(others, lambda d: place(F.pmod(F.col("own") - d, F.col("__many")), F.col("turn"), F.when(d == 0, 1).otherwise(2)))
    keys = [*by, "block", "turn"]
    sent = small.withColumn("own", own).withColumn("turn", turn).select("id", *by, "vec", "angle", F.explode(F.concat(held, visits)).alias("at")).select("id", *by, "vec", "angle", "at.*")
    dealt = spread(sent, *keys).sortWithinPartitions(*keys, "side", "angle")
    apart = math.acos(max(-1.0, min(1.0, least))) + 1e-5
    names = dealt.columns

    def whole(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, wide)

    def ahead(x: np.ndarray) -> np.ndarray:
        return np.concatenate([fronts(x[k : k + VISITORS].astype(np.float32) / WHOLE) for k in range(0, len(x), VISITORS)])

    def meet(held: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, y: np.ndarray, angle: np.ndarray, own: bool) -> Iterator[list[tuple[int, int]]]:
        front, y = ahead(y), y.astype(np.float32) / WHOLE
        # Of a block's own pairs, the row of the lesser angle visits the other.
        first, last = np.searchsorted(held[3], angle[0] - (0 if own else apart), "left"), np.searchsorted(held[3], angle[-1] + apart, "right")
        for lo in range(first, last, STRIP_ROWS):
            cut = slice(lo, min(last, lo + STRIP_ROWS))
            for i, j in near(held[1][cut].astype(np.float32) / WHOLE, y, (held[2][cut], front), least - slack):
                if len(i):
                    yield _stars(i, j, held[0][cut], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, angles, held, edges = None, [], [], [], None, []
        out = lambda edges: pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])
        for b in batches:
            who = list(zip(*(b.column(names.index(c)).to_pylist() for c in (*keys, "side")), strict=True))
            cuts = [0, *(k for k in range(1, len(who)) if who[k] != who[k - 1]), len(who)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                *key, side = who[lo]
                if key != now:
                    if edges:
                        yield out(spanning(edges))
                    now, ids, vectors, angles, held, edges = key, [], [], [], None, []
                for k in range(lo, hi, VISITORS):
                    part = b.slice(k, min(VISITORS, hi - k))
                    own_ids, angle, x = part.column(names.index("id")).to_numpy(), part.column(names.index("angle")).to_numpy(), whole(part.column(names.index("vec")))
                    if side == 0:
                        ids.append(own_ids)
                        vectors.append(x)
                        angles.append(angle)
                        continue
                    if not ids:
                        continue
                    if held is None:
                        x_held = np.concatenate(vectors)
                        held, vectors = (np.concatenate(ids), x_held, ahead(x_held), np.concatenate(angles)), []
                    for found in meet(held, own_ids, x, angle, side == 1):
                        edges += found
                        if len(edges) > 1 << 18:
                            edges = spanning(edges)
        if edges:
            yield out(spanning(edges))

    return dealt.mapInArrow(run, "u long, v long")
