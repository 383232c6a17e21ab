"""Text statistics, normal forms and feature hashing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .hashing import BASIS_32, PRIME_32, bound, fnv1a32, utf8_bytes

#: Dimensions of the hashed embedding and characters of its tokens.
DIM = 256
TOKEN = r"[a-z0-9_.:/-]+"
#: Different words that are hashed side by side, and characters of those that are hashed alone.
SIDE_BY_SIDE, LONG_WORD = 1 << 14, 64


def normalize_snippet(s: Column) -> Column:
    """White space runs (Unicode) as one space, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def shannon_entropy(s: Column) -> Column:
    """Bits per byte over the byte histogram; 0 for the empty string.

    Bytes are sorted and their runs counted in one pass: n log n, whatever the alphabet.
    """

    def bits(octets: Column) -> Column:
        n = F.size(octets).cast("double")
        part = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))
        start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        step = lambda a, b: F.when(a["b"] == b, F.struct(a["b"].alias("b"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(b.alias("b"), F.lit(1.0).alias("run"), (a["sum"] + part(a["run"])).alias("sum")))
        total = F.aggregate(F.array_sort(octets), start, step, lambda a: a["sum"] + part(a["run"]))
        return F.log2(n) - total / n

    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(bound(utf8_bytes(s), bits))


def truncate(s: Column, most: int = 40) -> Column:
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(f"({TOKEN})"), F.lit(1))


def tokens(s: Column) -> Column:
    """Words and their three-letter pieces, each with the prefix of its kind."""

    def of(w: Column) -> Column:
        grams = F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("g:"), F.substring(w, i, F.lit(3)))))
        return F.concat(F.array(F.concat(F.lit("w:"), w)), F.coalesce(grams, F.array().cast("array<string>")))

    return F.flatten(F.transform(words(s), of))


def hashed_cells(s: Column, dim: int = DIM) -> Column:
    """array<struct<idx, sign>>: the cell and sign of every token."""

    def cell(t: Column) -> Column:
        h = fnv1a32(t)
        return F.struct((F.shiftright(h, 1) % dim).cast("int").alias("idx"), F.when(h.bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1).alias("sign"))

    return F.transform(tokens(s), cell)


def _signed_cell(token: str, dim: int) -> tuple[int, int]:
    h = BASIS_32
    for b in token.encode():
        h = (h ^ b) * PRIME_32 & 0xFFFFFFFF
    return (h >> 1) % dim, 1 if h & 1 else -1


_gram_cell = lru_cache(1 << 17)(_signed_cell)


def _word_cells(word: str, dim: int) -> list[tuple[int, int]]:
    sums: Counter[int] = Counter()
    for idx, sign in (_signed_cell("w:" + word, dim), *(_gram_cell("g:" + word[i : i + 3], dim) for i in range(len(word) - 2))):
        sums[idx] += sign
    return list(sums.items())


def _hashed_words(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, signs, end of each word's) of words of LONG_WORD characters at most: all their tokens, side by side."""
    prime, basis = np.uint32(PRIME_32), []
    for prefix in (b"w:", b"g:"):
        h = BASIS_32
        for b in prefix:
            h = (h ^ b) * PRIME_32 & 0xFFFFFFFF
        basis.append(np.uint32(h))
    octets = np.frombuffer("".join(words).encode(), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    whole = np.full(len(words), basis[0])
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        whole[on] = (whole[on] ^ octets[start[on] + k]) * prime
    grams = np.maximum(size - 2, 0)
    ends = np.cumsum(grams + 1)
    first = ends - grams - 1  # a word's own token, its pieces after it
    piece = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    piece[first] = False
    at = np.arange(int(grams.sum())) + np.repeat(start - (np.cumsum(grams) - grams), grams)
    h = np.empty(len(piece), np.uint32)
    h[first] = whole
    part = np.full(len(at), basis[1])
    for k in range(3):
        part = (part ^ octets[at + k]) * prime
    h[piece] = part
    return ((h >> np.uint32(1)) % np.uint32(dim)).astype(np.int64), np.where(h & np.uint32(1), 1.0, -1.0), ends


def hashed_sums(texts: Iterable[str | None], n: int, dim: int = DIM) -> np.ndarray:
    """``hashed_cells`` added up, a row for each of ``n`` texts.

    The different words of many texts are hashed side by side; sums are whole, so their order does not matter.
    """
    find, sums = re.compile(TOKEN).findall, np.zeros((n, dim))
    number: dict[str, int] = {}
    row: list[int] = []
    word: list[int] = []
    count: list[int] = []

    def add() -> None:
        cell, sign, ends = _hashed_words(list(number), dim)
        w, many = np.array(word, np.int64), np.diff(ends, prepend=0)
        lo, size = ends[w] - many[w], many[w]
        who, by = np.array(row, np.int64) - row[0], np.array(count, float)
        done = np.cumsum(size)
        for a, b in _slices(done):
            at = np.arange(int(size[a:b].sum())) + np.repeat(lo[a:b] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b])
            first, last = who[a], who[b - 1] + 1
            found = np.bincount(np.repeat(who[a:b] - first, size[a:b]) * dim + cell[at], sign[at] * np.repeat(by[a:b], size[a:b]), (last - first) * dim)
            sums[row[0] + first : row[0] + last] += found.reshape(-1, dim)
        number.clear(), row.clear(), word.clear(), count.clear()

    for k, text in enumerate(texts):
        for some in batched(Counter(find((text or "").lower())).items(), SIDE_BY_SIDE):
            for w, c in some:
                if len(w) > LONG_WORD:
                    for cell, sign in _word_cells(w, dim):
                        sums[k, cell] += sign * c
                    continue
                row.append(k)
                word.append(number.setdefault(w, len(number)))
                count.append(c)
            if len(number) >= SIDE_BY_SIDE or len(row) >= 16 * SIDE_BY_SIDE:
                add()
    if number:
        add()
    return sums


def _slices(done: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of words whose tokens, counted by the running sum ``done``, are about ``most``."""
    a = 0
    while a < len(done):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _summed(docs: DataFrame, dim: int, emit, ddl: str) -> DataFrame:
    """Rows that ``emit`` makes of ids and their cells' sums; each different word is hashed once a task."""
    ship(docs.sparkSession)

    def run(batches):
        words, known = re.compile(TOKEN), {}
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found: list[dict[int, int]] = []
                for t in part.column(1).to_pylist():
                    sums: dict[int, int] = {}
                    for w, n in Counter(words.findall((t or "").lower())).items():
                        cells = known.get(w)
                        if cells is None:
                            cells = _word_cells(w, dim)
                            if len(w) <= 64:
                                if len(known) >= 100_000:
                                    known.clear()
                                known[w] = cells
                        for c, s in cells:
                            sums[c] = sums.get(c, 0) + s * n
                    found.append(sums)
                yield emit(part.column(0).to_pylist(), found)

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, ddl)


def cell_sums(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, idx, v) of (id, text) rows: ``hashed_cells`` added up.

    Cells whose signs cancel out have a row of 0.
    """

    def emit(ids, found):
        who = [i for i, sums in zip(ids, found, strict=True) for _ in sums]
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array([c for sums in found for c in sums], pa.int32()), pa.array([v for sums in found for v in sums.values()], pa.int64())], ["id", "idx", "v"])

    return _summed(docs, dim, emit, "id long, idx int, v long")


def count_vectors(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vec) of (id, text) rows: ``feature_hash`` before it is normalised."""

    def emit(ids, found):
        rows = [[sums.get(c, 0) for c in range(dim)] for sums in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["id", "vec"])

    return _summed(docs, dim, emit, "id long, vec array<int>")


def feature_hash(s: Column, dim: int = DIM) -> Column:
    """L2-normalised array<double> of signed token counts; all zero without tokens or text.

    Computed in Arrow batches: a text costs its words, not its words times ``dim``.
    """
    ship(SparkSession.active())

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        sums = hashed_sums(texts, len(texts), dim)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        sums /= np.where(length > 0, length, 1.0)[:, None]
        return pd.Series(list(sums))

    return run(s)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length: the cosine of normalised vectors."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def round3(x: Column) -> Column:
    """Three decimals, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def age_days(at: Column, now: Column) -> Column:
    """Days between two ISO timestamps, fractional; 0 if the earlier cannot be read."""
    a, b = F.try_to_timestamp(at), F.to_timestamp(now)
    return F.coalesce((F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400_000_000.0), F.lit(0.0))


def fmt_ranges(ranges: Column, most: int = 6) -> Column:
    """``3–5, 9`` from array<struct<lo, hi>>; beyond ``most``, how many more."""
    shown = F.transform(F.slice(ranges, 1, most), lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat_ws("–", r["lo"].cast("string"), r["hi"].cast("string"))))
    more = F.size(ranges) - most
    return F.concat(F.array_join(shown, ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def wrap(text: str, width: int = 72) -> list[str]:
    """Greedy lines of at most ``width`` bytes, for terminal output; a longer word stands alone."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1].encode()) + 1 + len(word.encode()) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines
