"""Byte-level BPE by a local rank file, with the tiktoken library.

A text is matched by a pattern, every match is merged by rank, and ids decode to raw bytes, so
that the round trip is exact even where an id ends inside a character.  Long texts are cut
first, at places where the pattern begins a new match whatever stands around them:

* between anything and the white space after it;
* before the last character of a run of white space that something follows;
* between an ASCII letter and an ASCII digit or mark after it, and between a digit and a mark
  or letter after it.

The pattern has no match across such a place, and its one look-ahead (no text after the white
space) gives the same answer on both sides.  So the parts' ids follow each other unchanged.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, session

#: Characters of a part of a long text, at least.
PART_CHARS = 1 << 16
#: White space as the pattern's engine knows it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(rf"[^{WHITE}](?=[{WHITE}])|[{WHITE}](?=[{WHITE}][^{WHITE}])|[A-Za-z](?=[!-@\[-`{{-~])|[0-9](?=[!-/:-~])")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a text at the first safe place after every ``size`` characters."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class RankFile:
    """One vocabulary in one worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.engine = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for b, r in ranks.items():
            lengths[r] = len(b)
        self.known = lengths > 0
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        entries = bytearray(int(self.start[-1]))
        for b, r in ranks.items():
            entries[self.start[r] : self.start[r] + len(b)] = b
        self.bytes = np.frombuffer(bytes(entries), np.uint8)

    def ids(self, text: str) -> np.ndarray:
        found = [self.engine.encode_to_numpy(p, disallowed_special=()) for p in parts(text) if p]
        return np.concatenate(found).astype("<u4", copy=False) if found else np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The raw bytes of ids; None if one is not in the vocabulary."""
        at = ids.astype(np.int64)
        if not len(at):
            return b""
        if at.max() >= len(self.known) or not self.known[at].all():
            return None
        lengths = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[at] - ends + lengths, lengths)].tobytes()


@functools.cache
def rank_file(path: str, pattern: str) -> RankFile:
    return RankFile(path, pattern)


def _per_row(df: DataFrame, id_col: str, value: Column, fn, names: list[str], ddl: str) -> DataFrame:
    """Rows of (id, value) through ``fn(value) -> tuple``, a few MB at a time."""
    session(df)
    kinds = [pa.int64() if n == "n_tokens" else pa.binary() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, 1):
                rows = [fn(v) for v in b.column(1).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, *names])

    return df.select(F.col(id_col), value.alias("__value")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {ddl}")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): the ids of whole texts as little-endian unsigned 32-bit numbers.

    Null texts count as empty; rows with equal or null ids each get a row; strings that name
    special tokens are ordinary text; other columns take no part.
    """

    def one(text: str | None) -> tuple:
        ids = rank_file(ranks, pattern).ids(text or "")
        return len(ids), ids.tobytes()

    return _per_row(docs, id_col, F.col(text_col), one, ["n_tokens", "ids"], "n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the raw bytes of each row's ids.

    Null ids count as none; ids outside the vocabulary, or a number of bytes that four does
    not divide, give null.
    """

    def one(ids: bytes | None) -> tuple:
        ids = ids or b""
        return (rank_file(ranks, pattern).decode(np.frombuffer(ids, "<u4")) if len(ids) % 4 == 0 else None,)

    return _per_row(encoded, id_col, F.col(ids_col), one, ["decoded"], "decoded binary")


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``decoded``, the bytes that the ids decode to, in one pass."""

    def one(text: str | None) -> tuple:
        v = rank_file(ranks, pattern)
        ids = v.ids(text or "")
        return len(ids), ids.tobytes(), v.decode(ids)

    return _per_row(docs, id_col, F.col(text_col), one, ["n_tokens", "ids", "decoded"], "n_tokens long, ids binary, decoded binary")
