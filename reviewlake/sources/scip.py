"""SCIP index files as a table of occurrences.

The wire format needs varints and length-delimited fields only, so a small decoder in Python
reads it; no jar is involved.  An index is a sequence of documents with their lengths before
them.  ``load`` is a data source with partitions: a scan that reads lengths only and skips what
they span finds the documents' places, and each task reads and decodes a range of documents.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship

# Field numbers of documents, of their parts and of an occurrence's parts; the definition bit.
DOCUMENTS, PATH, OCCURRENCES = 2, 1, 2
RANGE, SYMBOL, ROLES = 1, 2, 3
DEFINITION = 1
DDL = "file string, line int, symbol string, is_def boolean"
#: Bytes of a task's range, bytes read at a time to find lengths, and rows handed on at a time.
SPLIT, HEADS, BATCH = 16 << 20, 1 << 16, 50_000
PLACES = ("index.scip", ".cache/index.scip")
#: Indexers that are tried, in this order, and how each is asked for an index.
INDEXERS = (("scip-typescript", "index", "--output", "{out}"), ("scip-python", "index", "--output", "{out}"), ("rust-analyzer", "scip", ".", "--output", "{out}"))


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a message; fixed-width fields are skipped."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
            yield tag >> 3, value
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("a field leads out of its message")
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def occurrences(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """(file, line from 1, symbol, is_def); local and empty symbols are left out."""
    for number, doc in fields(data):
        if number != DOCUMENTS or not isinstance(doc, bytes):
            continue
        parts = list(fields(doc))
        path = next((v.decode() for k, v in parts if k == PATH and isinstance(v, bytes)), "")
        for k, occ in parts:
            if k != OCCURRENCES or not isinstance(occ, bytes):
                continue
            line, symbol, roles = None, "", 0
            for f, v in fields(occ):
                if f == RANGE and line is None:
                    line = varint(v, 0)[0] if isinstance(v, bytes) and v else v if isinstance(v, int) else 0
                elif f == SYMBOL and isinstance(v, bytes):
                    symbol = v.decode()
                elif f == ROLES and isinstance(v, int):
                    roles = v
            if symbol and not symbol.startswith("local "):
                yield path.replace("\\", "/"), (line or 0) + 1, symbol, bool(roles & DEFINITION)


def read(files: DataFrame) -> DataFrame:
    """Occurrences of (content binary) rows; an index that cannot be read gives none."""

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for data in pdf["content"]:
                try:
                    rows += list(occurrences(bytes(data)))
                except (ValueError, IndexError, UnicodeDecodeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "line", "symbol", "is_def"]).astype({"line": "int32", "is_def": "bool"})

    ship(files.sparkSession)
    return files.select("content").mapInPandas(run, DDL)


class Range(InputPartition):
    """Bytes of a file that hold whole fields."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    """A file of any store that Arrow knows: a local path, or one with a scheme."""
    store, inside = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return store.open_input_file(inside)


def ranges(file, size: int, split: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of whole top-level fields of ``split`` bytes or more; reads lengths only.

    What follows a length that leads out of the file is a last range, which will not decode.
    """
    start = at = 0
    block, base = b"", 0
    while at < size:
        if at - base + 20 > len(block) and base + len(block) < size:  # a field's head is within the block
            file.seek(at)
            block, base = file.read(min(HEADS, size - at)), at
        try:
            tag, k = varint(block, at - base)
            kind = tag & 7
            n, k = varint(block, k) if kind in (0, 2) else ({1: 8, 5: 4}[kind], k)
        except (IndexError, KeyError):
            break
        at = base + k + (0 if kind == 0 else n)
        if at - start >= split and at <= size:
            yield start, at
            start = at
    if start < size:
        yield start, size


class ScipReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            with _open(path) as f:
                found += [Range(path, a, b) for a, b in ranges(f, f.size(), self.split)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        with _open(partition.path) as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        rows: list[tuple] = []
        with contextlib.suppress(ValueError, IndexError, UnicodeDecodeError, TypeError):
            rows = list(occurrences(data))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
        for k in range(0, len(rows), BATCH):
            columns = zip(*rows[k : k + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "line", "symbol", "is_def"])


class ScipSource(DataSource):
    """``spark.read.format("scip")``: one row for each occurrence; option ``split`` is bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "scip"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> ScipReader:
        return ScipReader(json.loads(self.options["files"]), int(self.options.get("split", SPLIT)))


def load(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """Occurrences of index files; a range of documents that cannot be decoded gives none."""
    ship(spark)
    spark.dataSource.register(ScipSource)
    return spark.read.format("scip").option("files", json.dumps(paths)).option("split", split).load()


def find(root: str, explicit: str | None = None) -> str | None:
    if explicit:
        return explicit if os.path.isfile(explicit) else None
    return next((p for p in (os.path.join(root, n) for n in PLACES) if os.path.isfile(p)), None)


def build(root: str) -> str | None:
    """Let the first installed indexer write an index below the root; None if there is none or it fails."""
    out = os.path.join(root, PLACES[0])
    for command in INDEXERS:
        if shutil.which(command[0]):
            done = subprocess.run([a.format(out=out) for a in command], cwd=root, capture_output=True)
            return out if done.returncode == 0 and os.path.isfile(out) else None
    return None
