"""Parsed sources as DataFrames: one Arrow pass over (path, content), filtered and dealt over all tasks beforehand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import ship, spread
from .structure import VOCABULARY, parse

DDL = "file string, what string, name string, kind string, start_line int, end_line int, exported boolean, score int, names array<string>, source string"


def parsed(files: DataFrame) -> DataFrame:
    """Rows of every kind; ``what`` is symbol, import or function.  Null contents give none."""

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for path, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
                p = parse(lang, content)
                rows += [(path, "symbol", s.name, s.kind, s.start_line, s.end_line, s.exported, None, None, None) for s in p.symbols]
                rows += [(path, "import", None, None, None, None, None, None, i.names, i.source) for i in p.imports]
                rows += [(path, "function", f.name, None, f.start_line, f.end_line, None, f.score, None, None) for f in p.functions]
            yield pd.DataFrame(rows, columns=["file", "what", "name", "kind", "start_line", "end_line", "exported", "score", "names", "source"]).astype({"start_line": "Int32", "end_line": "Int32", "score": "Int32", "exported": "boolean"})

    ship(files.sparkSession)
    known = files.withColumn("lang", paths.language(F.col("path"))).filter(F.col("content").isNotNull() & F.col("lang").isin("python", *VOCABULARY) & ~paths.is_generated(F.col("path")))
    return spread(known.select("path", "lang", "content"), "path").mapInPandas(run, DDL)


def symbols(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'symbol'").select("file", "name", "kind", "start_line", "end_line", "exported")


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'import'").select("file", "names", "source")


def functions(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'function'").select("file", "name", "start_line", "end_line", "score")
