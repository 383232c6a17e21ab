"""Point queries about a repository: definition, callers, reach, complexity, exports, imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..analysis import tables
from . import graph

KINDS = ("definition", "callers", "blast_radius", "complexity", "exports", "imports")


@dataclass
class Repository:
    """The parsed tables of a repository; built once, asked many times."""

    symbols: DataFrame
    imports: DataFrame
    functions: DataFrame
    edges: DataFrame
    occurrences: DataFrame | None = None

    @classmethod
    def of(cls, files: DataFrame, occurrences: DataFrame | None = None) -> Repository:
        """From (path, content) rows."""
        rows = tables.parsed(files).cache()
        imports = tables.imports(rows)
        return cls(tables.symbols(rows), imports, tables.functions(rows), graph.import_edges(imports, files.select("path")), occurrences)

    def definitions(self, name: str) -> DataFrame:
        return self.symbols.filter(F.col("name") == name).orderBy("file", "start_line")

    def definition_of(self, name: str, hint: str | None = None):
        """The hinted file's definition, else the first exported one, else the first."""
        return picked(self.symbols.filter(F.col("name") == name), self.symbols.sparkSession.createDataFrame([(name, hint)], "name string, hint string")).first()


def picked(symbols: DataFrame, asks: DataFrame) -> DataFrame:
    """(name, hint, file, start_line): of each question's definitions the hinted file's, else the first exported one, else the first."""
    rows = asks.join(symbols.select("name", "file", "start_line", "exported"), "name")
    order = F.struct((~F.col("file").eqNullSafe(F.col("hint"))).alias("elsewhere"), (~F.col("exported")).alias("own"), "file", "start_line")
    best = rows.groupBy("name", "hint").agg(F.min(order).alias("b"))
    return best.select("name", "hint", "b.file", "b.start_line")


def inspect(repo: Repository, kind: str, target: str, file: str | None = None) -> dict:
    """The answer as a plain dictionary; ``not_found`` where there is nothing to tell."""
    missing = {"kind": kind, "target": target, "not_found": True}
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    if kind == "definition":
        rows = [r.asDict() for r in repo.definitions(target).collect()]
        return {"kind": kind, "target": target, "definitions": rows} if rows else missing
    if kind in ("callers", "blast_radius"):
        own = repo.definition_of(target, file)
        if own is None:
            return missing
        one = repo.symbols.filter((F.col("name") == target) & (F.col("file") == own["file"]))
        row = None
        if kind == "blast_radius" and repo.occurrences is not None:
            row = graph.precise_reach(one, repo.occurrences, graph.ALL).first()
        if row is not None:
            reach = {"direct_callers": row["direct"], "transitive_callers": row["total_refs"], "confidence": graph.PRECISE, "method": "scip"}
        else:
            row = graph.heuristic_reach(one, repo.edges, graph.ALL).first()
            reach = {"direct_callers": row["direct"] if row else 0, "transitive_callers": row["transitive"] if row else 0, "confidence": graph.HEURISTIC, "method": "import graph (TS/JS)"}
        callers = list(row["callers"]) if row else []
        out = {"kind": kind, "target": target, "file": own["file"], "line": own["start_line"], "callers": callers, **reach}
        return out | ({"crosses_api_boundary": bool(row and row["crosses"])} if kind == "blast_radius" else {})
    if kind == "complexity":
        rows = [r.asDict() for r in repo.functions.filter(F.col("file") == target).orderBy(F.desc("score"), "start_line").collect()]
        return {"kind": kind, "target": target, "functions": rows, "max": max(r["score"] for r in rows)} if rows else missing
    if kind == "exports":
        rows = [r.asDict() for r in repo.symbols.filter((F.col("file") == target) & F.col("exported")).orderBy("start_line").collect()]
        return {"kind": kind, "target": target, "exports": rows} if rows else missing
    rows = [r.asDict() for r in repo.imports.filter(F.col("file") == target).orderBy("source").collect()]
    return {"kind": kind, "target": target, "imports": rows} if rows else missing
