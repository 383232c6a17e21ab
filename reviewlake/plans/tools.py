"""The tool surface: one class whose methods are the tools, and a small command line."""

from __future__ import annotations

import argparse
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis import tables
from ..functions import paths
from ..functions.text import feature_hash
from ..operators import anchors, audit, graph, memory
from ..operators.feedback import MemoryStore, SuppressionStore
from ..operators.inspect import Repository, inspect
from ..runtime import shared_folder
from ..sources import contract, external, git, scip, stores, unified_diff
from ..sources import reports as readers
from ..sources.log import Log
from . import sinks
from .review import Context, Report, review


# Fixed value: changed files whose exports a review asks to trace.
CHANGED_SHOWN = 20


def _events(event: str, rows: DataFrame) -> DataFrame:
    value = F.col("value") if "value" in rows.columns else F.lit(None)
    return rows.select(F.lit(event).alias("event"), "key", value.cast("string").alias("value"))


@dataclass
class Tools:
    """Reviews of one work tree, with its learned feedback below ``home``."""

    spark: SparkSession
    root: str
    home: str
    ledger_path: str | None = None

    # --- tables --------------------------------------------------------------------------

    def context(self, mode: git.Mode, scip_path: str | None = None, metrics: bool = True) -> Context:
        patches = git.patches(self.spark, self.root, mode)
        files, added = unified_diff.changed_files(patches).cache(), unified_diff.added_lines(patches).cache()
        names = [r["path"] for r in unified_diff.changed_list(files).collect()]
        head = git.head_files(self.spark, self.root).filter(F.col("path").isin(names)) if names else None
        ctx = Context(self.spark, files, added, mode.kind)
        if head is not None:
            ctx.modified = head.select("path", "modified")
        if (found := readers.find_coverage(self.root)) is not None:
            rows = readers.normalized(readers.coverage(readers.read_report(self.spark, found), found), self.root)
            ctx.coverage.append((rows, os.path.relpath(found, self.root), os.path.getmtime(found)))
        for p in readers.find_mutation(self.root):
            rows = (readers.stryker if p.endswith(".json") else readers.cargo_mutants)(readers.read_report(self.spark, p))
            ctx.mutants.append((readers.normalized(rows, self.root), os.path.getmtime(p)))
        left = external.find(self.root)
        ctx.tools = {t: external.read(readers.read_report(self.spark, p), t, self.root) for t, p in left.items() if not t.startswith("osv")}
        locks = [p for p in names if os.path.basename(p).lower() in paths.LOCK_FILES]
        if "osv" in left and locks:
            base = external.osv(readers.read_report(self.spark, left["osv-base"])) if "osv-base" in left else None
            ctx.vulnerabilities = (external.osv(readers.read_report(self.spark, left["osv"])), base, locks[0])
        if mode.kind != "all":
            try:
                ctx.commits = git.parse_log(self.spark.createDataFrame([(git.log_text(self.root),)], "raw string"))
                ctx.existing = git.head_files(self.spark, self.root).select("path")
            except git.GitError:
                ctx.commits = None
        if head is not None and metrics:
            repo = git.indexed_files(self.spark, self.root)
            parsed = tables.parsed(repo).cache()
            ctx.symbols, ctx.edges = tables.symbols(tables.parsed(head)), graph.import_edges(tables.imports(parsed), repo.select("path"))
            base = git.base_files(self.spark, self.root, mode, names)
            ctx.functions = (tables.functions(tables.parsed(head)), tables.functions(tables.parsed(base)))
        if (index := scip.find(self.root, scip_path)) is not None:
            ctx.occurrences = scip.load(self.spark, index)
        return ctx

    def suppressions(self) -> SuppressionStore:
        """The store; what an earlier tool or an earlier form of the store left is its seed."""
        return SuppressionStore(self.spark, os.path.join(self.home, "learnings.log"), self._seed("learnings", memory.LEARNING_DDL, stores.learnings))

    def notes(self) -> MemoryStore:
        return MemoryStore(self.spark, os.path.join(self.home, "memories.log"), self._seed("memories", memory.MEMORY_DDL, stores.memories))

    def learnings(self) -> DataFrame:
        return self.suppressions().list()

    def memories(self) -> DataFrame:
        return self.notes().list()

    def _seed(self, name: str, ddl: str, earlier) -> DataFrame | None:
        path = os.path.join(self.home, name)
        if os.path.isdir(path):
            return stores.load(self.spark, path, ddl)
        return earlier(self.spark, path + ".json").select(*[f.split()[0] for f in ddl.split(", ")]) if os.path.isfile(path + ".json") else None

    def changed_symbols(self, ctx: Context, mode: git.Mode, most: int = CHANGED_SHOWN) -> DataFrame:
        """(line): ``file: a, b`` for the first changed files whose exports the hunks touch."""
        if ctx.symbols is None:
            return self.spark.createDataFrame([], "line string")
        index = unified_diff.anchor_index(git.patches(self.spark, self.root, mode))
        hunks = index.groupBy(F.col("path").alias("file"), "hunk_idx").agg(F.min("new_line").alias("lo"), F.max("new_line").alias("hi"))
        own = ctx.symbols.filter("exported").select("file", "name", F.col("start_line").alias("line"))
        rows = graph.changed_exports(own, hunks).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
        return rows.orderBy("file").limit(most).select(F.concat("file", F.lit(": "), "names").alias("line"))

    def ledger(self) -> DataFrame:
        """Events in the order in which they were committed."""
        return self._ledger().read().withColumn("seq", F.col("__commit")).select("repo", "seq", "event", "key", "value")

    def _ledger(self) -> Log:
        if self.ledger_path is None:
            self.ledger_path = f"{shared_folder(self.spark)}/ledger-{uuid.uuid4().hex}"
        return Log(self.spark, self.ledger_path, "repo string, event string, key string, value string")

    def _note_event(self, event: str, key: str | None = None, value: str | None = None) -> None:
        self._note_events(self.spark.createDataFrame([(event, key, value)], "event string, key string, value string"))

    def _note_events(self, rows: DataFrame) -> None:
        """(event, key, value) rows, none of which passes through the driver."""
        self._ledger().append(rows.select(F.lit(self.root).alias("repo"), "event", "key", "value"))

    # --- tools ---------------------------------------------------------------------------

    def floor(self, mode: git.Mode = git.Mode()) -> DataFrame:
        """Findings after the contract, before learned suppression."""
        rows = contract.policy(review(self.context(mode), home=self.home).findings, self.preferences()).filter("reason is null").drop("reason")
        self._note_events(_events("floor", rows.select(F.col("id").alias("key"))))
        return rows

    def review(self, now: str, mode: git.Mode = git.Mode(), apply_learnings: bool = True, scip_path: str | None = None) -> tuple[Report, DataFrame]:
        """(report of kept findings, suppressed findings); starts the ledger anew.

        The ledger gets the floor's findings and the changed exports whose users are to be traced.
        """
        ctx = self.context(mode, scip_path)
        report = review(ctx, home=self.home)
        kept = contract.policy(report.findings, self.preferences()).filter("reason is null").drop("reason").cache()
        self._note_event("start")
        symbols = audit.parse_symbols(self.changed_symbols(ctx, mode))
        self._note_events(_events("floor", kept.select(F.col("id").alias("key"))).union(_events("symbol", symbols.select(F.col("symbol").alias("key"), F.col("file").alias("value")))))
        suppressed = kept.limit(0)
        if apply_learnings:
            kept, suppressed = memory.apply(kept, self.learnings(), now)
        return Report(kept, report.notes, report.collectors_run, report.adapters_absent), suppressed

    def inspect(self, kind: str, target: str, file: str | None = None) -> dict:
        out = inspect(Repository.of(git.indexed_files(self.spark, self.root)), kind, target, file)
        if not out.get("not_found"):
            self._note_event("inspect", target, kind)
        return out

    def preferences(self) -> contract.Contract:
        return contract.load(self.root, self.home)

    def report(self, kept_ids: list[str] | None = None) -> str:
        kept = self.spark.createDataFrame([(self.root, i) for i in kept_ids], "repo string, id string") if kept_ids is not None else None
        return audit.block(self.ledger(), self.root, kept)

    def pr_review(self, findings: DataFrame, summary: str, mode: git.Mode = git.Mode(), approve_when_clean: bool = False) -> DataFrame:
        index = unified_diff.anchor_index(git.patches(self.spark, self.root, mode))
        return anchors.payload(findings, index, summary, approve_when_clean)

    def _learn(self, fid: str, rule_id: str, text: str, signal: str, scope: str, now: str) -> None:
        new = self.spark.createDataFrame([(fid, rule_id, text, signal, scope, now)], memory.LEARNING_DDL)
        self.suppressions().record(new)

    def _finding(self, fid: str, mode: git.Mode, rule_id: str | None, text: str | None) -> tuple[str, str]:
        """Rule and text of a finding: what the caller says, else what the change shows now, else nothing to go by."""
        if text is None:
            found = review(self.context(mode)).findings.filter(F.col("id") == fid).select("rule_id", memory.candidate_text().alias("text")).first()
            if found is not None:
                return found["rule_id"], found["text"]
        return rule_id or "unknown", text or ""

    def dismiss(self, fid: str, now: str, rule_id: str | None = None, text: str | None = None, mode: git.Mode = git.Mode()) -> None:
        """Teach that a finding is noise, by its id; without a text it is looked up in the change."""
        rule_id, text = self._finding(fid, mode, rule_id, text)
        self._learn(fid, rule_id, text, "dismissed", "finding", now)
        self._note_event("dismissed", fid)

    def accept(self, fid: str, now: str, rule_id: str | None = None, text: str | None = None, mode: git.Mode = git.Mode()) -> None:
        """Teach that a finding is real, and remember its text."""
        rule_id, text = self._finding(fid, mode, rule_id, text)
        self._learn(fid, rule_id, text, "accepted", "finding", now)
        if text:
            self.note(text, now, kind="accepted")
        self._note_event("accepted", fid)

    def index(self) -> str:
        """Build an index of exact references, if an indexer is installed; later reviews find it."""
        path = scip.build(self.root)
        return f"indexed: {scip.load(self.spark, path).count()} occurrences in {os.path.relpath(path, self.root)}" if path else "no indexer is installed, or it failed; the import graph answers"

    def mute(self, rule_id: str, now: str) -> None:
        self._learn("", rule_id, rule_id, "dismissed", "rule", now)

    def recall(self, query: str, limit: int = memory.RECALL_LIMIT) -> DataFrame:
        return self.notes().recall(F.lit(query), limit, embed=feature_hash)

    def note(self, text: str, now: str, file: str | None = None, kind: str = "note") -> None:
        new = self.spark.createDataFrame([(kind, text, None, file)], "kind string, text string, scope string, file string")
        self.notes().remember(new, now)


def main(argv: list[str] | None = None) -> int:
    """``review`` and ``inspect`` from a shell: 0, 1 if the gate fails, 2 on errors."""
    parser = argparse.ArgumentParser(prog="reviewlake")
    sub = parser.add_subparsers(dest="command", required=True)
    r, i = sub.add_parser("review"), sub.add_parser("inspect")
    for p in (r, i):
        p.add_argument("--root", default=".")
    r.add_argument("--staged", action="store_true")
    r.add_argument("--all", action="store_true")
    r.add_argument("--base")
    r.add_argument("--scip")
    r.add_argument("--no-metrics", action="store_true")
    r.add_argument("--no-color", action="store_true")
    r.add_argument("--format", choices=("pretty", "json", "sarif"), default="pretty")
    r.add_argument("--fail-on", choices=("critical", "high", "medium", "low", "info"))
    i.add_argument("kind")
    i.add_argument("target")
    i.add_argument("--file")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    root = os.path.abspath(args.root)
    tools = Tools(spark, root, os.path.join(root, ".review"))
    if args.command == "inspect":
        import json

        print(json.dumps(tools.inspect(args.kind, args.target, args.file), indent=2))
        return 0
    if not git.is_repository(root):
        print("not a git repository")
        return 2
    mode = git.Mode("all") if args.all else git.Mode("base", args.base) if args.base else git.Mode("staged") if args.staged else git.Mode()
    report = review(tools.context(mode, args.scip, not args.no_metrics))
    rows = report.findings.cache()
    total = Report(rows, report.notes, report.collectors_run, report.adapters_absent).summary()
    print(sinks.report_json(rows, total, report.notes) if args.format == "json" else sinks.sarif(rows).first()["sarif"] if args.format == "sarif" else sinks.pretty(rows, total, not args.no_color))
    return sinks.gate(rows, args.fail_on) if args.fail_on else 0
