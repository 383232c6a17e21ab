"""The review ledger: an append-only event table, and what it leaves unaccounted for.

Events (repo, seq, event, key, value): ``start`` begins a review and drops what came before;
``floor`` a finding id; ``symbol`` a changed export (key) of a file (value); ``inspect`` a
look (value: kind) at a symbol (key); ``dismissed`` or ``accepted`` a finding id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Looks that trace a symbol's users; rows shown in a block of text.
TRACES = ("callers", "blast_radius")
SHOWN = 12


def parse_symbols(lines: DataFrame, col: str = "line") -> DataFrame:
    """(file, symbol) of ``file: a, b`` lines; lines without the separator say nothing."""
    c = F.col(col)
    at = F.instr(c, ": ")
    rows = lines.filter(at > 0).select(F.substring(c, F.lit(1), at - 1).alias("file"), F.explode(F.split(F.substr(c, at + 2), ",")).alias("symbol"))
    return rows.select("file", F.trim("symbol").alias("symbol")).filter("symbol <> ''")


def current(ledger: DataFrame) -> DataFrame:
    """Events since the last start of each repository; none where no review began.

    The starts are counted before they meet the events, so a repository that holds most of the
    ledger is split by the join and not sorted in one task.  Every list and count of an audit begins
    here: a table of starts spares each of them two sorts, which one task would hold all at once.
    """
    start = ledger.filter("event = 'start'").groupBy("repo").agg(F.max("seq").alias("__s"))
    return ledger.join(start.hint("shuffle_hash"), "repo").filter("seq >= __s").select(*ledger.columns)


def fates(ledger: DataFrame) -> DataFrame:
    """(repo, id, fate): the last fate of every finding."""
    rows = ledger.filter(F.col("event").isin("dismissed", "accepted"))
    return rows.groupBy("repo", F.col("key").alias("id")).agg(F.max_by("event", "seq").alias("fate"))


def unaccounted(ledger: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(repo, id): floor findings that were neither resolved nor kept."""
    floor = ledger.filter("event = 'floor'").select("repo", F.col("key").alias("id")).distinct()
    rest = floor.join(fates(ledger), ["repo", "id"], "left_anti")
    return rest if kept is None else rest.join(kept.select("repo", "id"), ["repo", "id"], "left_anti")


def untraced(ledger: DataFrame) -> DataFrame:
    """(repo, file, symbol): changed exports whose users nobody looked at."""
    seen = ledger.filter((F.col("event") == "inspect") & F.col("value").isin(*TRACES)).select("repo", F.col("key").alias("symbol")).distinct()
    return ledger.filter("event = 'symbol'").select("repo", F.col("value").alias("file"), F.col("key").alias("symbol")).join(seen, ["repo", "symbol"], "left_anti")


def ratios(ledger: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row for each repository: counts of both coverages and whether all is accounted for."""
    base = ledger.groupBy("repo").agg(F.count_distinct(F.when(F.col("event") == "floor", F.col("key"))).alias("floor"), F.count_if(F.col("event") == "symbol").alias("symbols"), F.count_if(F.col("event") == "inspect").alias("inspect_calls"))
    fate = fates(ledger).groupBy("repo").agg(F.count_if(F.col("fate") == "dismissed").alias("dismissed"), F.count_if(F.col("fate") == "accepted").alias("accepted"))
    open_ = unaccounted(ledger, kept).groupBy("repo").agg(F.count("*").alias("unaccounted"))
    blind = untraced(ledger).groupBy("repo").agg(F.count("*").alias("untraced"))
    out = base
    for part in (fate, open_, blind):
        out = out.join(part, "repo", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("dismissed", "accepted", "unaccounted", "untraced")]
    out = out.select("repo", "floor", "symbols", "inspect_calls", *zero)
    if kept is not None:
        on_floor = ledger.filter("event = 'floor'").select("repo", F.col("key").alias("id")).distinct().join(kept.select("repo", "id").distinct(), ["repo", "id"], "left_semi").groupBy("repo").agg(F.count("*").alias("kept"))
        out = out.join(on_floor, "repo", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    return out.withColumn("traced", F.col("symbols") - F.col("untraced")).withColumn("clean", (F.col("untraced") == 0) & (F.col("unaccounted") == 0))


def _first_lines(rows: DataFrame, line: Column, order: list[str], shown: int, name: str) -> DataFrame:
    """(repo, name): the first ``shown`` lines of each repository in order, cut before they are gathered."""
    first = rows.withColumn("__no", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("__no") <= shown)
    listed = F.array_sort(F.collect_list(F.struct("__no", line.alias("line"))))
    return first.groupBy("repo").agg(F.transform(listed, lambda r: r["line"]).alias(name))


def blocks(ledger: DataFrame, kept: DataFrame | None = None, shown: int = SHOWN) -> DataFrame:
    """(repo, text): the audit of every repository's current review, with at most ``shown`` rows of each list.

    All texts come of one plan: counts by repository, and lists of which no task gathers more
    than ``shown`` rows of a repository.  Repositories without a review have no row.
    """
    own = current(ledger)
    blind = untraced(own)
    seen = _first_lines(blind, F.format_string("  never inspected: %s (%s)", "symbol", "file"), ["file", "symbol"], shown, "blind_lines")
    left = _first_lines(unaccounted(own, kept), F.format_string("  unaccounted: %s", "id"), ["id"], shown, "open_lines")
    rows = ratios(own, kept).join(seen, "repo", "left").join(left, "repo", "left")
    more = lambda n: F.when(F.col(n) > shown, F.array(F.format_string("  and %d more", F.col(n) - shown))).otherwise(F.array().cast("array<string>"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    said = F.format_string("%d kept", "kept") if kept is not None else F.lit("kept not declared")
    head = F.format_string("Audit: %d/%d changed exports traced, %d inspect call(s).", "traced", "symbols", "inspect_calls")
    floor = F.format_string("Floor: %d finding(s), %s, %d dismissed, %d accepted, %d unaccounted.", F.col("floor"), said, F.col("dismissed"), F.col("accepted"), F.col("unaccounted"))
    end = F.when(F.col("clean"), "AUDIT CLEAN").otherwise("AUDIT INCOMPLETE")
    lines = F.concat(F.array(head), listed("blind_lines"), more("untraced"), F.array(floor), listed("open_lines"), more("unaccounted"), F.array(end))
    return rows.select("repo", F.array_join(lines, "\n").alias("text"))


def block(ledger: DataFrame, repo: str, kept: DataFrame | None = None, shown: int = SHOWN) -> str:
    """The audit of one repository as text."""
    row = blocks(ledger.filter(F.col("repo") == repo), kept, shown).first()
    return "Audit: no review was started for this repository." if row is None else row["text"]
