"""Reports as JSON, SARIF, terminal text and agent-shaped tables; the gate."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import wrap
from ..operators import findings as fd
from ..runtime import checkpoint
from ..sources.contract import Contract


def json_rows(findings: DataFrame) -> DataFrame:
    """(json): one document for each finding, null fields left out."""
    cols = [c for c in findings.columns if c not in fd.ORDINALS]
    return findings.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))


def report_json(findings: DataFrame, summary: DataFrame, notes: list[str] = ()) -> str:
    """The whole report of one review; its findings fit the driver, as its reader must hold them."""
    rows = [json.loads(r["json"]) for r in json_rows(findings).collect()]
    return json.dumps({"summary": summary.first().asDict(), "findings": rows, "notes": list(notes)}, indent=2, ensure_ascii=False)


def sarif_results(findings: DataFrame, *beside: Column) -> DataFrame:
    """Results with SARIF levels and regions that begin at 1, and columns ``beside`` them."""
    start, end = F.greatest(F.col("region.start_line"), F.lit(1)), F.greatest(F.col("region.end_line"), F.col("region.start_line"), F.lit(1))
    region = F.struct(start.alias("startLine"), F.greatest(F.col("region.start_col"), F.lit(1)).alias("startColumn"), end.alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(
        *beside,
        F.col("rule_id").alias("ruleId"),
        sev.to_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(F.col("id").alias("primary")).alias("partialFingerprints"),
    )


def sarif(findings: DataFrame, tool: str = "reviewlake") -> DataFrame:
    """One row: a SARIF 2.1.0 log as JSON."""
    rules = findings.agg(F.array_sort(F.collect_set("rule_id")).alias("ids"))
    results = sarif_results(findings).agg(F.collect_list(F.struct("*")).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("ids", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")
    return rules.join(results, how="inner").select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def sarif_runs(findings: DataFrame, rows_per_run: int = 5000, tool: str = "reviewlake") -> DataFrame:
    """(shard, sarif): logs of one run each, of about ``rows_per_run`` results in the report's order.

    A finding's shard follows from its id, so that no task holds all findings; every run lists
    the rules of all, which are few, and its results point into that list.
    """
    findings = checkpoint(findings)  # read three times below; made once
    shards = max(1, -(-findings.count() // rows_per_run))
    ids = F.broadcast(findings.select("rule_id").distinct().agg(F.array_sort(F.collect_list("rule_id")).alias("ids")))
    order = F.struct(*[F.col(c) for c in fd.ORDINALS if c in findings.columns], F.col("file"), F.col("region.start_line").alias("line"), F.col("id")).alias("order")
    rows = sarif_results(findings, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), order).join(ids)
    result = F.struct("ruleId", (F.array_position("ids", F.col("ruleId")) - 1).alias("ruleIndex"), "level", "message", "locations", "partialFingerprints")
    whole = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("order", result.alias("result")))).alias("rows"), F.first("ids").alias("ids"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("ids", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rows", lambda r: r["result"]).alias("results"))
    return whole.select("shard", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def write_sarif(findings: DataFrame, path: str, rows_per_run: int = 5000, tool: str = "reviewlake") -> None:
    """``sarif_runs`` as files, one log in each, in folders named by shard."""
    sarif_runs(findings, rows_per_run, tool).write.partitionBy("shard").text(path)


def gate(findings: DataFrame, least: str) -> int:
    """1 if a finding reaches the severity, else 0; stops at the first."""
    return 0 if fd.reaches(findings, least).isEmpty() else 1


def agent_shape(findings: DataFrame) -> DataFrame:
    """Camel-case rows for agents."""
    return findings.select("id", F.col("rule_id").alias("ruleId"), "severity", "tier", sev.category_tag(F.col("category")).alias("category"), "file", F.col("region.start_line").alias("line"), F.col("region.end_line").alias("endLine"), "title", "message", "confidence", F.col("blast_radius").alias("blastRadius"))


def pretty(findings: DataFrame, summary: DataFrame, color: bool = False) -> str:
    """Terminal text grouped by tier, in the report's order."""
    bold = (lambda s: f"\033[1m{s}\033[0m") if color else str
    rows = agent_shape(findings).collect()
    out = []
    for tier in sev.TIERS:
        own = [r for r in rows if r["tier"] == tier]
        if own:
            out.append(bold(f"{tier} ({len(own)})"))
            for r in own:
                out.append(f"  {r['file']}:{r['line']}  {r['title']} [{r['category']}, {r['severity']}]")
                out += [f"    {line}" for line in wrap(r["message"])]
    s = summary.first()
    out.append(f"{s['total']} finding(s): {s['must_fix']} must-fix, {s['concern']} concern, {s['nit']} nit; {s['suppressed']} suppressed")
    return "\n".join(out)


def html(findings: DataFrame, summary: DataFrame, title: str = "Review") -> str:
    """A self-contained page with the summary and one row for each finding."""
    from html import escape

    rows = "".join(f"<tr><td>{escape(r['tier'])}</td><td>{escape(r['file'])}:{r['line']}</td><td>{escape(r['title'])}</td><td>{escape(r['message'])}</td></tr>" for r in agent_shape(findings).collect())
    s = summary.first()
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><p>{s['total']} findings, {s['must_fix']} must-fix</p><table>{rows}</table>"


def directive(files: Column, symbols: Column) -> Column:
    """The line that tells a reviewer where to look."""
    return F.format_string("Look at %d changed file(s) and %d changed export(s).", files, symbols)


def summary_line(summary: DataFrame) -> DataFrame:
    """(line): a review's counts in one sentence."""
    left_out = F.when(F.col("suppressed") > 0, F.format_string("; %d left out as learned", "suppressed")).otherwise("")
    return summary.select(F.concat(F.format_string("Review of %d changed file(s): %d must-fix, %d concern, %d nit", "files_changed", "must_fix", "concern", "nit"), left_out, F.lit(".")).alias("line"))


def contract_text(contract: Contract, dropped: DataFrame, shown: int = 50) -> str:
    """What the contract says, and what it drops: never silently, but the first ``shown`` by name and the rest as a number.

    ``dropped`` are findings with the ``reason`` of ``contract.policy``.
    """
    gone = dropped.filter("reason is not null")
    n = gone.count()
    out = ["Review contract: none; the defaults hold."] if contract.source == "none" else [f"Review contract ({contract.source}):", contract.raw.strip()]
    if n:
        rows = gone.select("rule_id", "file", "reason").orderBy("file", "rule_id").limit(shown).collect()
        out.append(f"Dropped by the contract ({n}):")
        out += [f"  {r['rule_id']} in {r['file']}: {r['reason']}" for r in rows]
        if n > shown:
            out.append(f"  and {n - shown} more")
    return "\n".join(out)
