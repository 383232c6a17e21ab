"""Further queries with their SQL: readers of reports, the rules as shipped, reviews and what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import DEDUP_SQL, DOC_LINES, FOUND_SQL, LEVEL_SQL, ORACLE_SQL, PATHS_SQL, PLACED_SQL, QUERIES, TIER_SQL, commits, doc_findings, doc_matches, part_paths, patches, query, table
from .functions import paths, severity
from .operators import anchors, audit, external, findings, graph, heuristics, history, reports
from .operators.inspect import Repository
from .plans import sinks
from .plans.review import Context, Simple, review
from .runtime import spread
from .sources import external as tools
from .sources import git, unified_diff
from .sources import reports as readers

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- readers: a supplier's line items are the entries of one report -----------------------------

Q = "CAST(trunc(l_quantity) AS BIGINT)"


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))


def as_reports(rows: DataFrame, entry: F.Column, whole, sep: str = "") -> DataFrame:
    """(report, text): every supplier's entries, joined and wrapped."""
    text = F.array_join(F.array_sort(F.collect_list(entry)), sep)
    return rows.groupBy("l_suppkey").agg(text.alias("t")).select(F.col("l_suppkey").cast("string").alias("report"), whole(F.col("t"), F.col("l_suppkey").cast("string")).alias("text"))


@query(f"SELECT 's' || l_suppkey AS file, CAST(l_linenumber AS INTEGER) AS line, max({Q}) AS hits FROM lineitem GROUP BY ALL")
def cobertura_parse(spark, sf_dir):
    entry = F.concat(F.lit('<line number="'), "l_linenumber", F.lit('" hits="'), "q", F.lit('" branch="false"/>'))
    whole = lambda t, s: F.concat(F.lit('<?xml version="1.0"?>\n<coverage><packages><class name="c" filename="s'), s, F.lit('" line-rate="1"><lines>'), t, F.lit("</lines></class></packages></coverage>"))
    return readers.cobertura(as_reports(items(spark, sf_dir), entry, whole, "\n")).select("file", "line", "hits")


@query(f"""
    SELECT 's' || l_suppkey AS file, CAST(l_linenumber AS INTEGER) AS line,
           'M' || l_linenumber || CASE WHEN l_linestatus = 'F' THEN '' WHEN {Q} > 40 THEN ': replaced with ' || repeat('x', 40) || '…' ELSE ': replaced with ' || repeat('x', {Q}) END AS "desc",
           l_returnflag = 'N' AS no_coverage
    FROM lineitem WHERE l_returnflag <> 'A'
""")
def stryker_parse(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "Survived").when(F.col("l_returnflag") == "N", "NoCoverage").otherwise("Killed")
    swap = F.when(F.col("l_linestatus") != "F", F.expr("repeat('x', int(q))"))
    at = F.struct(F.struct(F.col("l_linenumber").alias("line")).alias("start"))
    entry = F.to_json(F.struct(status.alias("status"), F.concat(F.lit("M"), "l_linenumber").alias("mutatorName"), swap.alias("replacement"), at.alias("location")))
    whole = lambda t, s: F.concat(F.lit('{"files":{"s'), s, F.lit('":{"mutants":['), t, F.lit("]}}}"))
    return readers.stryker(as_reports(items(spark, sf_dir), entry, whole, ",")).select("file", "line", "desc", "no_coverage")


@query("SELECT 'src/s' || l_suppkey || '.rs' AS file, CAST(l_linenumber AS INTEGER) AS line, 'replace ' || l_partkey || ' with 0' AS \"desc\", false AS no_coverage FROM lineitem")
def cargo_missed_parse(spark, sf_dir):
    entry = F.concat(F.lit("src/s"), "l_suppkey", F.lit(".rs:"), "l_linenumber", F.when(F.col("l_linestatus") == "O", ":12: ").otherwise(": "), F.lit("replace "), "l_partkey", F.lit(" with 0"))
    whole = lambda t, s: F.concat(F.lit("not a mutant\n\n"), t, F.lit("\n"))
    return readers.cargo_mutants(as_reports(items(spark, sf_dir), entry, whole, "\n")).select("file", "line", "desc", "no_coverage")


@query("SELECT o_orderpriority || ' ' || o_orderkey AS subject, count(DISTINCT l_partkey) AS n, coalesce(min('p' || l_partkey), '') AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority")
def git_log_parse(spark, sf_dir):
    """Every customer's orders as one log of git, with blank lines between subject and files."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_set(F.concat(F.lit("p"), "l_partkey")), "\n").alias("files"))
    o = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left")
    entry = F.concat(F.lit("\u0001"), "o_orderpriority", F.lit(" "), "o_orderkey", F.lit("\n\n"), F.coalesce("files", F.lit("")), F.lit("\n"))
    raw = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), "").alias("raw"))
    return git.parse_log(raw).select("subject", F.size("files").cast("long").alias("n"), F.coalesce(F.array_min("files"), F.lit("")).alias("first"))


@query("""
    SELECT CASE WHEN l_linestatus = 'O' THEN 'rule' ELSE 'r' || l_linenumber END AS rule, 'src/s' || l_suppkey || '.py' AS file, CAST(CASE WHEN l_tax = 0 THEN 1 ELSE l_linenumber END AS INTEGER) AS line,
           CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'low' ELSE 'medium' END AS severity, 'm' || l_partkey AS message
    FROM lineitem WHERE l_discount > 0
""")
def sarif_read(spark, sf_dir):
    rule = F.when(F.col("l_linestatus") != "O", F.concat(F.lit("r"), "l_linenumber")).alias("ruleId")
    level = F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "R", "note").alias("level")
    region = F.struct(F.when(F.col("l_tax") != 0, F.col("l_linenumber")).alias("startLine")).alias("region")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("/work/src/s"), "l_suppkey", F.lit(".py")).alias("uri")).alias("artifactLocation"), region).alias("physicalLocation"))
    where = F.when(F.col("l_discount") > 0, F.array(place)).alias("locations")
    entry = F.to_json(F.struct(rule, level, F.struct(F.concat(F.lit("m"), "l_partkey").alias("text")).alias("message"), where))
    whole = lambda t, s: F.concat(F.lit('{"version":"2.1.0","runs":[{"results":['), t, F.lit("]}]}"))
    return tools.sarif(as_reports(items(spark, sf_dir), entry, whole, ","), "/work")


@query("""
    SELECT CASE WHEN l_linestatus = 'O' THEN 'rule' ELSE 'r' || l_linenumber END AS rule, 's' || l_suppkey AS file, CAST(l_linenumber + 1 AS INTEGER) AS line,
           CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN l_tax = 0 THEN '' ELSE 'm' || l_partkey END AS message
    FROM lineitem
""")
def ast_grep_read(spark, sf_dir):
    rule = F.when(F.col("l_linestatus") != "O", F.concat(F.lit("r"), "l_linenumber")).alias("ruleId")
    level = F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "R", "hint").alias("severity")
    at = F.struct(F.struct(F.col("l_linenumber").alias("line")).alias("start")).alias("range")
    entry = F.to_json(F.struct(rule, F.concat(F.lit("s"), "l_suppkey").alias("file"), at, F.when(F.col("l_tax") != 0, F.concat(F.lit("m"), "l_partkey")).alias("message"), level))
    return tools.ast_grep(as_reports(items(spark, sf_dir), entry, lambda t, s: F.concat(F.lit("["), t, F.lit("]")), ","))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'secret' ELSE 'k' || l_linenumber END AS rule, 's' || l_suppkey AS file, CAST(l_linenumber AS INTEGER) AS line, 'critical' AS severity, 'd' || l_partkey AS message FROM lineitem WHERE l_returnflag <> 'A'")
def gitleaks_read(spark, sf_dir):
    rule = F.when(F.col("l_linestatus") != "O", F.concat(F.lit("k"), "l_linenumber")).alias("RuleID")
    file = F.when(F.col("l_returnflag") != "A", F.concat(F.lit("s"), "l_suppkey")).alias("File")
    entry = F.to_json(F.struct(rule, F.concat(F.lit("d"), "l_partkey").alias("Description"), file, F.col("l_linenumber").alias("StartLine")))
    return tools.gitleaks(as_reports(items(spark, sf_dir), entry, lambda t, s: F.concat(F.lit("["), t, F.lit("]")), ","))


@query("SELECT 'V' || l_partkey AS id, CASE WHEN l_linestatus = 'O' THEN 'unknown' ELSE 'npm' END AS ecosystem, 'p' || l_suppkey AS name, '1.' || l_linenumber AS version, CASE WHEN l_tax = 0 THEN 'Known vulnerability' ELSE 's' || l_partkey END AS summary FROM lineitem")
def osv_read(spark, sf_dir):
    package = F.struct(F.concat(F.lit("p"), "l_suppkey").alias("name"), F.when(F.col("l_linestatus") != "O", "npm").alias("ecosystem"), F.concat(F.lit("1."), "l_linenumber").alias("version")).alias("package")
    found = F.array(F.struct(F.concat(F.lit("V"), "l_partkey").alias("id"), F.when(F.col("l_tax") != 0, F.concat(F.lit("s"), "l_partkey")).alias("summary"))).alias("vulnerabilities")
    entry = F.to_json(F.struct(package, found))
    return tools.osv(as_reports(items(spark, sf_dir), entry, lambda t, s: F.concat(F.lit('{"results":[{"packages":['), t, F.lit("]}]}")), ","))


# --- tools' findings, staleness, reviewable lines --------------------------------------------------


@query("SELECT DISTINCT CASE l_returnflag WHEN 'N' THEN 'gitleaks.' ELSE 'semgrep.' END || 'r' || l_linenumber AS rule_id, 'o' || l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, CASE l_returnflag WHEN 'N' THEN 0.9 ELSE 0.7 END AS confidence FROM lineitem WHERE l_returnflag = 'N' OR (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')")
def tool_findings(spark, sf_dir):
    """A scanner speaks of added lines only, a search for secrets of the whole change, and of no other mode."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.concat(F.lit("r"), "l_linenumber").alias("rule"), F.lit("medium").alias("severity"), F.lit("m").alias("message"), "l_returnflag", "l_linestatus")
    added = li.filter("l_linestatus = 'F'").select(F.col("file").alias("path"), "line")
    leaks = li.filter("l_returnflag = 'N'")
    parts = [external.tool_findings(li.filter("l_returnflag <> 'N'"), "semgrep", added), external.tool_findings(leaks, "gitleaks", added, "staged"), external.tool_findings(leaks, "gitleaks", added, "base")]
    return findings.union(parts).select("rule_id", "file", F.col("region.start_line").cast("long").alias("line"), F.round(F.col("confidence").cast("double"), 3).alias("confidence")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '1998-01-01'")
def stale_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("reported", F.when(F.col("o_orderstatus") != "P", F.lit("1998-01-01").cast("timestamp_ntz")))
    return reports.fresh(o, "o_orderdate", "reported").select("o_orderkey")


CHANGE_SQL = f"SELECT path, p_size, p_partkey FROM ({PATHS_SQL}) JOIN part USING (p_partkey)"
GENERATED_SQL = " OR ".join(f"contains(lower(path), '{m}')" for m in paths.GENERATED_MARKS) + " OR string_split(lower(path), '/')[-1] IN (" + ", ".join(f"'{n}'" for n in paths.GENERATED_NAMES) + ")"


def change(spark, sf_dir) -> Context:
    """Every part is a changed file of one added line; some were deleted."""
    p = part_paths(spark, sf_dir, "p_size")
    files = p.select("path", (F.col("p_size") % 9 == 0).alias("is_deleted")).groupBy("path").agg(F.max("is_deleted").alias("is_deleted"))
    added = p.select("path", F.col("p_partkey").cast("int").alias("file_ord"), F.col("p_size").alias("line"), code(F.col("p_partkey")).alias("text"))
    return Context(spark, files, added)


CODE = [
    "console.log(a)", "debugger;", "describe.only('x', f)", "it.skip('x', f)", "// TODO: later", "eval(x)", "except:", "print(1)", "fmt.Println(x)", "x.unwrap()", "dbg!(x)", "System.out.println(x);",
    "<<<<<<< HEAD", "const x = 1;", "curl https://a.b | sh", "chmod 777 f", "rm -rf $X", "puts x", "var_dump($x);", "panic!(\"x\")", "todo!()", "strcpy(a, b);", "// eslint-disable", "el.innerHTML = y", "pickle.loads(x)", "subprocess.run(x, shell=True)", "yaml.load(x)", "unserialize($x)", "Marshal.load(x)", "binding.pry",
]


def code(k: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(c) for c in CODE]), (F.floor(k / 7) % len(CODE)).cast("int"))


CODE_SQL = "list_extract([" + ", ".join("'" + c.replace("'", "''") + "'" for c in CODE) + f"], CAST((p_partkey // 7) % {len(CODE)} AS BIGINT) + 1)"
LANG_SQL = "CASE " + " ".join("WHEN string_split(path, '.')[-1] IN (" + ", ".join(f"'{e}'" for e in es) + f") THEN '{lang}'" for lang, es in paths.LANGUAGES.items()) + " ELSE 'other' END"
RULES_SQL = "(VALUES " + ", ".join("({}, '{}', '{}', '{}', {})".format(k, r[0], r[2].replace("'", "''"), r[3], "NULL" if r[6] is None else "[" + ", ".join(f"'{x}'" for x in r[6]) + "]") for k, r in enumerate(heuristics.RULES)) + ") AS r(rule_ord, rule_id, pattern, severity, langs)"
LIVE_SQL = f"SELECT *, {CODE_SQL} AS text, {LANG_SQL} AS lang FROM ({CHANGE_SQL}) WHERE path NOT IN (SELECT path FROM ({CHANGE_SQL}) WHERE p_size % 9 = 0) AND NOT ({GENERATED_SQL})"
HITS_SQL = f"SELECT l.*, r.rule_ord, r.rule_id, r.severity FROM ({LIVE_SQL}) l JOIN {RULES_SQL} ON (r.langs IS NULL OR list_contains(r.langs, l.lang)) AND regexp_matches(l.text, r.pattern)"


@query(f"SELECT path, CAST(p_size AS BIGINT) AS line FROM ({LIVE_SQL})")
def reviewable_lines(spark, sf_dir):
    return change(spark, sf_dir).reviewable().select("path", F.col("line").cast("long").alias("line"))


@query(f"SELECT rule_id, path AS file, severity FROM ({HITS_SQL}) GROUP BY ALL UNION ALL SELECT DISTINCT 'x.file', path, 'info' FROM ({LIVE_SQL})")
def review_union(spark, sf_dir):
    """A review by two collectors: the rules, and one finding for each file."""
    def each_file(c: Context) -> DataFrame:
        rows = spread(c.reviewable().groupBy("path").agg(F.min("line").alias("line"), F.min("file_ord").alias("file_ord")))
        return findings.make(rows, rule_id="x.file", category="hygiene", severity="info", confidence=0.5, file="path", title="t", message="m", anchor_kind="metric", anchor_detail="path", source="history", key="path")

    ctx = change(spark, sf_dir)
    got = review(ctx, [Simple("rules", lambda c: heuristics.run(c.reviewable())), Simple("files", each_file), Simple("silent", lambda c: None)]).findings
    return got.select("rule_id", "file", "severity").distinct()


@query(f"SELECT f.doc_id, f.line_no + f.doc_id % 50 AS line, f.rule_id FROM ({FOUND_SQL}) f SEMI JOIN (SELECT doc_id AS d, line FROM ({PLACED_SQL}) WHERE marker = '+') a ON a.d = f.doc_id AND a.line = f.line_no + f.doc_id % 50")
def added_line_findings(spark, sf_dir):
    rows = doc_matches(spark, sf_dir).select("doc_id", (F.col("line_no") + F.col("doc_id") % 50).alias("line"), "rule_id", F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("file"))
    return findings.on_added_lines(rows, unified_diff.added_lines(patches(spark, sf_dir))).select("doc_id", "line", "rule_id")


@query("""
    WITH m AS (SELECT 'src/s' || l_suppkey || '.ts' AS path, CAST(l_linenumber AS BIGINT) AS line, l_returnflag = 'N' AS missed, 'M' || l_partkey || '-' || l_orderkey || l_returnflag AS d FROM lineitem),
    a AS (SELECT DISTINCT 'src/s' || l_suppkey || '.ts' AS path, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_tax > 0.04),
    h AS (SELECT m.*, row_number() OVER (PARTITION BY path ORDER BY line, d) AS n, count(*) OVER (PARTITION BY path) AS total FROM m SEMI JOIN a USING (path, line))
    SELECT path AS file, line, CASE WHEN missed THEN 'tests.mutant-no-coverage' ELSE 'tests.surviving-mutant' END AS rule_id, CASE WHEN missed THEN 'low' ELSE 'medium' END AS severity, CASE WHEN n = 5 AND total > 5 THEN total - 5 ELSE 0 END AS more FROM h WHERE n <= 5
""")
def mutants_on_added(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    file, line = F.concat(F.lit("src/s"), "l_suppkey", F.lit(".ts")), F.col("l_linenumber").cast("int").alias("line")
    mutants = li.select(F.lit("r").alias("report"), F.concat(F.lit("/repo/"), file).alias("file"), line, F.concat(F.lit("M"), "l_partkey", F.lit("-"), "l_orderkey", "l_returnflag").alias("desc"), (F.col("l_returnflag") == "N").alias("no_coverage"))
    added = li.filter("l_tax > 0.04").select(file.alias("path"), F.lit(0).alias("file_ord"), line).distinct()
    f = reports.mutation_findings(added, readers.normalized(mutants, "/repo"))
    more = F.coalesce(F.expr("try_cast(nullif(regexp_extract(message, '\\\\(\\\\+([0-9]+) more', 1), '') as bigint)"), F.lit(0))
    return f.select("file", F.col("region.start_line").cast("long").alias("line"), "rule_id", "severity", more.alias("more"))


# --- symbols, history, ledger ------------------------------------------------------------------------


@query("SELECT 's' || s_suppkey AS file, CAST(s_nationkey AS BIGINT) AS line FROM supplier WHERE s_suppkey % 7 = 3")
def symbol_definitions(spark, sf_dir):
    """Where the name f3 is defined, in the order of files."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.concat(F.lit("f"), F.col("s_suppkey") % 7).alias("name"), F.col("s_nationkey").alias("start_line"))
    return Repository(s, s, s, s).definitions("f3").select("file", F.col("start_line").cast("long").alias("line"))


@query("""
    WITH s AS (SELECT user_id, event_type || '-' || event_id % 10 AS name, event_id AS line, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 2147483647) AS until FROM events WHERE event_type <> 'error'),
    h AS (SELECT user_id, event_id AS lo, event_id + 40 AS hi FROM events WHERE event_type = 'error')
    SELECT DISTINCT user_id AS file, name FROM s SEMI JOIN h ON h.user_id = s.user_id AND h.hi >= s.line AND h.lo <= s.until
""")
def changed_exports(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    symbols = ev.filter("event_type <> 'error'").select(F.col("user_id").alias("file"), F.concat("event_type", F.lit("-"), F.col("event_id") % 10).alias("name"), F.col("event_id").alias("line"))
    hunks = ev.filter("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("lo"), (F.col("event_id") + 40).alias("hi"))
    return graph.changed_exports(symbols, hunks)


@query("""
    WITH c AS (SELECT o_orderkey AS seq, o_orderpriority = '1-URGENT' AS fix, list_distinct(list(lpad(CAST(l_partkey AS VARCHAR), 9, '0'))) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    own AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS f FROM part WHERE p_size <= 25),
    t AS (SELECT f, count(*) AS total, count(*) FILTER (fix) AS n FROM (SELECT fix, unnest(files) AS f FROM c) WHERE f IN (SELECT f FROM own) GROUP BY f HAVING count(*) FILTER (fix) >= 3)
    SELECT 'history.fix-churn' AS rule_id, f AS file, CASE WHEN n >= 6 THEN 'low' ELSE 'info' END AS severity, n || '/' || total AS detail FROM t ORDER BY n >= 6 DESC, f LIMIT 8
""")
def history_findings(spark, sf_dir):
    """The report's list of often fixed files; eight rows are what it shows."""
    log = commits(spark, sf_dir).select("seq", F.when(F.col("fix"), "fix: it").otherwise("add it").alias("subject"), "files")
    changed = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), F.lit(0).alias("file_ord"), F.lit(1).alias("line"))
    f = history.run(log, changed, log.limit(0).select(F.lit("x").alias("path")))
    return f.select("rule_id", "file", "severity", F.col("anchor.detail").alias("detail"))


@query("SELECT 'c' || o_custkey AS file, 'o' || o_orderkey AS symbol FROM orders WHERE o_custkey % 5 <> 0")
def symbol_lines(spark, sf_dir):
    """Every customer's orders as a line of a changed file's exports; some lines name none."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("o"), "o_orderkey")), ", ").alias("s"))
    line = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("c"), "o_custkey", F.lit(" has "), "s")).otherwise(F.concat(F.lit("c"), "o_custkey", F.lit(": "), "s", F.lit(", ,")))
    return audit.parse_symbols(o.select(line.alias("line")))


# --- what a review writes -----------------------------------------------------------------------------


@query(f"SELECT id, rule_id, severity, {TIER_SQL} AS tier, CASE rule_id WHEN 'doc.license' THEN 'supply-chain' WHEN 'doc.junk' THEN 'hygiene' ELSE 'security' END AS category, file, line FROM ({DEDUP_SQL})")
def agent_rows(spark, sf_dir):
    a = sinks.agent_shape(findings.first_wins(doc_findings(spark, sf_dir)))
    return a.select("id", F.col("ruleId").alias("rule_id"), "severity", "tier", "category", "file", F.col("line").cast("long").alias("line"))


@query(f"""
    WITH f AS (SELECT doc_id, line, {TIER_SQL} AS tier FROM ({DEDUP_SQL})),
    x AS (SELECT DISTINCT doc_id, line FROM ({PLACED_SQL}) WHERE marker <> '-'),
    j AS (SELECT f.*, x.line IS NOT NULL AS anchored FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.line = f.line)
    SELECT CASE WHEN count(*) FILTER (tier = 'must-fix') > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event, count(*) FILTER (anchored) AS comments, count(*) FILTER (NOT anchored) AS unanchored,
           count(*) FILTER (anchored) AS marked FROM j
""")
def review_payload(spark, sf_dir):
    f = findings.first_wins(doc_findings(spark, sf_dir))
    rows = f.select("id", "tier", F.concat(F.lit("d/"), "file", F.lit(".txt")).alias("file"), F.col("region.start_line").alias("line"), F.lit(None).cast("int").alias("end_line"), F.col("title").alias("body"))
    p = anchors.payload(rows, unified_diff.anchor_index(patches(spark, sf_dir)), "summary")
    marks = F.filter("comments", lambda c: F.rlike(c["body"], F.lit("<!-- review:[0-9a-f]{16} -->")))
    return p.select("event", F.size("comments").cast("long").alias("comments"), F.size("unanchored").cast("long").alias("unanchored"), F.size(marks).cast("long").alias("marked"))


@query(f"SELECT {LEVEL_SQL} AS level, CASE {LEVEL_SQL} WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS back, count(*) AS n FROM ({DEDUP_SQL}) GROUP BY ALL")
def level_round_trip(spark, sf_dir):
    level = severity.to_level(F.col("severity"))
    return findings.first_wins(doc_findings(spark, sf_dir)).groupBy(level.alias("level")).agg(F.count("*").alias("n")).select("level", severity.from_level(F.col("level")).alias("back"), "n")


# --- patches of several files and hunks ------------------------------------------------------------------

PARTS_SQL = f"SELECT doc_id, i, s, least(3, CAST(4 * i // n AS INTEGER)) AS part, CASE WHEN i % 4 = 3 THEN '-' WHEN i % 4 = 1 THEN ' ' ELSE '+' END AS marker FROM (SELECT doc_id, line_no AS i, replace(text, '@', 'a') AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM ({DOC_LINES}))"
SPREAD_SQL = f"SELECT *, CASE WHEN part % 2 = 0 THEN doc_id % 50 + 1 ELSE 1000000 END + sum(CASE WHEN marker <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY i) - 1 AS line FROM ({PARTS_SQL})"


def spread_patches(spark, sf_dir) -> DataFrame:
    """A patch for each document, of two files with two hunks each, a quarter of its lines in each hunk."""
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("l", F.split("text", "\n", -1)).withColumn("n", F.size("l"))
    marked = F.transform("l", lambda s, i: F.struct(F.least(F.lit(3), F.floor(4 * i / F.col("n")).cast("int")).alias("part"), F.concat(F.when(i % 4 == 3, "-").when(i % 4 == 1, " ").otherwise("+"), F.translate(s, "@", "a"), F.lit("\n")).alias("s")))
    d = d.withColumn("m", marked)
    body = lambda p: F.array_join(F.transform(F.filter("m", lambda x: x["part"] == p), lambda x: x["s"]), "")
    hunk = lambda p: F.concat(F.lit("@@ -1,9 +"), (F.col("doc_id") % 50 + 1).cast("string") if p % 2 == 0 else F.lit("1000000"), F.lit(",9 @@ f()\n"), body(p))
    name = lambda f: F.concat(F.col("doc_id").cast("string"), F.lit(f"_{f}.txt"))
    file = lambda f: F.concat(F.lit("diff --git a/d/"), name(f), F.lit(" b/d/"), name(f), F.lit("\n--- a/d/"), name(f), F.lit("\n+++ b/d/"), name(f), F.lit("\n"), hunk(2 * f), hunk(2 * f + 1))
    return d.select(F.col("doc_id").alias("patch_id"), F.concat(file(0), file(1)).alias("text"))


@query(f"SELECT doc_id AS patch_id, 'd/' || doc_id || '_' || (part // 2) || '.txt' AS path, CAST(line AS BIGINT) AS new_line, CAST(part AS BIGINT) AS hunk_idx FROM ({SPREAD_SQL}) WHERE marker <> '-'")
def diff_hunks(spark, sf_dir):
    x = unified_diff.anchor_index(spread_patches(spark, sf_dir))
    return x.select("patch_id", "path", F.col("new_line").cast("long").alias("new_line"), F.col("hunk_idx").cast("long").alias("hunk_idx"))


@query(f"SELECT d.doc_id AS patch_id, 'd/' || d.doc_id || '_' || f || '.txt' AS path, count(*) FILTER (marker = '-') AS removed_count, count(*) FILTER (marker = '+') AS added_count FROM (SELECT doc_id, unnest([0, 1]) AS f FROM documents WHERE text IS NOT NULL) d LEFT JOIN ({PARTS_SQL}) p ON p.doc_id = d.doc_id AND p.part // 2 = d.f GROUP BY ALL")
def diff_file_counts(spark, sf_dir):
    f = unified_diff.changed_files(spread_patches(spark, sf_dir)).filter("path is not null")
    return f.select("patch_id", "path", "removed_count", "added_count")
