"""Queries by name, each with the SQL that it is held against.

The library's operators work on change sets, reports and feedback.  Here their roles are
bound to the supplied tables: an order is a commit, a part a file, a line item a covered line,
an event a symbol's use, and so on, so that every operator can be checked by another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing, paths, severity, text
from .operators import anchors, audit, complexity, external, findings, graph, heuristics, history, memory, reports
from .plans import sinks
from .runtime import spread
from .sources import contract, stores, unified_diff
from .sources import reports as readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-02-01T00:00:00Z"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL forms of hashes ---------------------------------------------------------------


def sql_bytes(s: str) -> str:
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(hex(encode({s})), CAST(2*i-{k} AS BIGINT), 1)) - 1)"
    return f"list_transform(range(1, CAST(octet_length(encode({s})) AS BIGINT) + 1), lambda i: {digit(1)} * 16 + {digit(0)})"


def sql_fnv(s: str, bits: int) -> str:
    basis, prime, size = {32: (2166136261, 16777619, 1 << 32), 64: (14695981039346656037, 1099511628211, 1 << 64)}[bits]
    return f"list_reduce(list_prepend(CAST({basis} AS HUGEINT), list_transform({sql_bytes(s)}, lambda b: CAST(b AS HUGEINT))), lambda h, b: (xor(h, b) * CAST({prime} AS HUGEINT)) % CAST({size} AS HUGEINT))"


def sql_hex16(h: str) -> str:
    return f"lpad(lower(to_hex(CAST({h} AS UBIGINT))), 16, '0')"


# --- documents as changed files: scans, rules, findings ----------------------------------

DOC_LINES = "SELECT doc_id, lang, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)"

# Rules for document lines: id, title, pattern, severity, category, confidence, languages.
DOC_RULES = [
    ("doc.secret-token", "Secret token", r'token = "[0-9a-f]{40}"', "critical", "security", 0.9, None),
    ("doc.email", "E-mail address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "medium", "security", 0.8, None),
    ("doc.license", "License line", r"(?i)licensed under", "low", "supplychain", 0.7, ["en", "fr"]),
    ("doc.junk", "Junk symbols", r"[*#$%&]{3}", "info", "hygiene", 0.5, ["en", "de", "es"]),
]
#: What every match of a rule holds; the address pattern looks at each letter of a word several times.
DOC_NEEDS = {"doc.email": "@"}


def _rules_sql() -> str:
    rows = ", ".join("({}, '{}', '{}', '{}', {})".format(k, r[0], r[2].replace("'", "''"), r[3], "NULL" if r[6] is None else "[" + ", ".join(f"'{x}'" for x in r[6]) + "]") for k, r in enumerate(DOC_RULES))
    return f"(VALUES {rows}) AS r(rule_ord, rule_id, pattern, severity, langs)"


FOUND_SQL = f"SELECT l.doc_id, l.line_no, l.text, r.rule_ord, r.rule_id, r.severity FROM ({DOC_LINES}) l JOIN {_rules_sql()} ON (r.langs IS NULL OR list_contains(r.langs, l.lang)) AND regexp_matches(l.text, r.pattern)"
RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
TIER_SQL = "CASE WHEN severity IN ('critical', 'high') THEN 'must-fix' WHEN severity = 'medium' THEN 'concern' ELSE 'nit' END"
NORMAL_SQL = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def doc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.matches(doc_lines(spark, sf_dir), DOC_RULES, needs=DOC_NEEDS)


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_matches(spark, sf_dir).withColumn("file", F.col("doc_id").cast("string")).withColumn("line", F.col("line_no"))
    rows = rows.withColumn("file_ord", F.col("doc_id")).withColumn("line_ord", F.col("line_no"))
    return findings.make(rows, rule_id="rule_id", category="rule_category", severity="rule_severity", confidence="rule_confidence", title="rule_title", message="rule_title", anchor_kind="heuristic", anchor_detail="pattern", source="heuristics", key=text.normalize_snippet(F.col("text")))


DEDUP_SQL = f"""
    SELECT {sql_hex16(sql_fnv("rule_id || chr(1) || doc_id || chr(1) || " + NORMAL_SQL, 64))} AS id, rule_id, severity,
           CAST(doc_id AS VARCHAR) AS file, line_no AS line, doc_id, rule_ord
    FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, doc_id, {NORMAL_SQL} ORDER BY doc_id, line_no, rule_ord) AS n FROM ({FOUND_SQL})) WHERE n = 1
"""


@query(f"SELECT doc_id, line_no, text FROM ({DOC_LINES})")
def lines_explode(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", "text")


@query(f"SELECT doc_id, line_no, rule_id, severity FROM ({FOUND_SQL})")
def rule_findings(spark, sf_dir):
    return doc_matches(spark, sf_dir).select("doc_id", "line_no", "rule_id", F.col("rule_severity").alias("severity"))


@query(f"SELECT id, rule_id, severity, {TIER_SQL} AS tier, file, line FROM ({DEDUP_SQL})")
def rule_findings_dedup(spark, sf_dir):
    f = findings.in_order(findings.first_wins(doc_findings(spark, sf_dir)))
    return f.select("id", "rule_id", "severity", "tier", "file", F.col("region.start_line").cast("long").alias("line"))


@query(f"SELECT rule_id, severity, file, line FROM ({DEDUP_SQL}) ORDER BY {RANK_SQL} DESC, file, line, rule_ord, id LIMIT 50")
def finding_order_topn(spark, sf_dir):
    f = findings.in_order(findings.first_wins(doc_findings(spark, sf_dir))).limit(50)
    return f.select("rule_id", "severity", "file", F.col("region.start_line").cast("long").alias("line"))


@query(f"SELECT count(*) AS total, count(*) FILTER (tier = 'must-fix') AS must_fix, count(*) FILTER (tier = 'concern') AS concern, count(*) FILTER (tier = 'nit') AS nit, CAST(0 AS BIGINT) AS suppressed FROM (SELECT {TIER_SQL} AS tier FROM ({DEDUP_SQL}))")
def tier_summary(spark, sf_dir):
    return findings.summary(findings.first_wins(doc_findings(spark, sf_dir)))


@query(f"SELECT rule_id, file, line FROM ({DEDUP_SQL}) WHERE {RANK_SQL} >= 2")
def gate_failures(spark, sf_dir):
    f = findings.reaches(findings.first_wins(doc_findings(spark, sf_dir)), "medium")
    return f.select("rule_id", "file", F.col("region.start_line").cast("long").alias("line"))


LEVEL_SQL = "CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


@query(f"SELECT rule_id, file, {LEVEL_SQL} AS level, greatest(line, 1) AS start_line, id FROM ({DEDUP_SQL})")
def sarif_rows(spark, sf_dir):
    r = sinks.sarif_results(findings.first_wins(doc_findings(spark, sf_dir)))
    place = F.get("locations", F.lit(0))["physicalLocation"]
    return r.select(F.col("ruleId").alias("rule_id"), place["artifactLocation"]["uri"].alias("file"), "level", place["region"]["startLine"].cast("long").alias("start_line"), F.col("partialFingerprints.primary").alias("id"))


@query(f"SELECT id, rule_id, severity, {TIER_SQL} AS tier, file, line, false AS suggested, false AS spread FROM ({DEDUP_SQL})")
def report_json(spark, sf_dir):
    """Findings written as JSON documents and read back; null fields are left out."""
    back = stores.report_rows(sinks.json_rows(findings.first_wins(doc_findings(spark, sf_dir))), "json")
    return back.select("id", "rule_id", "severity", "tier", "file", F.col("region.start_line").cast("long").alias("line"), F.col("suggestion").isNotNull().alias("suggested"), F.col("blast_radius").isNotNull().alias("spread"))


@query(f"SELECT file, count(*) AS n, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, max({RANK_SQL}) AS worst FROM ({DEDUP_SQL}) GROUP BY file")
def findings_by_file(spark, sf_dir):
    f = findings.first_wins(doc_findings(spark, sf_dir))
    return f.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.max(severity.rank(F.col("severity"))).alias("worst"))


@query("SELECT count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) > 600 OR sum(len(string_split(text, chr(10)))) > 30000 AS deep_off FROM documents")
def circuit_breaker(spark, sf_dir):
    from .plans.review import change_size, too_large

    size = change_size(doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("line_no").alias("line")))
    return size.select("files", "lines", too_large(F.col("files"), F.col("lines")).alias("deep_off"))


# --- scalar functions ---------------------------------------------------------------------


@query(f"SELECT DISTINCT event_type, user_id, {sql_hex16(sql_fnv('event_type || chr(1) || user_id', 64))} AS fp FROM events")
def fingerprint_fnv64(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    return keys.withColumn("fp", hashing.fingerprint(F.col("event_type"), F.col("user_id").cast("string")))


@query(f"SELECT p_partkey, CAST({sql_fnv('p_name', 32)} AS BIGINT) AS h, 'm_' || lpad(lower(to_hex(CAST({sql_fnv(chr(39) + 'note' + chr(39) + ' || chr(0) || p_name', 32)} AS UBIGINT))), 8, '0') AS id FROM part")
def memory_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a32(F.col("p_name")).alias("h"), hashing.memory_id(F.lit("note"), F.col("p_name")).alias("id"))


# Code units of UTF-16: characters beyond U+FFFF are two.
UNITS_SQL = "flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END))"
UNIT_HASH_SQL = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform({u}, lambda b: CAST(b AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(f"SELECT doc_id, 'm_' || lpad(lower(to_hex(CAST({UNIT_HASH_SQL.format(u='list_concat([110, 111, 116, 101, 0], ' + UNITS_SQL.format(s='t') + ')')} AS UBIGINT))), 8, '0') AS id FROM (SELECT doc_id, text || 'é—😀' || doc_id AS t FROM documents)")
def memory_ids_units(spark, sf_dir):
    """Names of memories whose texts hold characters of one, two, three and four UTF-8 bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.memory_id(F.lit("note"), F.concat("text", F.lit("é—😀"), F.col("doc_id").cast("string"))).alias("id"))


@query(f"SELECT doc_id, line_no, {NORMAL_SQL} AS snippet FROM ({DOC_LINES})")
def normalize_snippet(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", text.normalize_snippet(F.col("text")).alias("snippet"))


@query(f"""
    WITH b AS (SELECT p_partkey, unnest({sql_bytes('p_name')}) AS b FROM part),
    c AS (SELECT p_partkey, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT p_partkey, sum(n) AS total FROM c GROUP BY ALL)
    SELECT p_partkey, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (p_partkey) GROUP BY p_partkey
""")
def shannon_entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.shannon_entropy(F.col("p_name")), 6).alias("entropy"))


@query("""
    WITH s AS (SELECT doc_id, lower(text) AS t FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9_.:/-]+')) AS w FROM s),
    g AS (SELECT doc_id, 'w:' || w AS tok FROM w UNION ALL
          SELECT doc_id, 'g:' || substr(w, CAST(i AS BIGINT), 3) AS tok FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) AS i FROM w WHERE length(w) >= 3)),
    h AS (SELECT doc_id, CAST(HASH AS BIGINT) AS h FROM (SELECT doc_id, FNV AS hash FROM g))
    SELECT doc_id, CAST((h >> 1) % 256 AS INTEGER) AS idx, CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM h GROUP BY ALL
""".replace("FNV", sql_fnv("tok", 32)))
def feature_hash_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.cell_sums(docs).withColumnRenamed("id", "doc_id")


@query(r"SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path, ends_with(lower(url), '.html') AS html, CAST(length(url) AS BIGINT) AS n, CASE WHEN length(url) > 40 THEN substr(url, 1, 40) || '…' ELSE url END AS short FROM pages")
def path_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    other = F.concat(F.lit(" .\\"), F.replace(F.regexp_replace("url", "^https?://[^/]+/", ""), F.lit("/"), F.lit("\\")), F.lit(" "))
    return p.select("page_id", paths.normalize(other).alias("path"), F.endswith(F.lower("url"), F.lit(".html")).alias("html"), F.char_length("url").cast("long").alias("n"), text.truncate(F.col("url"), 40).alias("short"))


# --- synthetic paths ------------------------------------------------------------------------

EXTS = ["ts", "tsx", "py", "go", "rs", "java", "cs", "cpp", "h", "php", "rb", "kt", "swift", "scala", "sh", "md", "TS", "mjs", "jsx"]
FOLDERS = ["src", "src/api", "dist", "lib/routes", "node_modules/x", "redist/y", "web/pages", "a/__generated__", "core", "vendor"]
NAMES = ["file", "package-lock.json", "x.min", "requirements.txt", "Cargo.lock", "main", "index"]


def _pick(values: list[str], by: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({by}) % {len(values)} AS BIGINT) + 1)"


PATHS_SQL = f"SELECT p_partkey, {_pick(FOLDERS, 'p_partkey')} || '/' || CASE WHEN p_partkey % 5 = 0 THEN {_pick(NAMES, 'p_partkey // 5')} ELSE 'f' || p_partkey || '.' || {_pick(EXTS, 'p_partkey')} END AS path FROM part"


def part_paths(spark, sf_dir, *more: str) -> DataFrame:
    pick = lambda vs, by: F.get(F.array(*[F.lit(v) for v in vs]), (by % len(vs)).cast("int"))
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, pick(NAMES, F.floor(k / 5))).otherwise(F.concat(F.lit("f"), k.cast("string"), F.lit("."), pick(EXTS, k)))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(FOLDERS, k), F.lit("/"), name).alias("path"), *more)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN e IN {_in(es)} THEN '{lang}'" for lang, es in paths.LANGUAGES.items()) + f" ELSE 'other' END AS lang FROM (SELECT p_partkey, string_split(path, '.')[-1] AS e FROM ({PATHS_SQL}))")
def lang_classify(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", paths.language(F.col("path")).alias("lang"))


@query(f"SELECT p_partkey, path, {' OR '.join(f'contains(lower(path), {m!r})' for m in paths.GENERATED_MARKS)} OR string_split(lower(path), '/')[-1] IN {_in(paths.GENERATED_NAMES)} AS generated, string_split(lower(path), '/')[-1] IN {_in(paths.LOCK_FILES)} AS lock_file FROM ({PATHS_SQL})")
def generated_filter(spark, sf_dir):
    p = F.col("path")
    return part_paths(spark, sf_dir).select("p_partkey", "path", paths.is_generated(p).alias("generated"), paths.is_lockfile(p).alias("lock_file"))


@query(f"SELECT p_partkey, path, len(list_intersect(string_split(path, '/'), [{', '.join(map(repr, paths.API_FOLDERS))}])) > 0 AS api FROM ({PATHS_SQL})")
def api_boundary(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", "path", paths.is_api_path(F.col("path")).alias("api"))


GLOBS = ["src/**", "**/*.go", "src/*.ts", "lib/*/f1?.*"]
GLOB_SQL = [r"^src/.*$", r"^(.*/)?[^/]*\.go$", r"^src/[^/]*\.ts$", r"^lib/[^/]*/f1[^/]\.[^/]*$"]


@query("SELECT p_partkey, " + ", ".join(f"regexp_matches(path, '{g}') AS g{k}" for k, g in enumerate(GLOB_SQL)) + f" FROM ({PATHS_SQL})")
def glob_match(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", *[paths.glob_match(F.col("path"), g).alias(f"g{k}") for k, g in enumerate(GLOBS)])


@query(f"SELECT rule_id, file, CASE WHEN rule_id = 'doc.junk' THEN 'rule is muted: doc.junk' WHEN regexp_matches(file, '^1[^/]*$') THEN 'path is skipped: 1*' END AS reason FROM ({DEDUP_SQL})")
def policy_filter(spark, sf_dir):
    c = contract.parse("# rules\n- mute: doc.junk\nskip: 1*\n", "repo")
    return contract.policy(findings.first_wins(doc_findings(spark, sf_dir)), c).select("rule_id", "file", "reason")


@query(f"""
    WITH t AS (SELECT p_partkey, path FROM ({PATHS_SQL})),
    k AS (SELECT 'repo/' || path AS key FROM ({PATHS_SQL})
          UNION SELECT path AS key FROM ({PATHS_SQL}) WHERE p_partkey % 7 = 0)
    SELECT path, min_by(key, CASE WHEN key = path THEN '0' ELSE '1' END || key) AS key FROM t JOIN k ON key = path OR ends_with(key, '/' || path) OR ends_with(path, '/' || key) GROUP BY path
""")
def path_suffix_resolve(spark, sf_dir):
    p = part_paths(spark, sf_dir)
    keys = p.select(F.concat(F.lit("repo/"), "path").alias("key")).union(p.filter("p_partkey % 7 = 0").select("path"))
    return reports.resolve_paths(p, keys)


# --- diffs ------------------------------------------------------------------------------


def patches(spark, sf_dir) -> DataFrame:
    """A patch for each document: a file section with a hunk of added, removed and context lines."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda s, i: F.concat(F.when(i % 4 == 3, "-").when(i % 4 == 1, " ").otherwise("+"), F.translate(s, "@", "a")))
    head = F.concat(F.lit("diff --git a/d/"), "doc_id", F.lit(".txt b/d/"), "doc_id", F.lit(".txt\n--- "), F.when(F.col("doc_id") % 10 == 0, "/dev/null").otherwise(F.concat(F.lit("a/d/"), "doc_id", F.lit(".txt"))), F.lit("\n+++ b/d/"), "doc_id", F.lit(".txt\n@@ -1,9 +"), F.col("doc_id") % 50 + 1, F.lit(",9 @@\n"))
    return d.select(F.col("doc_id").alias("patch_id"), F.concat(head, F.array_join(marked, "\n"), F.lit("\n")).alias("text"))


PATCH_SQL = """
    SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN '-' WHEN i % 4 = 1 THEN ' ' ELSE '+' END AS marker, replace(s, '@', 'a') AS text
    FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""
PLACED_SQL = f"SELECT *, CAST(doc_id % 50 + 1 + sum(CASE WHEN marker <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line FROM ({PATCH_SQL})"


@query(f"SELECT doc_id AS patch_id, 'd/' || doc_id || '.txt' AS path, CAST(line AS BIGINT) AS line, text FROM ({PLACED_SQL}) WHERE marker = '+'")
def diff_parse_added(spark, sf_dir):
    return unified_diff.added_lines(patches(spark, sf_dir)).select("patch_id", "path", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT doc_id AS patch_id, 'd/' || doc_id || '.txt' AS path, count(*) FILTER (marker = '-') AS removed_count, count(*) FILTER (marker = '+') AS added_count, doc_id % 10 = 0 AS is_new, false AS is_deleted FROM ({PATCH_SQL}) GROUP BY doc_id")
def diff_files(spark, sf_dir):
    return unified_diff.changed_files(patches(spark, sf_dir)).select("patch_id", "path", "removed_count", "added_count", "is_new", "is_deleted")


@query(f"SELECT doc_id AS patch_id, 'd/' || doc_id || '.txt' AS path, CAST(line AS BIGINT) AS new_line FROM ({PLACED_SQL}) WHERE marker <> '-'")
def diff_anchor_index(spark, sf_dir):
    return unified_diff.anchor_index(patches(spark, sf_dir)).select("patch_id", "path", F.col("new_line").cast("long").alias("new_line"))


@query(f"""
    WITH x AS (SELECT doc_id, line FROM ({PLACED_SQL}) WHERE marker <> '-'),
    f AS (SELECT doc_id, CAST(doc_id % 50 + doc_id % 4 AS INTEGER) AS lo, CAST(doc_id % 50 + doc_id % 4 + doc_id % 3 AS INTEGER) AS hi FROM documents)
    SELECT f.doc_id AS patch_id, lo AS line, hi AS end_line,
           CASE WHEN b.line IS NOT NULL THEN hi WHEN a.line IS NOT NULL THEN lo END AS anchor_line,
           CASE WHEN a.line IS NOT NULL AND b.line IS NOT NULL AND lo < hi THEN lo END AS anchor_start
    FROM f LEFT JOIN x a ON a.doc_id = f.doc_id AND a.line = lo LEFT JOIN x b ON b.doc_id = f.doc_id AND b.line = hi
""")
def anchor_findings(spark, sf_dir):
    p = patches(spark, sf_dir)
    k = F.col("patch_id")
    lo = (k % 50 + k % 4).cast("int")
    f = p.select("patch_id", F.concat(F.lit("d/"), k.cast("string"), F.lit(".txt")).alias("file"), lo.alias("line"), (lo + k % 3).cast("int").alias("end_line"))
    return anchors.anchor(f, unified_diff.anchor_index(p), ["patch_id"]).select("patch_id", "line", "end_line", F.col("anchor_line").cast("int").alias("anchor_line"), F.col("anchor_start").cast("int").alias("anchor_start"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 490000) AS must_fix, CASE WHEN count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 490000) > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event FROM orders GROUP BY o_orderpriority")
def review_event(spark, sf_dir):
    n = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 490000))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(n.alias("must_fix")).withColumn("event", anchors.review_event(F.col("must_fix")))


# --- coverage and mutation: an order is a file, a line item a line ----------------------------


def order_coverage(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = F.when(F.col("l_linestatus") == "O", 0).otherwise(F.col("l_quantity").cast("long"))
    return li.select(F.lit("r").alias("report"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), hits.alias("hits"))


COVER_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line, max(CASE WHEN l_linestatus = 'O' THEN 0 ELSE CAST(trunc(l_quantity) AS BIGINT) END) AS hits FROM lineitem GROUP BY ALL"


@query(COVER_SQL)
def coverage_merge_max(spark, sf_dir):
    return readers._merged(order_coverage(spark, sf_dir)).select("file", "line", "hits")


@query(f"""
    WITH c AS ({COVER_SQL}), a AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'N')
    SELECT path, count(*) AS instrumented, count(*) FILTER (hits = 0) AS uncovered, CASE WHEN count(*) FILTER (hits = 0) >= 3 THEN 'medium' ELSE 'low' END AS severity
    FROM a JOIN c ON c.file = a.path AND c.line = a.line GROUP BY path HAVING count(*) FILTER (hits = 0) > 0
""")
def coverage_uncovered(spark, sf_dir):
    added = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"))
    rows = reports.uncovered(added, readers._merged(order_coverage(spark, sf_dir))).filter("uncovered > 0")
    return rows.select("path", "instrumented", "uncovered", F.when(F.col("uncovered") >= 3, "medium").otherwise("low").alias("severity"))


@query("""
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'N'),
    g AS (SELECT l_orderkey, line, line - row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS g FROM d),
    r AS (SELECT l_orderkey, min(line) AS lo, max(line) AS hi FROM g GROUP BY l_orderkey, g)
    SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS ranges, count(*) AS n FROM r GROUP BY l_orderkey
""")
def uncovered_ranges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("line"))
    runs = reports.islands(li, ["l_orderkey"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    return runs.select("l_orderkey", text.fmt_ranges(F.col("r")).alias("ranges"), F.size("r").cast("long").alias("n"))


@query("SELECT 'p' || p_partkey || '.go' AS file, CAST(x AS INTEGER) AS line, CAST(p_size AS BIGINT) AS hits FROM (SELECT p_partkey, p_size, unnest(range(p_size, p_size + p_size % 5 + 1)) AS x FROM part)")
def go_block_expand(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = F.concat(F.lit("p"), "p_partkey", F.lit(".go:"), "p_size", F.lit(".1,"), F.col("p_size") + F.col("p_size") % 5, F.lit(".9 3 "), "p_size")
    return readers.go_profile(p.select(F.lit("r").alias("report"), F.concat(F.lit("mode: set\n"), row).alias("text"))).select("file", "line", "hits")


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'signup' THEN event_id END AS mark FROM events),
    f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS file FROM e)
    SELECT CAST(file AS VARCHAR) AS file, CAST(event_id % 20 AS INTEGER) AS line, max(user_id) AS hits FROM f WHERE file IS NOT NULL AND event_type <> 'signup' GROUP BY ALL
""")
def lcov_forward_fill(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("SF:"), "event_id")).otherwise(F.concat(F.lit("DA:"), F.col("event_id") % 20, F.lit(","), "user_id"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("s")))), lambda x: x["s"]), "\n")
    return readers.lcov(ev.groupBy("user_id").agg(text_.alias("text")).select(F.col("user_id").cast("string").alias("report"), "text")).select("file", "line", "hits").groupBy("file", "line").agg(F.max("hits").alias("hits"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT 's' || l_suppkey AS file, CAST(l_linenumber AS INTEGER) AS line, max(CAST(trunc(l_quantity) AS BIGINT)) AS hits FROM lineitem GROUP BY ALL")
def json_report_parse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_orderkey", "l_partkey")
    li = li.withColumn("id", F.row_number().over(Window.partitionBy("s").orderBy("l_orderkey", "l_linenumber", "l_partkey", "q")).cast("string"))
    at = F.map_from_entries(F.collect_list(F.struct("id", F.struct(F.struct(F.col("l_linenumber").alias("line")).alias("start")))))
    counts = F.map_from_entries(F.collect_list(F.struct("id", "q")))
    doc = li.groupBy("s").agg(at.alias("statementMap"), counts.alias("s2")).select(F.col("s").cast("string").alias("report"), F.to_json(F.create_map(F.concat(F.lit("s"), "s"), F.struct("statementMap", F.col("s2").alias("s")))).alias("text"))
    return readers.istanbul(doc).select("file", "line", "hits")


@query("""
    WITH m AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem)
    SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN n = 5 THEN total - 5 ELSE 0 END AS more FROM m WHERE n <= 5
""")
def mutant_cap5(spark, sf_dir):
    rows = reports.capped(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"], 5)
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", F.col("more").cast("long").alias("more"))


# --- history: an order is a commit, a part a file -------------------------------------------------

COMMITS_SQL = "SELECT o_orderkey AS seq, o_orderpriority = '1-URGENT' AS fix, list_distinct(list(l_partkey)) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def commits(spark, sf_dir) -> DataFrame:
    # Dealt first: sets gathered where the table is read would hold a whole split in a task's memory.
    li = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("path")), "seq").groupBy("seq").agg(F.collect_set("path").alias("files"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderpriority") == "1-URGENT").alias("fix"))
    return o.join(li, "seq")


def changed_parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size <= 25").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"))


@query(f"SELECT f AS p_partkey, count(*) AS n_total, count(*) FILTER (fix) AS n_fix FROM (SELECT fix, unnest(files) AS f FROM ({COMMITS_SQL})) WHERE f IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY f HAVING count(*) FILTER (fix) >= 3")
def fix_churn(spark, sf_dir):
    return history.fix_churn(commits(spark, sf_dir), changed_parts(spark, sf_dir)).select(F.col("path").cast("long").alias("p_partkey"), "n_total", "n_fix")


@query(f"""
    WITH c AS (SELECT seq, unnest(files) AS f FROM ({COMMITS_SQL}) WHERE len(files) <= 8),
    own AS (SELECT p_partkey AS f FROM part WHERE p_size <= 25),
    s AS (SELECT f, count(*) AS n_stat FROM c WHERE f IN (SELECT f FROM own) GROUP BY f),
    p AS (SELECT a.f, b.f AS partner, count(*) AS together FROM c a JOIN c b ON a.seq = b.seq AND a.f <> b.f WHERE a.f IN (SELECT f FROM own) AND b.f NOT IN (SELECT f FROM own) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY together DESC, partner) AS n FROM p)
    SELECT r.f AS p_partkey, partner, together, n_stat FROM r JOIN s ON s.f = r.f WHERE n = 1 AND together >= 2 AND n_stat >= 5 AND together * 20 >= n_stat
""")
def co_change(spark, sf_dir):
    rows = history.co_change(commits(spark, sf_dir), changed_parts(spark, sf_dir), mass=8, least_commits=5, least_together=2, rate=(1, 20))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), F.col("partner").cast("long").alias("partner"), "together", "n_stat")


SUBJECTS = ["Fixes #", "prefix ", "BUG: ", "debug ", "revert: ", "reverting ", "hotfix/", "regressions ", "a Regression in "]


@query(r"SELECT o_orderkey, regexp_matches(s, '(?i)\b(fix(es|ed)?|bug|bugfix|hotfix|regression|revert(s|ed)?)\b') AS fix FROM (SELECT o_orderkey, " + _pick(SUBJECTS, "o_orderkey") + r" || o_orderkey AS s FROM orders)")
def fix_subjects(spark, sf_dir):
    k = F.col("o_orderkey")
    subject = F.concat(F.get(F.array(*[F.lit(v) for v in SUBJECTS]), (k % len(SUBJECTS)).cast("int")), k.cast("string"))
    return table(spark, sf_dir, "orders").select(k, history.is_fix(subject).alias("fix"))


# --- external tools, complexity, intervals -----------------------------------------------------------

VULN = "SELECT l_partkey AS id, l_returnflag AS ecosystem, l_suppkey AS name, l_linenumber AS version FROM lineitem WHERE l_shipdate "


@query(f"WITH h AS ({VULN} >= TIMESTAMP '1998-01-01'), b AS ({VULN} < TIMESTAMP '1998-01-01') SELECT h.* FROM h ANTI JOIN b USING (id, ecosystem, name, version)")
def new_vulns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("ecosystem"), F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("version"), "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return external.introduced(li.filter(F.col("l_shipdate") >= cut).drop("l_shipdate"), li.filter(F.col("l_shipdate") < cut).drop("l_shipdate"))


def _scores(spark, sf_dir, late: bool) -> DataFrame:
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    li = table(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= cut) if late else (F.col("l_shipdate") < cut))
    rows = li.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("score"))
    return rows.select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_linenumber").cast("string").alias("name"), F.lit(1).alias("start_line"), "score")


@query("""
    WITH h AS (SELECT l_suppkey, l_linenumber, count(*) AS score FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL),
    b AS (SELECT l_suppkey, l_linenumber, count(*) AS base FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
    j AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, CAST(l_linenumber AS VARCHAR) AS name, score, base AS base_score, score - base AS d FROM h LEFT JOIN b USING (l_suppkey, l_linenumber))
    SELECT file, name, score, base_score, CASE
        WHEN base_score IS NULL THEN CASE WHEN score >= 30 THEN 'medium' WHEN score >= 15 THEN 'low' END
        WHEN score >= 15 AND d >= 5 THEN CASE WHEN score >= 30 OR d >= 15 THEN 'medium' ELSE 'low' END
        WHEN d >= 10 THEN 'low' END AS severity FROM j
""")
def base_head_delta(spark, sf_dir):
    rows = complexity.with_base(_scores(spark, sf_dir, True), _scores(spark, sf_dir, False))
    return rows.select("file", "name", "score", "base_score", complexity.classify(F.col("score"), F.col("base_score")).alias("severity"))


@query("SELECT o_orderkey FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey AND CAST(epoch(l_shipdate) // 86400 AS BIGINT) BETWEEN CAST(epoch(o_orderdate) // 86400 AS BIGINT) AND CAST(epoch(o_orderdate) // 86400 AS BIGINT) + 30")
def interval_touch(spark, sf_dir):
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), day("o_orderdate").alias("start_line"), (day("o_orderdate") + 30).alias("end_line"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), day("l_shipdate").alias("line"))
    return graph.touched(o, li).select(F.col("file").alias("o_orderkey"))


@query("SELECT user_id AS file, event_type AS name, event_id AS line, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1, 2147483647) AS until FROM events")
def export_spans(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("name"), F.col("event_id").alias("line"))
    return graph.export_spans(ev)


# --- graphs: suppliers import parts, orders import suppliers ------------------------------------------

SRC = "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 'src/a/s' || s_suppkey || '.tsx' WHEN s_suppkey % 3 = 1 THEN 'src/b/s' || s_suppkey || '.ts' ELSE 'src/b/s' || s_suppkey || '/index.js' END AS VARCHAR)"


@query(f"""
    WITH f AS (SELECT s_suppkey, {SRC} AS path FROM supplier),
    i AS (SELECT DISTINCT l_suppkey AS a, 1 + l_partkey % (SELECT count(*) FROM supplier) AS b FROM lineitem),
    t AS (SELECT i.a, 'src/' || CASE WHEN i.b % 3 = 0 THEN 'a' ELSE 'b' END || '/s' || i.b AS target FROM i)
    SELECT DISTINCT f.path AS src, g.path AS dst FROM t JOIN f ON f.s_suppkey = t.a JOIN f g ON g.path IN (target || '.ts', target || '.tsx', target || '/index.js')
""")
def import_resolve(spark, sf_dir):
    """A compiled twin stands beside every .ts file, and some specifiers climb above the root."""
    n = table(spark, sf_dir, "supplier").count()
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SRC.replace("VARCHAR", "STRING")).alias("file"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % n + 1).alias("b")).distinct()
    up = F.when(F.col("b") % 5 == 0, "../../../../../src/").when(F.col("s_suppkey") % 3 == 2, "../../").otherwise("../")
    spec = F.concat(up, F.when(F.col("b") % 3 == 0, "a").otherwise("b"), F.lit("/./s"), F.col("b").cast("string"), F.when(F.col("b") % 3 == 2, "").otherwise(".js"))
    imports = i.join(s, "s_suppkey").select("file", F.array(F.lit("x")).alias("names"), spec.alias("source"))
    twins = s.filter("s_suppkey % 3 = 1").select(F.regexp_replace("file", "ts$", "js").alias("path"))
    return graph.import_edges(imports, s.select(F.col("file").alias("path")).union(twins)).select("src", "dst")  # every name is x


EDGES_SQL = "SELECT 'o' || o_orderkey AS src, 'f' || (l_suppkey % 7) AS name, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION SELECT 'c' || o_custkey, 'g', 'o' || o_orderkey FROM orders"


def edges(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    a = li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("f"), F.col("l_suppkey") % 7).alias("name"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    b = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("g").alias("name"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return a.union(b)  # who needs them once makes them so, after what it drops


def supplier_symbols(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.concat(F.lit("f"), F.col("s_suppkey") % 7).alias("name"))


DIRECT_SQL = f"SELECT DISTINCT dst AS file, name, src AS caller FROM ({EDGES_SQL}) WHERE dst LIKE 's%' AND src <> dst"


@query(DIRECT_SQL)
def direct_callers(spark, sf_dir):
    return graph.direct_callers(supplier_symbols(spark, sf_dir), edges(spark, sf_dir))


@query(f"""
    WITH d AS ({DIRECT_SQL}), e AS (SELECT DISTINCT src, dst FROM ({EDGES_SQL})),
    f AS (SELECT DISTINCT d.file, d.name, e.src AS second FROM d JOIN e ON e.dst = d.caller WHERE e.src <> d.file)
    SELECT file, name, count(*) AS transitive FROM f ANTI JOIN (SELECT file, name, caller AS second FROM d) x USING (file, name, second) GROUP BY file, name
""")
def transitive_callers(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.transitive_callers(graph.direct_callers(supplier_symbols(spark, sf_dir), e), e)


def event_occurrences(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    first = ev.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    symbol = F.concat(F.lit("pkg "), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("()."))
    return ev.join(first, ["user_id", "event_type"]).select(F.concat(F.lit("u"), F.col("event_id") % 40).alias("file"), F.col("event_id").cast("int").alias("line"), symbol.alias("symbol"), (F.col("event_id") == F.col("f")).alias("is_def"))


OCC_SQL = "SELECT 'u' || (event_id % 40) AS file, CAST(event_id AS INTEGER) AS line, 'pkg ' || user_id || '/' || event_type || '().' AS symbol, event_type, event_id = min(event_id) OVER (PARTITION BY user_id, event_type) AS is_def FROM events"


@query(f"""
    WITH o AS ({OCC_SQL}), d AS (SELECT * FROM o WHERE is_def)
    SELECT d.file, d.event_type AS name, count(o.file) AS total_refs, count(DISTINCT CASE WHEN o.file <> d.file THEN d.symbol || o.file END) AS n, count(DISTINCT CASE WHEN o.file <> d.file THEN o.file END) AS direct
    FROM d LEFT JOIN o ON o.symbol = d.symbol AND NOT o.is_def GROUP BY d.file, d.event_type
""".replace("count(DISTINCT CASE WHEN o.file <> d.file THEN d.symbol || o.file END) AS n, ", ""))
def scip_refs(spark, sf_dir):
    occ = event_occurrences(spark, sf_dir)
    defs = occ.filter("is_def").select("file", F.regexp_extract("symbol", "/([a-z_]+)", 1).alias("name"), F.col("line").alias("start_line"))
    return graph.precise_reach(defs, occ).select("file", "name", "total_refs", "direct")


@query(f"""
    WITH o AS ({OCC_SQL}), q AS (SELECT file, event_type AS name, line + CAST(line % 3 - 1 AS INTEGER) AS start_line FROM o WHERE is_def)
    SELECT q.file, q.name, q.start_line, min_by(o.symbol, CASE o.line - q.start_line WHEN 0 THEN '0' WHEN -1 THEN '1' ELSE '2' END || o.symbol) AS symbol
    FROM q JOIN o ON o.is_def AND o.file = q.file AND o.line BETWEEN q.start_line - 1 AND q.start_line + 1 AND o.event_type = q.name GROUP BY ALL
""")
def scip_tolerant_lookup(spark, sf_dir):
    occ = event_occurrences(spark, sf_dir)
    q = occ.filter("is_def").select("file", F.regexp_extract("symbol", "/([a-z_]+)", 1).alias("name"), (F.col("line") + F.col("line") % 3 - 1).cast("int").alias("start_line"))
    return graph.occurrence_of(q, occ)


@query(f"""
    WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS file, 'f' || (s_suppkey % 7) AS name, s_nationkey < 12 AS known FROM supplier),
    p AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS direct FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey),
    h AS (SELECT file, name, count(*) AS direct FROM ({DIRECT_SQL}) GROUP BY ALL),
    t AS ({ORACLE_SQL["transitive_callers"]})
    SELECT s.file, s.name, CASE WHEN known THEN coalesce(p.direct, 0) ELSE h.direct END AS direct, CASE WHEN known THEN 0 ELSE coalesce(t.transitive, 0) END AS transitive,
           false AS crosses, CASE WHEN known THEN 0.97 ELSE 0.6 END AS confidence, CASE WHEN known THEN 'scip' ELSE 'import graph (ts/js)' END AS method
    FROM s LEFT JOIN p ON p.k = s.k LEFT JOIN h ON h.file = s.file AND h.name = s.name LEFT JOIN t ON t.file = s.file AND t.name = s.name WHERE known OR h.direct IS NOT NULL
""")
def tiered_resolution(spark, sf_dir):
    """An index knows the suppliers of some nations; the import graph answers for the others."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    symbols = s.select(F.concat(F.lit("s"), k).alias("file"), F.concat(F.lit("f"), k % 7).alias("name"), k.cast("int").alias("start_line"))
    known = s.filter("s_nationkey < 12").select(k, F.concat(F.lit("pkg s"), k, F.lit("/f"), k % 7, F.lit("().")).alias("symbol"))
    defs = known.select(F.concat(F.lit("s"), k).alias("file"), k.cast("int").alias("line"), "symbol", F.lit(True).alias("is_def"))
    uses = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(known, F.col("l_suppkey") == k)
    refs = uses.select(F.concat(F.lit("p"), "l_partkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), "symbol", F.lit(False).alias("is_def"))
    return graph.tiered_reach(symbols, edges(spark, sf_dir), defs.unionByName(refs)).drop("callers")


# --- learned feedback -------------------------------------------------------------------------------

AGE_SQL = f"(epoch_us(TIMESTAMP '{NOW[:19].replace('T', ' ')}') - epoch_us(ts)) / 86400000000.0"


def iso(c: str) -> F.Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def event_learnings(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    rule = F.col("event_type") == "error"
    return ev.select(F.col("user_id").cast("string").alias("fingerprint"), F.col("event_type").alias("rule_id"), F.col("props").alias("text"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("dismissed").alias("signal"), F.when(rule & (F.col("value") > 90), "rule").otherwise("finding").alias("scope"), iso("ts").alias("at"))


def turned(s: F.Column) -> F.Column:
    """A small embedding that SQL can compute as well: a direction on the circle."""
    k = F.from_json(s, "k double")["k"] * (6.283185307179586 / 100)
    return F.array(F.cos(k), F.sin(k))


RULE_SQL = "CASE WHEN event_type = 'click' THEN 'security.click' ELSE event_type END"


def all_learnings(spark, sf_dir) -> DataFrame:
    """Every event is feedback; clicks are of a rule that no similarity suppresses.

    Texts lie on parts of the circle: fresh ones on a quarter, older ones on a third, accepted ones on half of it.
    """
    ev, k = table(spark, sf_dir, "events"), F.from_json("props", "k int")["k"]
    part = F.when(F.col("event_type") == "purchase", 2).when(text.age_days(iso("ts"), F.lit(NOW)) > 15, 3).otherwise(4)
    said = F.concat(F.lit('{"k": '), F.floor(k / part).cast("string"), F.lit("}"))
    return ev.select(fingerprinted(0), F.expr(RULE_SQL).alias("rule_id"), said.alias("text"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("dismissed").alias("signal"), F.when((F.col("event_type") == "error") & (F.col("value") > 340), "rule").otherwise("finding").alias("scope"), iso("ts").alias("at"))


def fingerprinted(step: int) -> F.Column:
    return F.concat_ws("/", F.col("user_id").cast("string"), ((F.col("event_id") + step) % 50).cast("string")).alias("fingerprint")


def event_candidates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(fingerprinted(7), F.expr(RULE_SQL).alias("rule_id"), F.col("props").alias("text")).distinct()


DECIDE_SQL = f"""
    WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {AGE_SQL} AS age FROM events),
    l AS (SELECT user_id || '/' || event_id % 50 AS fp, {RULE_SQL} AS rule, CASE WHEN event_type = 'purchase' THEN k // 2 WHEN age > 15 THEN k // 3 ELSE k // 4 END AS y, event_type = 'purchase' AS good, event_type = 'error' AND value > 340 AS mute, ts, age FROM e),
    ex AS (SELECT fp, max(ts) AS at, min(age) AS age FROM l WHERE NOT good AND NOT mute GROUP BY fp),
    en AS (SELECT rule AS er, y, bool_or(age <= 15) AS fresh, bool_or(age > 15) AS old FROM l WHERE NOT good GROUP BY ALL),
    c AS (SELECT DISTINCT user_id || '/' || (event_id + 7) % 50 AS fingerprint, {RULE_SQL} AS rule_id, k AS x FROM e),
    w AS (SELECT DISTINCT x AS v, x * (6.283185307179586 / 100) AS k FROM (SELECT x FROM c UNION SELECT y FROM l)),
    p AS (SELECT a.v AS x, b.v AS y, cos(a.k) * cos(b.k) + sin(a.k) * sin(b.k) AS sim FROM w a, w b),
    b AS (SELECT x, rule_id, max(sim) FILTER (fresh) AS best, max(sim) FILTER (fresh AND er = rule_id) AS best_same, max(sim) FILTER (old) AS stale_best, max(sim) FILTER (old AND er = rule_id) AS stale_same
          FROM p JOIN en USING (y) JOIN (SELECT DISTINCT rule_id, x FROM c WHERE NOT regexp_matches(rule_id, '{memory.EXEMPT}')) USING (x) WHERE sim >= 0.82 GROUP BY ALL),
    g AS (SELECT x, max(sim) AS reinforcement FROM p JOIN (SELECT DISTINCT y FROM l WHERE good) USING (y) WHERE sim >= 0.8 GROUP BY x),
    f AS (SELECT c.*, ex.at IS NOT NULL AND ex.age <= 20 AS exact_fresh, ex.at IS NOT NULL AND ex.age > 20 AS exact_stale, c.rule_id IN (SELECT rule FROM l WHERE mute) AS muted,
                 coalesce(best_same, 0) >= 0.82 OR coalesce(best, 0) >= 0.93 AS alike, coalesce(stale_same, 0) >= 0.82 OR coalesce(stale_best, 0) >= 0.93 AS stale_alike, best, reinforcement
          FROM c LEFT JOIN ex ON ex.fp = c.fingerprint LEFT JOIN b ON b.x = c.x AND b.rule_id = c.rule_id LEFT JOIN g ON g.x = c.x),
    d AS (SELECT *, exact_fresh OR muted OR alike AS suppress FROM f)
    SELECT fingerprint, rule_id, suppress, CASE WHEN exact_fresh THEN 'exact' WHEN muted THEN 'rule' WHEN alike THEN 'semantic' WHEN exact_stale THEN 'exact' WHEN stale_alike THEN 'semantic' END AS kind,
           round(CASE WHEN NOT exact_fresh AND NOT muted AND alike THEN best END, 6) AS similarity, NOT suppress AND (exact_stale OR stale_alike) AS revalidate,
           NOT suppress AND NOT exact_stale AND NOT stale_alike AND reinforcement IS NOT NULL AS reinforce,
           round(CASE WHEN NOT suppress AND NOT exact_stale AND NOT stale_alike THEN reinforcement END, 6) AS reinforcement
    FROM d
"""


@query(DECIDE_SQL)
def decision_cascade(spark, sf_dir):
    d = memory.decide(event_candidates(spark, sf_dir), all_learnings(spark, sf_dir), NOW, embed=turned, exact_days=20, semantic_days=15)
    return d.drop("stale_since").withColumn("similarity", F.round("similarity", 6)).withColumn("reinforcement", F.round("reinforcement", 6))


@query(f"""
    WITH x AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT CAST(u.user_id AS VARCHAR) AS fingerprint, coalesce({AGE_SQL} <= 3, false) AS suppress, CASE WHEN ts IS NOT NULL THEN 'exact' END AS kind, coalesce({AGE_SQL} > 3, false) AS revalidate,
           CASE WHEN {AGE_SQL} > 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS stale_since
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN x ON x.user_id = u.user_id
""")
def suppress_exact_decay(spark, sf_dir):
    """Dismissals of a security rule: only the same finding is suppressed, and only while they are fresh."""
    e = event_learnings(spark, sf_dir).filter("rule_id = 'error'").withColumn("rule_id", F.lit("security.error")).withColumn("scope", F.lit("finding"))
    c = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fingerprint"), F.lit("security.error").alias("rule_id"), F.lit("x").alias("text"))
    return memory.decide(c, e, NOW, embed=turned, exact_days=3).select("fingerprint", "suppress", "kind", "revalidate", "stale_since")


@query("SELECT DISTINCT CAST(event_id AS VARCHAR) AS fingerprint, event_type AS rule_id, event_type = 'error' AS suppress, CASE WHEN event_type = 'error' THEN 'rule' END AS kind FROM events")
def suppress_rule_mute(spark, sf_dir):
    """Mutes of a rule never age, and say nothing about other rules."""
    ev = table(spark, sf_dir, "events")
    c = ev.select(F.col("event_id").cast("string").alias("fingerprint"), F.col("event_type").alias("rule_id"), F.lit('{"k": 0}').alias("text"))
    mute = ev.filter("event_type = 'error'").select(F.lit("").alias("fingerprint"), F.col("event_type").alias("rule_id"), F.lit('{"k": 50}').alias("text"), F.lit("dismissed").alias("signal"), F.lit("rule").alias("scope"), iso("ts").alias("at"))
    return memory.decide(c, mute, NOW, embed=turned, exact_days=0).select("fingerprint", "rule_id", "suppress", "kind")


@query(f"SELECT event_id, mute OR age <= 20 AS exact_live, mute OR age <= 10 AS semantic_live FROM (SELECT event_id, event_type = 'error' AND value > 90 AS mute, {AGE_SQL} AS age FROM events)")
def learnings_live(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.when((F.col("event_type") == "error") & (F.col("value") > 90), "rule").otherwise("finding").alias("scope"), iso("ts").alias("at"))
    return memory.live(ev, NOW, exact_days=20, semantic_days=10).select("event_id", "exact_live", "semantic_live")


@query(f"SELECT event_type, NOT regexp_matches(r, '{memory.EXEMPT}') AS eligible FROM (SELECT DISTINCT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'security.' WHEN event_type = 'error' THEN 'secret.' ELSE 'insecurity.' END || event_type AS r FROM events)")
def rule_eligible(spark, sf_dir):
    kind = F.col("event_type")
    rule = F.concat(F.when(kind.isin("click", "view"), "security.").when(kind == "error", "secret.").otherwise("insecurity."), kind)
    return table(spark, sf_dir, "events").select(kind).distinct().select("event_type", memory.eligible(rule).alias("eligible"))


DOT_SQL = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(f"SELECT a.vec_id AS l, b.vec_id AS r, round({DOT_SQL}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {DOT_SQL} >= 0.3")
def similarity_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return memory.similarity_pairs(v, v, 0.3).filter("l < r").withColumn("sim", F.round("sim", 6))


@query(f"SELECT a.vec_id AS id, round(max({DOT_SQL}), 6) AS best, round(max(CASE WHEN a.label = b.label THEN {DOT_SQL} END), 6) AS best_same FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {DOT_SQL} >= 0.25 GROUP BY a.vec_id")
def similarity_best(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.struct("id", "label").alias("id"), "vec")  # pairs bring their labels: none is moved before the maxima are taken
    p = memory.similarity_pairs(v, v, 0.25).filter("l.id <> r.id")
    return p.groupBy(F.col("l.id").alias("id")).agg(F.round(F.max("sim"), 6).alias("best"), F.round(F.max(F.when(F.col("l.label") == F.col("r.label"), F.col("sim"))), 6).alias("best_same"))


@query(f"SELECT b.vec_id AS id, floor({DOT_SQL} * 1000 + 0.5) / 1000 AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0 AND {DOT_SQL} >= 0.2 ORDER BY {DOT_SQL} DESC, id LIMIT 5")
def recall_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    m = v.filter("vec_id <> 0").select(F.col("vec_id").alias("id"), F.lit("note").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("file"), "embedding").join(F.broadcast(q), how="inner")
    return memory.recall(m, F.col("q"), embed=None).select("id", "score")


@query(f"SELECT a.vec_id AS id FROM embeddings a SEMI JOIN embeddings b ON a.label = 1 AND b.label = 0 AND {DOT_SQL} >= 0.3")
def reinforce(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return memory.similarity_pairs(v.filter("label = 1"), v.filter("label = 0"), 0.3).select(F.col("l").alias("id")).distinct()


@query("""
    WITH k AS (SELECT *, CASE WHEN event_type = 'error' AND value > 90 THEN 'rule:' || event_type ELSE 'fp:' || user_id END AS key FROM events)
    SELECT key, CAST(1 AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS last FROM k GROUP BY key
""")
def learning_upsert(spark, sf_dir):
    ev = event_learnings(spark, sf_dir)
    store = memory.upsert(ev.limit(0), ev.filter("at < '2024-01-15'"))
    store = memory.upsert(store, ev.filter("at >= '2024-01-15'"))
    return store.groupBy(memory.learning_key().alias("key")).agg(F.count("*").alias("n"), F.max("at").alias("last"))


@query(f"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, lang AS kind FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1),
    c AS MATERIALIZED (SELECT d.id, d.kind, h.idx, CAST(h.v AS DOUBLE) AS v FROM d JOIN ({ORACLE_SQL["feature_hash_cells"]}) h ON h.doc_id = d.id),
    n AS (SELECT id, sum(v * v) AS n FROM c GROUP BY id),
    s AS (SELECT a.id AS l, b.id AS r, sum(a.v * b.v) AS s FROM c a JOIN c b ON a.kind = b.kind AND a.idx = b.idx AND a.id < b.id GROUP BY ALL),
    p AS (SELECT l, r FROM s JOIN n x ON x.id = l JOIN n y ON y.id = r WHERE x.n > 0 AND y.n > 0 AND s / sqrt(x.n * y.n) >= {memory.DUPLICATE}),
    o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS no, coalesce(near, CAST([] AS BIGINT[])) AS near FROM d LEFT JOIN (SELECT r, list(CAST(l AS BIGINT)) AS near FROM p GROUP BY r) ON r = id),
    k AS (SELECT CAST(0 AS BIGINT) AS no, CAST([] AS BIGINT[]) AS kept UNION ALL
          SELECT o.no, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, CAST(id AS BIGINT)) END FROM k JOIN o ON o.no = k.no + 1)
    SELECT unnest(kept) AS id FROM k WHERE no = (SELECT max(no) FROM k)
""")
def memory_near_dup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.select(F.col("lang").alias("kind"), "text", F.lit(None).cast("string").alias("scope"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("seq"))
    return memory.remember(spark.createDataFrame([], memory.MEMORY_DDL), new, NOW).select(F.col("file").cast("long").alias("id"))


# --- audit: a customer is a repository, an order a floor finding ---------------------------------------

FATE_SQL = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"


def ledger(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey"))
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    row = lambda df, seq, event, key, value: df.select("repo", F.lit(seq).cast("long").alias("seq"), F.lit(event).alias("event"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    key = F.col("o_orderkey")
    floor = row(o, 1, "floor", key, F.lit(None))
    done = o.join(r, "o_orderkey", "left_semi")
    fate = row(done.filter("o_orderkey % 2 = 0"), 2, "dismissed", key, F.lit(None)).union(row(done.filter("o_orderkey % 2 = 1"), 2, "accepted", key, F.lit(None)))
    symbols = row(o.filter("o_orderkey % 5 = 0"), 3, "symbol", F.col("o_orderkey"), F.lit("f"))
    looks = row(o.filter("o_orderkey % 10 = 0"), 4, "inspect", F.col("o_orderkey"), F.lit("callers"))
    return floor.union(fate).union(symbols).union(looks)


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS repo, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN ({FATE_SQL})")
def audit_unaccounted(spark, sf_dir):
    return audit.unaccounted(ledger(spark, sf_dir))


@query(f"""
    WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS repo, o_orderkey AS k, o_orderkey IN ({FATE_SQL}) AS done FROM orders)
    SELECT repo, count(*) AS floor, count(*) FILTER (k % 5 = 0) AS symbols, count(*) FILTER (k % 10 = 0) AS inspect_calls,
           count(*) FILTER (done AND k % 2 = 0) AS dismissed, count(*) FILTER (done AND k % 2 = 1) AS accepted,
           count(*) FILTER (NOT done) AS unaccounted, count(*) FILTER (k % 5 = 0 AND k % 10 <> 0) AS untraced,
           count(*) FILTER (k % 10 = 0) AS traced, count(*) FILTER (NOT done) = 0 AND count(*) FILTER (k % 5 = 0 AND k % 10 <> 0) = 0 AS clean
    FROM o GROUP BY repo
""")
def audit_ratio(spark, sf_dir):
    return audit.ratios(ledger(spark, sf_dir))


@query(f"""
    WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS repo, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey IN ({FATE_SQL}) AS done FROM orders),
    b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS no FROM o WHERE k % 5 = 0 AND k % 10 <> 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS no FROM o WHERE NOT done),
    bl AS (SELECT repo, string_agg('  never inspected: ' || id || ' (f)' || chr(10), '' ORDER BY no) AS t FROM b WHERE no <= 3 GROUP BY repo),
    ul AS (SELECT repo, string_agg('  unaccounted: ' || id || chr(10), '' ORDER BY no) AS t FROM u WHERE no <= 3 GROUP BY repo),
    c AS (SELECT repo, count(*) AS floor, count(*) FILTER (k % 5 = 0) AS symbols, count(*) FILTER (k % 10 = 0) AS looks, count(*) FILTER (done AND k % 2 = 0) AS gone,
          count(*) FILTER (done AND k % 2 = 1) AS taken, count(*) FILTER (NOT done) AS open, count(*) FILTER (k % 5 = 0 AND k % 10 <> 0) AS blind FROM o GROUP BY repo)
    SELECT c.repo, 'Audit: ' || looks || '/' || symbols || ' changed exports traced, ' || looks || ' inspect call(s).' || chr(10) || coalesce(bl.t, '')
           || CASE WHEN blind > 3 THEN '  and ' || (blind - 3) || ' more' || chr(10) ELSE '' END
           || 'Floor: ' || floor || ' finding(s), kept not declared, ' || gone || ' dismissed, ' || taken || ' accepted, ' || open || ' unaccounted.' || chr(10) || coalesce(ul.t, '')
           || CASE WHEN open > 3 THEN '  and ' || (open - 3) || ' more' || chr(10) ELSE '' END
           || CASE WHEN blind = 0 AND open = 0 THEN 'AUDIT CLEAN' ELSE 'AUDIT INCOMPLETE' END AS text
    FROM c LEFT JOIN bl USING (repo) LEFT JOIN ul USING (repo)
""")
def audit_blocks(spark, sf_dir):
    """The audit of every repository as text; what came before a review's start says nothing."""
    rows = ledger(spark, sf_dir)
    start = rows.select("repo").distinct().select("repo", F.lit(0).cast("long").alias("seq"), F.lit("start").alias("event"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    earlier = rows.filter("event = 'floor'").withColumn("seq", F.lit(-1).cast("long")).withColumn("key", F.concat(F.lit("old"), "key"))
    return audit.blocks(rows.union(start).union(earlier), shown=3)
