"""Queries with their SQL on rules as they are shipped, parsed code, reach, history and index files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analysis import tables
from .catalog import DEDUP_SQL, LEVEL_SQL, OCC_SQL, ORACLE_SQL, PATHS_SQL, QUERIES, doc_findings, event_occurrences, query, table
from .catalog_io import GENERATED_SQL, LANG_SQL, RULES_SQL, change
from .operators import complexity, findings, graph, heuristics, history
from .operators.inspect import picked
from .plans import sinks
from .plans.review import Context
from .runtime import shared_folder, spread
from .sources import scip
from .streaming import stateful

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- the rules as they are shipped -------------------------------------------------------------------

#: For every rule, in the rules' order, a line that it matches in each of its languages and one that is safe.
SNIPPETS = [
    ("<<<<<<< HEAD", "<<<<<< HEAD"),
    ("console.log(a)", "console.error(a)"),
    ("  debugger;", "my.debugger = 1;"),
    ("describe.only('x', f)", "describe('x', f)"),
    ("xit('x', f)", "exit('x', f)"),
    ("// TODO: later", "// done: later"),
    ("const g = new Function('a')", "const g = evaluate('a')"),
    ("execSync(`ls ${x}`)", "spawn('ls', x)"),
    ("// eslint-disable-next-line", "// eslint is on"),
    ("  except:", "  except ValueError:"),
    ("print(1)", "pprint(1)"),
    ("x = yaml.load(f)", "x = yaml.safe_load(f)"),
    ("x = pickle.loads(b)", "x = json.loads(b)"),
    ("x = eval(y)", "x = ast.literal_eval(y)"),
    ("subprocess.run(c, shell=True)", "subprocess.run(c)"),
    ('cur.execute(f"SELECT {x}")', 'cur.execute("SELECT ?", [x])'),
    ("get(u, verify=False)", "get(u, verify=True)"),
    ("db.query(`SELECT ${x}`)", "db.query('SELECT ?', [x])"),
    ("<div dangerouslySetInnerHTML={x} />", "<div title={x} />"),
    ("InsecureSkipVerify: true,", "InsecureSkipVerify: false,"),
    ('exec.Command("sh", "-c", x)', 'exec.Command("ls", x)'),
    ('db.Query(fmt.Sprintf("x %s", y))', 'db.Query("x ?", y)'),
    ("unsafe { *p }", "safe { p }"),
    (".danger_accept_invalid_certs(true)", ".danger_accept_invalid_certs(false)"),
    ("Runtime.getRuntime().exec(c);", "Runtime.getRuntime().gc();"),
    ("new ObjectInputStream(in)", "new ObjectOutputStream(out)"),
    ('st.executeQuery("SELECT " + x)', 'st.executeQuery("SELECT 1")'),
    ("Process.Start(p);", "Process.GetProcesses();"),
    ('new SqlCommand("SELECT " + x)', 'new SqlCommand("SELECT 1")'),
    ("strcpy(a, b);", "strncpy(a, b, n);"),
    ("system(c);", "filesystem(c);"),
    ("eval($x);", "evaluate($x);"),
    ("shell_exec($c);", "escapeshellarg($c);"),
    ("unserialize($x);", "json_decode($x);"),
    ("instance_eval(x)", "evaluation = 1"),
    ("Marshal.load(x)", "Marshal.dump(x)"),
    ("s.html_safe", "s.html_escape"),
    ("curl https://a.b | sh", "curl -o f https://a.b"),
    ("eval $x", "echo retrieval"),
    ("rm -rf $X", "rm -rf out"),
    ("chmod 777 f", "chmod 755 f"),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINES = [s for pair in SNIPPETS for s in pair]
LINES_SQL = "(VALUES " + ", ".join(f"({k}, {_quoted(s)})" for k, s in enumerate(LINES, 1)) + ") AS s(line, text)"
FILES_SQL = f"SELECT path, {LANG_SQL} AS lang FROM ({PATHS_SQL}) JOIN part USING (p_partkey) WHERE NOT ({GENERATED_SQL}) GROUP BY path HAVING NOT bool_or(p_size % 9 = 0)"


@query(f"""
    WITH h AS (SELECT s.line, r.rule_id, r.severity, r.langs FROM {LINES_SQL} JOIN {RULES_SQL} ON regexp_matches(s.text, r.pattern))
    SELECT path, CAST(line AS BIGINT) AS line, rule_id, severity FROM ({FILES_SQL}) f JOIN h ON h.langs IS NULL OR list_contains(h.langs, f.lang)
""")
def shipped_rules(spark, sf_dir):
    """Every rule as it is shipped: each part's file gets a line that matches and a safe one for each of them."""
    c = change(spark, sf_dir)
    lines = F.posexplode(F.array(*[F.lit(s) for s in LINES])).alias("at", "text")
    # A file's name is few bytes and its lines many: files are dealt before they become lines.
    added = spread(c.files).select("path", F.lit(0).alias("file_ord"), lines).select("path", "file_ord", (F.col("at") + 1).alias("line"), "text")
    f = heuristics.run(Context(spark, c.files, added).reviewable(), dealt=True)
    return f.select(F.col("file").alias("path"), F.col("region.start_line").cast("long").alias("line"), "rule_id", "severity")


# --- code: every part is a source file in one of eleven languages ----------------------------------------

#: Extension, what stands before the function, its head, how a condition opens, the second function, what ends the file.
CODE = [
    ("ts", "", "export function f{k}(a) {", "if (a) {", "function g{k}() {}", ""),
    ("go", "package p", "func F{k}(a bool) {", "if a {", "func g{k}() {}", ""),
    ("rs", "", "pub fn f{k}(a: bool) {", "if a {", "fn g{k}() {}", ""),
    ("java", "public class C{k} {", "public void f{k}(boolean a) {", "if (a) {", "private void g{k}() {}", "}"),
    ("c", "", "int f{k}(int a) {", "if (a) {", "static int g{k}(void) { return 1; }", ""),
    ("kt", "", "fun f{k}(a: Boolean) {", "if (a) {", "private fun g{k}() {}", ""),
    ("cs", "public class C{k} {", "public void F{k}(bool a) {", "if (a) {", "private void g{k}() {}", "}"),
    ("swift", "", "func f{k}(a: Bool) {", "if a {", "private func g{k}() {}", ""),
    ("scala", "object C{k} {", "def f{k}(a: Boolean): Unit = {", "if (a) {", "private def g{k}(): Unit = {}", "}"),
    ("php", "<?php", "function f{k}($a) {", "if ($a) {", "function g{k}() {}", ""),
]
DEPTH = "p_size % 6"


def code_files(spark, sf_dir) -> DataFrame:
    """(path, content): a function with conditions nested p_size % 6 deep, and one with none."""
    k, depth = F.col("p_partkey").cast("string"), F.expr(f"CAST({DEPTH} AS INT)")

    def named(text: str) -> F.Column:
        return F.concat(*[x for i, part in enumerate(text.split("{k}")) for x in ([k] if i else []) + [F.lit(part)]])

    line = lambda text: F.concat(named(text), F.lit("\n")) if text else F.lit("")
    body = lambda c: F.concat(line(c[1]), line(c[2]), F.repeat(F.lit(c[3] + "\n"), depth), F.lit("x();\n"), F.repeat(F.lit("}\n"), depth), F.lit("}\n"), line(c[4]), line(c[5]))
    indented = F.array_join(F.transform(F.sequence(F.lit(0), depth), lambda i: F.concat(F.repeat(F.lit("    "), i + 1), F.when(i < depth, "if a:\n").otherwise("pass\n"))), "")
    python = F.concat(F.lit("def f"), k, F.lit("(a):\n"), indented, F.lit("def _g"), k, F.lit("():\n    pass\n"))
    which = F.col("p_partkey") % (len(CODE) + 1)
    content, ext = python, F.lit("py")
    for n, c in enumerate(CODE):
        content, ext = F.when(which == n, body(c)).otherwise(content), F.when(which == n, c[0]).otherwise(ext)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k, F.lit("."), ext).alias("path"), content.alias("content"))


_KIND = f"p_partkey % {len(CODE) + 1}"
_NAME = "CASE " + _KIND + " " + " ".join(f"WHEN {n} THEN '{c[0]}'" for n, c in enumerate(CODE)) + " ELSE 'py' END"
_IN = "(" + ", ".join(str(n) for n, c in enumerate(CODE) if c[5]) + ")"  # in a class
_UPPER = "(" + ", ".join(str(n) for n, c in enumerate(CODE) if "F{k}" in c[2]) + ")"
_OPEN = "(" + ", ".join(str(n) for n, c in enumerate(CODE) if c[0] == "php") + ")"  # nothing is private
_AFTER = "(" + ", ".join(str(n) for n, c in enumerate(CODE) if c[1]) + ")"
CODE_SQL = f"""
    SELECT 'src/p' || p_partkey || '.' || {_NAME} AS file, {_KIND} AS kind, CAST({DEPTH} AS BIGINT) AS d, CASE WHEN {_KIND} IN {_UPPER} THEN 'F' ELSE 'f' END || p_partkey AS f,
           CASE WHEN {_KIND} = {len(CODE)} THEN '_g' ELSE 'g' END || p_partkey AS g, CASE WHEN {_KIND} IN {_AFTER} THEN 2 ELSE 1 END AS top,
           CASE WHEN {_KIND} = {len(CODE)} THEN 1 + d + 1 ELSE top + 2 * d + 2 END AS bottom, p_partkey FROM part
"""
FUNCTIONS_SQL = f"""
    SELECT file, f AS name, top AS start_line, bottom AS end_line, d * (d + 1) // 2 AS score FROM ({CODE_SQL})
    UNION ALL SELECT file, g, bottom + 1, CASE WHEN kind = {len(CODE)} THEN bottom + 2 ELSE bottom + 1 END, 0 FROM ({CODE_SQL})
"""


@query(f"SELECT file, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(score AS BIGINT) AS score FROM ({FUNCTIONS_SQL})")
def code_functions(spark, sf_dir):
    """Cognitive complexity of every function: a condition costs 1 and what it is nested in."""
    f = tables.functions(tables.parsed(code_files(spark, sf_dir)))
    return f.select("file", "name", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "score")])


@query(f"SELECT file, CAST(max(score) AS BIGINT) AS most, count(*) AS functions, min_by(name, lpad(CAST(1000 - score AS VARCHAR), 4, '0') || lpad(CAST(start_line AS VARCHAR), 9, '0')) AS worst FROM ({FUNCTIONS_SQL}) GROUP BY file")
def file_complexity(spark, sf_dir):
    w = complexity.worst(tables.functions(tables.parsed(code_files(spark, sf_dir))))
    return w.select("file", F.col("most").cast("long").alias("most"), "functions", "worst")


@query(f"""
    SELECT file, f AS name, CASE WHEN kind IN {_IN} THEN 'method' ELSE 'function' END AS kind, true AS exported FROM ({CODE_SQL})
    UNION ALL SELECT file, g, CASE WHEN kind IN {_IN} THEN 'method' ELSE 'function' END, kind IN {_OPEN} FROM ({CODE_SQL})
    UNION ALL SELECT file, 'C' || p_partkey, 'class', true FROM ({CODE_SQL}) WHERE kind IN {_IN}
""")
def code_symbols(spark, sf_dir):
    """What every file declares, and what of it others can use."""
    return tables.symbols(tables.parsed(code_files(spark, sf_dir))).select("file", "name", "kind", "exported")


# --- definitions, reach and history ------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT 's' || s_suppkey AS file, 'f' || (s_suppkey % 7) AS name, s_nationkey AS line, s_suppkey % 3 = 0 AS exported FROM supplier),
    a AS (SELECT DISTINCT 'f' || (n_nationkey % 9) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 's' || n_nationkey END AS hint FROM nation)
    SELECT a.name, a.hint, arg_min(s.file, CASE WHEN s.file = a.hint THEN '0' ELSE '1' END || CASE WHEN exported THEN '0' ELSE '1' END || s.file || ' ' || lpad(CAST(line AS VARCHAR), 9, '0')) AS file
    FROM a JOIN s USING (name) GROUP BY a.name, a.hint
""")
def definition_pick(spark, sf_dir):
    """One definition for each question: the hinted file's, else the first exported one, else the first."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.concat(F.lit("f"), F.col("s_suppkey") % 7).alias("name"), F.col("s_nationkey").alias("start_line"), (F.col("s_suppkey") % 3 == 0).alias("exported"))
    n = F.col("n_nationkey")
    asks = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), n % 9).alias("name"), F.when(n % 2 == 0, F.concat(F.lit("s"), n)).alias("hint")).distinct()
    return picked(s, asks).select("name", "hint", "file")


_LIB = "CASE WHEN p_partkey % 4 = 0 THEN 'src/api/p' ELSE 'lib/p' END || p_partkey || '.ts'"
_USER = "CASE WHEN l_suppkey % 9 = 0 THEN 'src/routes/s' ELSE 'src/s' END || l_suppkey || '.ts'"


@query(f"""
    WITH s AS (SELECT p_partkey AS k, {_LIB} AS file, 'f' || (p_partkey % 3) AS name, ['function', 'class', 'interface', 'const', 'type', 'enum'][1 + p_partkey % 6] AS kind, p_partkey % 7 <> 0 AS exported, CAST(p_size AS BIGINT) AS lo FROM part),
    a AS (SELECT DISTINCT l_partkey AS k, CAST(trunc(l_quantity) AS BIGINT) AS line FROM lineitem WHERE l_tax > 0.05),
    own AS (SELECT * FROM s WHERE exported AND kind IN ('function', 'class', 'const', 'enum') AND EXISTS (SELECT 1 FROM a WHERE a.k = s.k AND a.line BETWEEN s.lo AND s.lo + 2)),
    e AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS u, {_USER} AS caller FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25),
    d AS (SELECT k, count(*) AS direct, bool_or(u % 9 = 0) AS routed, list_slice(list_sort(list(caller)), 1, 12) AS files FROM e GROUP BY k),
    t AS (SELECT e.k, count(DISTINCT s_nationkey) AS transitive FROM e JOIN supplier ON s_suppkey = e.u GROUP BY e.k)
    SELECT file, name, lo AS line, direct, transitive, routed OR k % 4 = 0 AS crosses, CASE WHEN direct >= 8 OR routed OR k % 4 = 0 THEN 'medium' ELSE 'low' END AS severity, array_to_string(files, ' ') AS files
    FROM own JOIN d USING (k) JOIN t USING (k) WHERE direct >= 3 OR routed OR k % 4 = 0
""")
def blast_findings(spark, sf_dir):
    """Parts are exports of files, suppliers import them where much was returned, nations import suppliers."""
    p, li, s = (table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier"))
    lib, user = (F.expr(x.replace("VARCHAR", "STRING")) for x in (_LIB, _USER))
    kinds = F.array(*[F.lit(k) for k in ("function", "class", "interface", "const", "type", "enum")])
    own = p.select("p_partkey", lib.alias("file"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("name"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"), (F.col("p_partkey") % 7 != 0).alias("exported"), F.col("p_size").alias("start_line"), (F.col("p_size") + 2).alias("end_line"))
    part = own.select("p_partkey", F.col("file").alias("path"), "name")
    added = li.filter("l_tax > 0.05").join(part, F.col("l_partkey") == F.col("p_partkey")).select("path", F.lit(0).alias("file_ord"), F.col("l_quantity").cast("int").alias("line"), F.lit("").alias("text"))
    uses = li.filter("l_returnflag = 'R' and l_quantity > 25").join(part, F.col("l_partkey") == F.col("p_partkey")).select(user.alias("src"), "name", F.col("path").alias("dst"))
    far = s.withColumn("l_suppkey", F.col("s_suppkey")).select(F.concat(F.lit("src/n"), "s_nationkey", F.lit(".ts")).alias("src"), F.lit("x").alias("name"), user.alias("dst"))
    f = graph.blast_findings(own.drop("p_partkey"), added, uses.union(far).distinct())
    b = F.col("blast_radius")
    return f.select("file", b["symbol"].alias("name"), F.col("region.start_line").cast("long").alias("line"), b["direct_callers"].cast("long").alias("direct"), b["transitive_callers"].cast("long").alias("transitive"), b["crosses_api_boundary"].alias("crosses"), "severity", F.array_join(b["files_affected"], " ").alias("files"))


TWINS_SQL = """
    SELECT l_orderkey AS seq, list_distinct(flatten(list(CASE WHEN l_linenumber % 4 = 3 THEN ['a' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0')] ELSE ['a' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0'), 'b' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0')] END))) AS files FROM lineitem GROUP BY l_orderkey
"""


@query(f"""
    WITH c AS (SELECT t.seq, t.files, o_orderpriority = '1-URGENT' AS fix FROM ({TWINS_SQL}) t JOIN orders ON o_orderkey = t.seq),
    own AS (SELECT DISTINCT 'a' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS f FROM part WHERE p_partkey % 100 < 30),
    ex AS (SELECT DISTINCT 'b' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS f FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 100 <> 4 UNION SELECT f FROM own),
    t AS (SELECT f, count(*) AS total, count(*) FILTER (fix) AS n FROM (SELECT fix, unnest(files) AS f FROM c) WHERE f IN (SELECT f FROM own) GROUP BY f HAVING count(*) FILTER (fix) >= 3),
    churn AS (SELECT 'history.fix-churn' AS rule_id, f AS file, CASE WHEN n >= 6 THEN 'low' ELSE 'info' END AS severity, n || '/' || total AS detail FROM t ORDER BY n >= 6 DESC, f LIMIT 8),
    r AS (SELECT seq, files, unnest(files) AS f FROM c WHERE len(files) <= 30),
    st AS (SELECT f, count(*) AS n FROM r WHERE f IN (SELECT f FROM own) GROUP BY f HAVING count(*) >= 5),
    pr AS (SELECT f, partner, count(*) AS together FROM (SELECT f, unnest(files) AS partner FROM r WHERE f IN (SELECT f FROM own)) WHERE partner <> f AND partner NOT IN (SELECT f FROM own) GROUP BY ALL),
    best AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY f ORDER BY together DESC, partner) = 1),
    pairs AS (SELECT best.f, partner FROM best JOIN st USING (f) WHERE together >= 4 AND together * 5 >= n * 3 AND partner IN (SELECT f FROM ex) ORDER BY best.f LIMIT 8)
    SELECT * FROM churn UNION ALL SELECT 'history.co-change-missing', f, 'low', 'partner=' || partner FROM pairs
""")
def history_both(spark, sf_dir):
    """Often fixed files together with files whose usual companion is missing, if it still exists; the report shows eight of each."""
    file = lambda c, x: F.concat(F.lit(c), F.lpad((F.col(x) % 100).cast("string"), 3, "0"))
    both = F.when(F.col("l_linenumber") % 4 == 3, F.array(file("a", "l_partkey"))).otherwise(F.array(file("a", "l_partkey"), file("b", "l_partkey")))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.explode(both).alias("f")).groupBy("seq").agg(F.collect_set("f").alias("files"))
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderpriority") == "1-URGENT", "fix: it").otherwise("add it").alias("subject")).join(files, "seq")
    p = table(spark, sf_dir, "part")
    changed = p.filter("p_partkey % 100 < 30").select(file("a", "p_partkey").alias("path"), F.lit(0).alias("file_ord"), F.lit(1).alias("line")).distinct()
    existing = p.filter("p_partkey % 3 <> 0 and p_partkey % 100 <> 4").select(file("b", "p_partkey").alias("path")).union(changed.select("path"))
    return history.run(log, changed, existing).select("rule_id", "file", "severity", F.col("anchor.detail").alias("detail"))


# --- index files ------------------------------------------------------------------------------------------------


def _varint(n: F.Column) -> F.Column:
    """A number below 2^28 as the hexadecimal digits of its varint."""
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    n = n.cast("long")
    group = lambda k: F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))
    more = lambda k: group(k).bitwiseOR(F.lit(128))
    return F.when(n < 1 << 7, two(n)).when(n < 1 << 14, F.concat(two(more(0)), two(group(1)))).when(n < 1 << 21, F.concat(two(more(0)), two(more(1)), two(group(2)))).otherwise(F.concat(two(more(0)), two(more(1)), two(more(2)), two(group(3))))


def _field(number: int, digits: F.Column) -> F.Column:
    """A length-delimited field; ``digits`` are its content's hexadecimal digits."""
    return F.concat(F.lit(f"{number << 3 | 2:02X}"), _varint(F.length(digits) / 2), digits)


def _text(s: F.Column) -> F.Column:
    return F.hex(F.encode(s, "UTF-8"))


@query(f"SELECT file, CAST(line + 1 AS BIGINT) AS line, symbol, count(*) AS n, bool_or(is_def) AS is_def FROM ({OCC_SQL}) GROUP BY ALL")
def scip_scan(spark, sf_dir):
    """The events as the bytes of index files, one for each file of the events, and read back."""
    # Step by step: a field's digits stand in its length too, and a nested expression would repeat them many times.
    o = event_occurrences(spark, sf_dir).select("file", "is_def", F.concat(_varint(F.col("line")), F.lit("00")).alias("place"), _text(F.col("symbol")).alias("symbol"))
    role = F.concat(F.lit(f"{scip.ROLES << 3:02X}"), F.when(F.col("is_def"), "01").otherwise("00"))
    o = o.select("file", F.concat(_field(scip.RANGE, F.col("place")), _field(scip.SYMBOL, F.col("symbol")), role).alias("one"))
    docs = o.select("file", _field(scip.OCCURRENCES, F.col("one")).alias("one")).groupBy("file").agg(F.concat_ws("", F.array_sort(F.collect_list("one"))).alias("rows"))
    local = "0A020500120D" + "local 7 here!".encode().hex().upper()  # a symbol that no other file can see
    docs = docs.select(_text(F.col("file")).alias("path"), "rows").select(F.concat(_field(scip.PATH, F.col("path")), _field(scip.OCCURRENCES, F.lit(local)), "rows").alias("doc"))
    back = scip.read(docs.select(F.unhex(F.concat(_field(1, F.lit("AB" * 9)), _field(scip.DOCUMENTS, F.col("doc")))).alias("content")))
    return back.groupBy("file", F.col("line").cast("long").alias("line"), "symbol").agg(F.count("*").alias("n"), F.max("is_def").alias("is_def"))


# --- texts ---------------------------------------------------------------------------------------------------------


@query("SELECT 'Review of ' || count(*) || ' changed file(s): ' || count(*) FILTER (o_orderpriority = '1-URGENT') || ' must-fix, ' || count(*) FILTER (o_orderpriority = '2-HIGH') || ' concern, ' || count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) || ' nit' || CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN '; ' || count(*) FILTER (o_orderstatus = 'P') || ' left out as learned' ELSE '' END || '.' AS line FROM orders GROUP BY o_custkey")
def summary_lines(spark, sf_dir):
    """A customer's orders as a review's counts in a sentence."""
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("files_changed"), F.count_if(urgent).alias("must_fix"), F.count_if(high).alias("concern"), F.count_if(~urgent & ~high).alias("nit"), F.count_if(F.col("o_orderstatus") == "P").alias("suppressed"))
    return sinks.summary_line(o)


@query(f"SELECT rule_id, {LEVEL_SQL} AS level, file, greatest(line, 1) AS line, id FROM ({DEDUP_SQL})")
def sarif_shards(spark, sf_dir):
    """Findings as SARIF logs of bounded runs, read back; rules are told by their place in the run's list."""
    logs = sinks.sarif_runs(findings.first_wins(doc_findings(spark, sf_dir)), rows_per_run=500)
    shape = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleIndex:int,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>,partialFingerprints:struct<primary:string>>>>>"
    run = F.from_json("sarif", shape)["runs"][0]
    rows = logs.select(run["tool"]["driver"]["rules"].alias("rules"), F.explode(run["results"]).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(F.get("rules", F.col("r.ruleIndex"))["id"].alias("rule_id"), "r.level", place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), F.col("r.partialFingerprints.primary").alias("id"))


# --- streams: the events' file, read as a stream until its end ------------------------------------------------------


def streamed(spark, sf_dir, name: str, make, mode: str) -> DataFrame:
    """The rows that a stream over a table gives, with the number of their batch, kept in the shared folder."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, name)
    source = spark.readStream.schema(rows.schema)
    if rows.inputFiles()[0].endswith(f"/{name}.parquet"):  # one file: a stream reads folders
        source = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    else:
        source = source.parquet(f"{sf_dir}/{name}.parquet")
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = {k: spark.conf.get(k, None) for k in (empty, "spark.sql.streaming.stateStore.providerClass")}
    try:
        spark.conf.set(empty, "false")  # timers of the clock would make batches without end
        out = make(source)
        save = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/rows/{n}")
        out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch long").option("recursiveFileLookup", "true").parquet(f"{path}/rows")


@query("SELECT user_id || event_type AS id, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY ALL")
def stream_first_wins(spark, sf_dir):
    """The first event of every user and kind, while they keep coming."""
    make = lambda e: stateful.first_wins(e.select(F.concat(F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id"), order="event_id", keep_days=400)
    return streamed(spark, sf_dir, "events", make, "append").select("id", "event_id")


_EVENT = "CASE WHEN event_id % 60 = 0 THEN 'start' WHEN event_type = 'view' THEN 'floor' WHEN event_type = 'click' THEN 'symbol' WHEN event_type = 'signup' THEN 'inspect' WHEN event_type = 'purchase' THEN 'accepted' ELSE 'dismissed' END"


@query(f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_id AS seq, {_EVENT} AS event, 'k' || (event_id % 9) AS key, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'callers' ELSE 'definition' END ELSE 'f' || (event_id % 2) END AS value FROM events),
    c AS (SELECT e.* FROM e JOIN (SELECT repo, max(seq) AS s FROM e WHERE event = 'start' GROUP BY repo) b ON b.repo = e.repo AND e.seq >= b.s),
    fl AS (SELECT DISTINCT repo, key FROM c WHERE event = 'floor'),
    ft AS (SELECT repo, key, arg_max(event, seq) AS fate FROM c WHERE event IN ('dismissed', 'accepted') GROUP BY ALL),
    sy AS (SELECT DISTINCT repo, key, value FROM c WHERE event = 'symbol'),
    tr AS (SELECT DISTINCT repo, key FROM c WHERE event = 'inspect' AND value = 'callers')
    SELECT r.repo, (SELECT count(*) FROM fl WHERE fl.repo = r.repo) AS floor, (SELECT count(*) FROM fl JOIN ft USING (repo, key) WHERE fl.repo = r.repo AND fate = 'dismissed') AS dismissed,
           (SELECT count(*) FROM fl JOIN ft USING (repo, key) WHERE fl.repo = r.repo AND fate = 'accepted') AS accepted, (SELECT count(*) FROM sy WHERE sy.repo = r.repo) AS symbols,
           (SELECT count(*) FROM sy SEMI JOIN tr USING (repo, key) WHERE sy.repo = r.repo) AS traced, (SELECT count(*) FROM c WHERE c.repo = r.repo AND event = 'inspect') AS inspect_calls
    FROM (SELECT DISTINCT repo FROM c) r
""")
def stream_ledger(spark, sf_dir):
    """Every user as a repository: the ledger of its last review after the stream's end."""
    value = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, "callers").otherwise("definition")).otherwise(F.concat(F.lit("f"), F.col("event_id") % 2))
    rows = lambda e: e.select(F.col("user_id").cast("string").alias("repo"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"), F.concat(F.lit("k"), F.col("event_id") % 9).alias("key"), value.alias("value"))
    got = streamed(spark, sf_dir, "events", lambda e: stateful.ledger(rows(e)), "update")
    last = got.groupBy("repo").agg(F.max_by(F.struct(*stateful.Ledger.COUNTS), "batch").alias("c"))
    return last.select("repo", "c.*")
