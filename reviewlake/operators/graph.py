"""Import graphs, exact occurrence indexes, and how far a changed symbol reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import checkpoint
from . import findings, intervals

# Extensions tried for an import, confidences, thresholds, files listed.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
COMPILED = (".js", ".jsx", ".mjs", ".cjs")
HEURISTIC, PRECISE = 0.6, 0.97
LEAST_CALLERS, MANY_CALLERS, FILES_SHOWN = 3, 8, 12
IMPACTFUL = ("function", "class", "const", "enum")
#: Importers from which a file is a hub.
HUB = 10_000
#: More callers than a point query lists.
ALL = 2**31 - 1


def normalized_target(source: F.Column, from_file: F.Column) -> F.Column:
    """A relative specifier as a path from the root; steps above it stay at it."""
    folder = F.substr(from_file, F.lit(1), F.length(from_file) - F.length(F.substring_index(from_file, "/", -1)))
    parts = F.filter(F.split(F.concat(folder, source), "/"), lambda s: (s != "") & (s != "."))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def targets_of(key: F.Column) -> F.Column:
    """array<struct<target, turn>>: the targets that may be spelt as a key, a source before what it compiles to."""
    compiled = F.rlike(key, F.lit(r"\.(js|jsx|mjs|cjs)$"))
    own = F.struct(key.alias("target"), compiled.cast("int").alias("turn"))
    return F.array(own, *[F.struct(F.concat(key, F.lit(e)).alias("target"), F.lit(0).alias("turn")) for e in COMPILED])


def names_of(path: F.Column) -> F.Column:
    """array<struct<key, place>>: the spellings by which a file is found, and their rank.

    A path itself, then without its extension, then the folder of an index file.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for k, e in enumerate(EXTENSIONS) for x in (e, k)]), F.regexp_extract(path, r"(\.[a-z]+)$", 1))
    bare = F.regexp_replace(path, r"\.[a-z]+$", "")
    folder = F.when(F.endswith(bare, F.lit("/index")), F.regexp_replace(bare, "/index$", ""))
    rank = lambda key, place: F.struct(key.alias("key"), place.cast("int").alias("place"))
    return F.filter(F.array(rank(path, F.lit(0)), rank(F.when(known.isNotNull(), bare), known + 1), rank(F.when(known.isNotNull(), folder), known + 1 + len(EXTENSIONS))), lambda x: x["key"].isNotNull())


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, name, dst) of (file, names, source) imports that resolve to a file (path).

    Files are few beside imports: what each answers to is settled on their side, and an import
    goes out once, past a hash table of the files, without a sort or a group of its own.
    """
    local = imports.filter(F.startswith("source", F.lit("."))).select("file", "names", normalized_target(F.col("source"), F.col("file")).alias("target"))
    known = files.select("path").distinct().select("path", F.explode(names_of(F.col("path"))).alias("n")).select("path", "n.place", F.explode(targets_of(F.col("n.key"))).alias("t"))
    best = known.groupBy("t.target").agg(F.min_by("path", F.struct("t.turn", "place")).alias("dst"))
    return local.join(best.hint("shuffle_hash"), "target").select(F.col("file").alias("src"), F.explode_outer("names").alias("name"), "dst").distinct()


def direct_callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, name, caller): other files that import the symbol by name."""
    hit = edges.select("src", "name", F.col("dst").alias("file")).join(symbols.select("file", "name").distinct().hint("shuffle_hash"), ["file", "name"])
    return hit.filter("src <> file").select("file", "name", F.col("src").alias("caller")).distinct()


def transitive_callers(direct: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(file, name, transitive): files one import further on, whatever they import.

    Symbols whose callers are all imported by at most ``hub`` files meet their second hop row
    by row.  A caller with more importers is a hub: its importers are a bit map, cut in pieces
    of 32 768 files, and a symbol unites its hubs' maps instead of reading their rows.
    """
    hop = edges.select(F.col("dst").alias("caller"), F.col("src").alias("second"))
    # Counted with repeats, which may make a few hubs too many but spares a pass over all pairs.
    hubs = checkpoint(hop.groupBy("caller").count().filter(F.col("count") > hub).select("caller"))
    if hubs.isEmpty():
        return _second_hop(direct, hop)
    # Hubs are at most as many as imports divided by ``hub``.
    over = direct.join(hubs, "caller", "left_semi").select("file", "name").distinct()
    light = _second_hop(direct.join(over, ["file", "name"], "left_anti"), hop.join(hubs, "caller", "left_anti"))
    return light.unionByName(_second_hop_by_maps(direct.join(over, ["file", "name"], "left_semi"), hop.distinct(), hubs))


def _second_hop(direct: DataFrame, hop: DataFrame) -> DataFrame:
    """Callers' importers that are no callers themselves: one grouping tells them apart.

    No caller has many importers here, so repeated hops go where they meet the callers.
    """
    far = direct.join(hop.repartition("caller").distinct(), "caller").filter("second <> file").select("file", "name", "second", F.lit(False).alias("near"))
    every = far.union(direct.select("file", "name", "caller", F.lit(True)))
    every = every.groupBy("file", "name", "second").agg(F.max("near").alias("near")).filter("not near")
    return every.groupBy("file", "name").agg(F.count("*").alias("transitive"))


def _second_hop_by_maps(direct: DataFrame, hop: DataFrame, hubs: DataFrame) -> DataFrame:
    """As ``_second_hop``, by bit maps: of all reached and excluded files less the excluded ones."""
    files = direct.select(F.col("caller").alias("path")).union(direct.select("file")).union(hop.select("second")).distinct()
    number = checkpoint(files.withColumn("no", F.monotonically_increasing_id()))
    place = [F.bitmap_bucket_number("no").alias("bucket"), F.bitmap_bit_position("no").alias("bit")]
    near = hop.join(number, F.col("second") == F.col("path")).select("caller", *place)
    maps = near.join(hubs, "caller", "left_semi").groupBy("caller", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    rest = direct.join(hubs, "caller", "left_anti").join(near, "caller").select("file", "name", "bucket", "bit")
    out = direct.select("file", "name", F.col("caller").alias("path")).union(direct.select("file", "name", "file").distinct())
    out = out.join(number, "path").select("file", "name", *place)
    bits = lambda rows: rows.groupBy("file", "name", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    own = bits(out)
    every = direct.join(maps, "caller").select("file", "name", "bucket", "map").union(bits(rest)).union(own)
    every = every.groupBy("file", "name", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("map")).alias("n"))
    total = every.groupBy("file", "name").agg(F.sum("n").alias("n"))
    less = own.groupBy("file", "name").agg(F.sum(F.bitmap_count("map")).alias("less"))
    return total.join(less, ["file", "name"]).select("file", "name", (F.col("n") - F.col("less")).alias("transitive")).filter("transitive > 0")


def first_callers(direct: DataFrame, shown: int) -> DataFrame:
    """(file, name, callers): the first ``shown`` callers by name.

    Ranks are cut before the shuffle and after it, so that no task holds all callers of a symbol.
    """
    w = Window.partitionBy("file", "name").orderBy("caller")
    some = direct.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= shown)
    return some.groupBy("file", "name").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def heuristic_reach(symbols: DataFrame, edges: DataFrame, shown: int = FILES_SHOWN) -> DataFrame:
    """(file, name, callers, direct, transitive, crosses) by the import graph.

    ``callers`` are the first ``shown`` ones.  A symbol crosses a boundary if its own file or a
    caller lies in an API folder.
    """
    direct = direct_callers(symbols, edges)
    far = transitive_callers(direct, edges)
    near = direct.groupBy("file", "name").agg(F.count("*").alias("direct"), (paths.is_api_path(F.col("file")) | F.max(paths.is_api_path(F.col("caller")))).alias("crosses"))
    # Every symbol here has callers; a left join is left out where nobody asks for their names.
    near = near.join(first_callers(direct, shown), ["file", "name"], "left")
    return near.join(far, ["file", "name"], "left").withColumn("transitive", F.coalesce("transitive", F.lit(0).cast("long"))).select("file", "name", "callers", "direct", "crosses", "transitive")


def symbol_tokens(symbol: F.Column) -> F.Column:
    return F.split(symbol, r"[^\p{L}\p{N}_$]+")


def occurrence_of(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(file, name, start_line, symbol): the definition at the line, the one before or the next.

    The name must be a whole token of the occurrence's symbol.
    """
    tried = symbols.select("file", "name", "start_line", F.posexplode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("turn", "off"))
    defs = occurrences.filter("is_def").select("file", "line", "symbol")
    hit = tried.withColumn("line", F.col("start_line") + F.col("off")).join(defs, ["file", "line"])
    hit = hit.filter(F.array_contains(symbol_tokens(F.col("symbol")), F.col("name")))
    return hit.groupBy("file", "name", "start_line").agg(F.min_by("symbol", F.struct("turn", "symbol")).alias("symbol"))


def precise_reach(symbols: DataFrame, occurrences: DataFrame, shown: int = FILES_SHOWN) -> DataFrame:
    """As ``heuristic_reach``, from an index; symbols it knows and nobody uses have no callers."""
    return _reach_of(occurrence_of(symbols, occurrences), occurrences, shown)


def _reach_of(own: DataFrame, occurrences: DataFrame, shown: int) -> DataFrame:
    """``precise_reach`` of symbols with their occurrences."""
    # References are counted by symbol and file first, so that a much used symbol shrinks before it is joined.
    refs = occurrences.filter("not is_def").groupBy("symbol", F.col("file").alias("caller")).agg(F.count("*").alias("n"))
    rows = own.join(refs, "symbol").groupBy("file", "name", "caller").agg(F.sum("n").alias("n"))
    other = rows.filter("caller <> file").select("file", "name", "caller")
    counts = rows.groupBy("file", "name").agg(F.count_if(F.col("caller") != F.col("file")).alias("direct"), F.max(paths.is_api_path(F.col("caller")) & (F.col("caller") != F.col("file"))).alias("api"), F.sum("n").alias("total_refs"))
    out = own.select("file", "name").distinct().join(counts, ["file", "name"], "left").join(first_callers(other, shown), ["file", "name"], "left")
    return out.select(
        "file",
        "name",
        F.coalesce("callers", F.array().cast("array<string>")).alias("callers"),
        F.coalesce("direct", F.lit(0).cast("long")).alias("direct"),
        (paths.is_api_path(F.col("file")) | F.coalesce("api", F.lit(False))).alias("crosses"),
        F.coalesce("total_refs", F.lit(0).cast("long")).alias("total_refs"),
    )


def tiered_reach(symbols: DataFrame, edges: DataFrame, occurrences: DataFrame | None) -> DataFrame:
    """The index's answer where it has one, even an empty one; else the import graph's."""
    cols = ["file", "name", "callers", "direct", "transitive", "crosses", "confidence", "method"]

    def of_imports(asked: DataFrame) -> DataFrame:
        return heuristic_reach(asked, edges).withColumn("confidence", F.lit(HEURISTIC)).withColumn("method", F.lit("import graph (ts/js)")).select(*cols)

    if occurrences is None:
        return of_imports(symbols)
    # The import graph is asked only for what the index does not know: its hops are most of the work.
    own = checkpoint(occurrence_of(symbols, occurrences))
    precise = _reach_of(own, occurrences, FILES_SHOWN).withColumn("transitive", F.lit(0).cast("long")).withColumn("confidence", F.lit(PRECISE)).withColumn("method", F.lit("scip")).select(*cols)
    return precise.unionByName(of_imports(symbols.join(own, ["file", "name"], "left_anti")))


def touched(symbols: DataFrame, added: DataFrame) -> DataFrame:
    """Symbols (file, start_line, end_line) with an added line between their ends."""
    lines = added.select(F.col("path").alias("file"), F.col("line").alias("__line"))
    return intervals.holding(symbols, lines, "file", "start_line", "end_line", "__line")


def blast_findings(symbols: DataFrame, added: DataFrame, edges: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """Changed exports that others depend on."""
    own = touched(symbols.filter(F.col("exported") & F.col("kind").isin(*IMPACTFUL) & ~paths.is_generated(F.col("file"))), added)
    reach = tiered_reach(own, edges, occurrences)
    reach = reach.filter((F.col("direct") >= LEAST_CALLERS) | (F.col("crosses") & (F.col("direct") >= 1)))
    first = own.groupBy("file", "name").agg(F.min("start_line").alias("line"))
    rows = reach.join(first, ["file", "name"]).withColumn("line_ord", F.col("line"))
    blast = F.struct(F.col("name").alias("symbol"), F.col("direct").cast("int").alias("direct_callers"), F.col("transitive").cast("int").alias("transitive_callers"), F.col("callers").alias("files_affected"), F.col("crosses").alias("crosses_api_boundary"), F.col("confidence").cast("float").alias("resolution_confidence"), F.col("method").alias("resolution_method"))
    message = F.concat(F.col("name"), F.lit(" is used by "), F.col("direct").cast("string"), F.lit(" file(s)"), F.when(F.col("crosses"), ", across an API boundary").otherwise(""))
    level = F.when((F.col("direct") >= MANY_CALLERS) | F.col("crosses"), "medium").otherwise("low")
    return findings.make(rows, rule_id="impact.blast-radius", category="impact", severity=level, confidence="confidence", title="Change with a wide reach", message=message, anchor_kind="graph", anchor_detail="name", source="blast-radius", key=F.concat_ws("::", "file", "name"), blast=blast)


def export_spans(symbols: DataFrame) -> DataFrame:
    """(file, name, line, until): from an export to the line before the file's next one."""
    w = Window.partitionBy("file").orderBy("line", "name")
    return symbols.withColumn("until", F.coalesce(F.lead("line").over(w) - 1, F.lit(2**31 - 1)))


def changed_exports(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, name) of exports (file, name, line) whose span meets a hunk (file, lo, hi).

    Two intervals meet if one holds the other's first number.
    """
    spans = export_spans(symbols).select("file", "name", "line", "until")
    begun = intervals.holding(spans, hunks.select("file", "lo"), "file", "line", "until", "lo")
    held = intervals.inside(spans.select("file", "name", "line"), hunks, "file", "lo", "hi", "line")
    return begun.select("file", "name").union(held.select("file", "name")).distinct()
