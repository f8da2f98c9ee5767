"""Building the code graph: imports, references, weighted edges, tests, calls, rescue of orphans.

Frames: files(id, path, line_count, symbol_count, is_barrel), symbols(id, file_id, name, kind, line,
end_line, is_exported), refs(id, file_id, name, import_source, source_file_id), edges(source_file_id,
target_file_id, weight, confidence), calls(caller_symbol_id, callee_name, callee_symbol_id,
callee_file_id, line, confidence, tier). Rows with null keys take no part in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.paths import is_test_like, tested_path
from skeinwork.runtime import stored

# Endings tried for an import in order, then index files; weights and tiers of edges.
IMPORT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
TIERS = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}
RESCUE_COCHANGE, RESCUE_FOLDER = 0.5, 0.3


def joined_path(folder, step):
    """A folder and a relative import as one path, ``.`` and ``..`` steps applied."""
    parts = F.filter(F.split(F.concat_ws("/", folder, step), "/"), lambda x: ~x.isin("", "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(stack, "/")


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, import_source, target_file_id`` of the relative imports that name a file: the first
    of the exact path, the known endings and the index files that exists."""
    paths = files.select(F.col("id"), "path").where("path is not null").dropDuplicates(["path"])
    asked = refs.select("file_id", "import_source").where(F.col("import_source").startswith(".")).distinct()
    here = asked.join(paths.select(F.col("id").alias("file_id"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder")), "file_id")
    base = here.select("file_id", "import_source", joined_path(F.col("folder"), F.col("import_source")).alias("base"))
    tried = base.select("file_id", "import_source", F.posexplode(F.transform(F.array(*map(F.lit, IMPORT_ENDINGS)), lambda e: F.concat("base", e))).alias("nth", "path"))
    hit = tried.join(paths.select("path", F.col("id").alias("target_file_id")), "path")
    return hit.groupBy("file_id", "import_source").agg(F.min_by("target_file_id", "nth").alias("target_file_id"))


def resolve_refs(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Refs with ``source_file_id`` filled where it was null: the file of an exported symbol of the name,
    one whose path equals or ends with the import's source before others, then the least symbol id."""
    known = symbols.where("is_exported").select("name", F.col("id").alias("sid"), "file_id").distinct().join(files.select(F.col("id").alias("file_id"), "path").distinct(), "file_id")
    known = known.select("name", "sid", F.col("file_id").alias("found"), "path")
    open_ = refs.where("source_file_id is null").drop("source_file_id")
    source = F.coalesce(F.col("import_source"), F.lit(""))
    fits = (F.col("path") == source) | ((source != "") & F.col("path").endswith(source))
    both = open_.join(known, "name").groupBy("id").agg(F.min_by("found", F.struct((~fits).cast("int").alias("p"), "sid")).alias("source_file_id"))
    return refs.where("source_file_id is not null").unionByName(open_.join(both, "id", "left"))


def weighted_edges(refs: DataFrame, source: str = "file_id", target: str = "source_file_id") -> DataFrame:
    """One edge per pair of files, its weight the number of references times ln 2, confidence 1."""
    rows = refs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    n = rows.groupBy(F.col(source).alias("source_file_id"), F.col(target).alias("target_file_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("source_file_id", "target_file_id", (F.col("n") * F.log(F.lit(2.0))).alias("weight"), F.lit(1.0).alias("confidence"))


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` in place of any of the same ends."""
    ends = ["source_file_id", "target_file_id"]
    return edges.join(new.select(ends), ends, "left_anti").unionByName(new)


def test_edges(files: DataFrame) -> DataFrame:
    """An edge of weight 1 from each test file to the file it is named after."""
    f = files.select("id", "path").distinct()
    tests = f.where(is_test_like(F.col("path"))).select(F.col("id").alias("source_file_id"), "path", tested_path(F.col("path")).alias("target"))
    hit = tests.where("path <> target").join(f.select(F.col("id").alias("target_file_id"), F.col("path").alias("target")), "target")
    return hit.select("source_file_id", "target_file_id", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"))


def call_graph(symbols: DataFrame, refs: DataFrame, lines: DataFrame) -> DataFrame:
    """Calls: functions whose body names a symbol that their file imports, with the first such line.

    ``lines`` is file_id, line, text. A name resolved to a file's exported symbol is EXTRACTED, else INFERRED.
    The own name and ``*`` are no calls. Lines are met with imported names by the words in
    them, an equi-join, not by a pattern per name.
    """
    funcs = symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("caller_symbol_id"), "file_id", F.col("name").alias("caller"), F.col("line").alias("first"), "end_line").distinct()
    words = lines.select("file_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))
    names = refs.where("name <> '*'").groupBy("file_id", "name").agg(F.max("source_file_id").alias("callee_file_id"))
    seen = words.join(names, ["file_id", "name"])
    # a function's body is met by the file and its lines
    inside = seen.join(funcs, "file_id").where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("end_line")) & (F.col("name") != F.col("caller")))
    calls = inside.groupBy("caller_symbol_id", F.col("name").alias("callee_name"), "callee_file_id").agg(F.min("line").alias("line"))
    known = symbols.where("is_exported").select(F.col("file_id").alias("callee_file_id"), F.col("name").alias("callee_name"), "id").groupBy("callee_file_id", "callee_name").agg(F.min("id").alias("callee_symbol_id"))
    out = calls.join(known, ["callee_file_id", "callee_name"], "left")
    tier = F.when(F.col("callee_symbol_id").isNotNull(), "EXTRACTED").otherwise("INFERRED")
    return out.select("caller_symbol_id", "callee_name", "callee_symbol_id", "callee_file_id", "line", F.when(tier == "EXTRACTED", TIERS["EXTRACTED"]).otherwise(TIERS["INFERRED"]).alias("confidence"), tier.alias("tier"))


def rescue_edges(files: DataFrame, edges: DataFrame, cochanges: DataFrame, least: int = 2) -> DataFrame:
    """Edges to files that nothing imports: from the file most often changed with them that is no such file
    itself; else from the least imported file in their folder or below it."""
    f = files.select("id", "path", "is_barrel").distinct()
    held = edges.select(F.col("target_file_id").alias("id")).distinct()
    lone = f.where("not is_barrel").join(held, "id", "left_anti").select("id", "path")
    both = cochanges.select(F.col("file_id_a").alias("id"), F.col("file_id_b").alias("peer"), "count").union(cochanges.select("file_id_b", "file_id_a", "count"))
    both = both.where(F.col("count") >= least).join(lone.select("id"), "id", "left_semi").join(lone.select(F.col("id").alias("peer")), "peer", "left_anti")
    top = both.groupBy("id").agg(F.max_by("peer", F.struct("count", -F.col("peer"))).alias("peer"))
    first = top.select(F.col("peer").alias("source_file_id"), F.col("id").alias("target_file_id"), F.lit(RESCUE_COCHANGE).alias("weight"), F.lit(RESCUE_COCHANGE).alias("confidence"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    good = f.join(held, "id", "left_semi").where(F.size(parts) > 1).select("id", F.explode(above).alias("folder")).groupBy("folder").agg(F.min("id").alias("peer"))
    rest = lone.join(top.select("id"), "id", "left_anti").select("id", F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).join(good, "folder")
    second = rest.select(F.col("peer").alias("source_file_id"), F.col("id").alias("target_file_id"), F.lit(RESCUE_FOLDER).alias("weight"), F.lit(RESCUE_FOLDER).alias("confidence"))
    return first.unionByName(second)


def confidence_tier(confidence):
    return F.when(confidence >= 1.0, "EXTRACTED").when(confidence >= 0.7, "INFERRED").otherwise("AMBIGUOUS")


def indexed(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, unchanged) of ``files`` against ``known`` by path and mtime_ms; a known path with another
    mtime is changed. Of repeated paths the latest counts."""
    last = files.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime_ms"), F.desc("id")))).where("_r = 1").drop("_r")
    same = known.select("path", "mtime_ms").distinct()
    return last.join(same, ["path", "mtime_ms"], "left_anti"), last.join(same, ["path", "mtime_ms"], "left_semi")


def apply_changes(table: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "file_id") -> DataFrame:
    """``table`` with the rows of changed and removed files taken out and the new ones in."""
    gone = changed.select(key).union(removed.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(changed, allowMissingColumns=True)


def unique_symbols(symbols: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Symbols of each file once by line, name and kind, the one of the least id; with an outline, exported if it says so."""
    once = symbols.groupBy("file_id", "line", "name", "kind").agg(F.min_by(F.struct("id", "end_line", "is_exported"), "id").alias("s")).select("s.id", "file_id", "name", "kind", "line", "s.end_line", "s.is_exported")
    if outline is None:
        return once
    named = outline.where("exported").select("file_id", "name").distinct().withColumn("_x", F.lit(True))
    return once.drop("is_exported").join(named, ["file_id", "name"], "left").withColumn("is_exported", F.coalesce("_x", F.lit(False))).drop("_x")


class CodeGraph:
    """All passes in the order of a full build: references, edges, rank, tests, calls, co-changes, rescue.
    The rank is computed before the edges of tests and rescue exist. ``lines`` is file_id, line, text."""

    def __init__(self, files: DataFrame, symbols: DataFrame, refs: DataFrame, lines: DataFrame, commits: DataFrame):
        from skeinwork.operators.cooccurrence import cooccurring

        self._index(files, symbols, refs, lines)
        edges = replace_edges(self.edges, test_edges(files))
        self.calls = call_graph(symbols, self.refs, lines)
        pairs = cooccurring(commits, "commit", "file_id")
        self.cochanges = pairs.select(F.col("item_a").alias("file_id_a"), F.col("item_b").alias("file_id_b"), F.col("together").alias("count"))
        self.edges = stored(edges.unionByName(rescue_edges(files, edges, self.cochanges)), "edges")

    def _index(self, files: DataFrame, symbols: DataFrame, refs: DataFrame, lines: DataFrame) -> None:
        from skeinwork.operators.rank import pagerank

        self.files, self.symbols, self.open_refs, self.lines = files, symbols, refs, lines
        self.refs = stored(resolve_refs(refs, symbols, files), "refs")
        self.edges = weighted_edges(self.refs)
        ends = self.edges.select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"), "weight")
        self.ranks = pagerank(files.select(F.col("id").alias("node")), ends)

    def changed(self, files: DataFrame, symbols: DataFrame, refs: DataFrame, lines: DataFrame, removed: DataFrame) -> CodeGraph:
        """The graph after some files (their new rows, and those of their symbols, references and lines) were written and others
        (file_id) removed: references, edges, rank and calls are made anew. Edges of tests and of rescue, and co-changes, stay as they
        were as long as both their ends do; an edge made anew takes the place of one with the same ends."""
        gone = files.select(F.col("id").alias("file_id")).union(removed.select("file_id")).distinct()
        other = lambda old, new, key="file_id": stored(old.join(gone.withColumnRenamed("file_id", key), key, "left_anti").unionByName(new, allowMissingColumns=True), "changed")
        after = CodeGraph.__new__(CodeGraph)
        after._index(other(self.files, files, "id"), other(self.symbols, symbols), other(self.open_refs, refs), other(self.lines, lines))
        here = after.files.select(F.col("id").alias("source_file_id")).distinct()
        kept = self.edges.join(here, "source_file_id", "left_semi").join(here.withColumnRenamed("source_file_id", "target_file_id"), "target_file_id", "left_semi")
        made = self.edges.select("source_file_id", "target_file_id").join(weighted_edges(self.refs).select("source_file_id", "target_file_id"), ["source_file_id", "target_file_id"], "left_semi")
        kept = kept.join(made, ["source_file_id", "target_file_id"], "left_anti").select("source_file_id", "target_file_id", "weight", "confidence")
        after.edges = stored(replace_edges(kept, after.edges), "edges")
        after.calls = call_graph(after.symbols, after.refs, after.lines)
        after.cochanges = self.cochanges
        return after
