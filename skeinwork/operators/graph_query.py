"""Reads over files, symbols, edges, references and calls."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.paths import is_test_like, is_test_path
from skeinwork.functions.text import clamp, squash
from skeinwork.operators.traverse import reach, strong_components
from skeinwork.runtime import stored


def graph_stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of distinct rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def top_files(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.orderBy(F.desc("pagerank"), "path").limit(limit)


def neighbours(edges: DataFrame, files: DataFrame, file_id: int, dependents: bool) -> DataFrame:
    """Files at the other end of a file's edges: those that need it, or that it needs."""
    here, there = ("target_file_id", "source_file_id") if dependents else ("source_file_id", "target_file_id")
    f = files.select(F.col("id").alias(there), "path").distinct()
    return edges.where(F.col(here) == file_id).join(f, there).select(F.col(there).alias("file_id"), "path", "weight")


def changed_with(cochanges: DataFrame, files: DataFrame, file_id: int, limit: int = 20) -> DataFrame:
    """Files most often changed with a file, in either column of the pairs."""
    a, b = F.col("file_id_a"), F.col("file_id_b")
    pairs = cochanges.where((a == file_id) | (b == file_id)).select(F.when(a == file_id, b).otherwise(a).alias("file_id"), "count")
    named = pairs.join(files.select(F.col("id").alias("file_id"), "path").distinct(), "file_id").where("path <> ''")
    return named.orderBy(F.desc("count"), "path").limit(limit)


def file_symbols(symbols: DataFrame, file_id: int) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id).orderBy("line", "id")


def find_symbols(symbols: DataFrame, files: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """Symbols whose name contains ``part`` in any case, those of high-ranking files first."""
    hit = symbols.where(F.instr(F.lower("name"), part.lower()) > 0)
    return hit.join(files.select(F.col("id").alias("file_id"), "path", "pagerank").distinct(), "file_id").orderBy(F.desc("pagerank"), "path", "line", "id").limit(limit)


def callers(calls: DataFrame, symbols: DataFrame, target: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Calls of the symbols ``target`` (id, file_id, name) by name, in their file or in none known."""
    t = target.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf"), F.col("name").alias("callee_name"))
    hit = calls.where(F.col("confidence") >= min_confidence).join(t, "callee_name").where("callee_file_id is null or callee_file_id = tf")
    s = symbols.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller_name"), F.col("file_id").alias("caller_file_id")).distinct()
    return hit.join(s, "caller_symbol_id").select("target_id", "caller_symbol_id", "caller_name", "caller_file_id", "line", "confidence")


def callees(calls: DataFrame, symbols: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Every call with its callee, unresolved ones too; their line is that of the call."""
    s = symbols.select(F.col("id").alias("callee_symbol_id"), F.col("line").alias("declared")).distinct()
    hit = calls.where(F.col("confidence") >= min_confidence).join(s, "callee_symbol_id", "left")
    return hit.select("caller_symbol_id", "callee_name", "callee_symbol_id", F.coalesce("declared", "line").alias("line"), "confidence")


def knowledge_gaps(symbols: DataFrame, files: DataFrame, calls: DataFrame, percentile: float = 0.9, limit: int | None = 25) -> DataFrame:
    """Functions of high-ranking files that no test calls directly: id, name, path, line, pagerank, callers.

    The cutoff is the rank at position floor(n * percentile) of the files with symbols, ascending. It
    is found by counting ranks, not by numbering all files in one task.
    """
    f = files.select("id", "path", "pagerank", "symbol_count").distinct()
    ranks = f.where("symbol_count > 0").groupBy("pagerank").agg(F.count(F.lit(1)).alias("n"))
    cutoff = nth_value(ranks, "pagerank", "n", lambda n: min(n - 1, int(n * percentile)))
    if cutoff is None:
        cutoff = float("inf")
    hot = f.where(F.col("pagerank") >= cutoff).select(F.col("id").alias("file_id"), "path", "pagerank")
    s = symbols.where(F.col("kind").isin("function", "method")).select("id", "file_id", "name", "line").distinct().join(hot, "file_id")
    who = symbols.select(F.col("id").alias("caller_symbol_id"), F.col("file_id").alias("cf")).distinct().join(f.select(F.col("id").alias("cf"), F.col("path").alias("cp")), "cf")
    made = calls.where((F.col("confidence") >= 0.7) & F.col("callee_symbol_id").isNotNull()).join(who, "caller_symbol_id")
    per = made.groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.max(is_test_path(F.col("cp"))).alias("tested"))
    out = s.join(per, "id", "left").where("not coalesce(tested, false)").select("id", "name", "path", "line", "pagerank", F.coalesce("callers", F.lit(0)).alias("callers"))
    return out.orderBy(F.desc("pagerank"), F.desc("callers"), "path", "line", "id").limit(limit) if limit else out


def nth_value(counts: DataFrame, value: str, n: str, position) -> object:
    """The value at 0-based ``position(total)`` of the ascending values whose counts are given.

    Values are halved by approximate medians until few are left, so none are numbered in one task."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total == 0:
        return None
    at, rows = position(int(total)), counts.where(F.col(value).isNotNull())
    while True:
        if rows.limit(20_001).count() <= 20_000:
            for r in rows.orderBy(value).collect():
                at -= r[n]
                if at < 0:
                    return r[value]
            return None
        middle = rows.stat.approxQuantile(value, [0.5], 0.05)[0]
        low = rows.where(F.col(value) <= middle)
        held = low.agg(F.sum(n)).first()[0] or 0
        if at < held:
            rows = low
        else:
            rows, at = rows.where(F.col(value) > middle), at - held


def symbol_references(refs: DataFrame, calls: DataFrame, symbols: DataFrame, files: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """Where a name is imported, called, or exported again from a barrel: kind, file_id, line."""
    imports = refs.where(F.col("name") == name).select(F.lit("import").alias("kind"), "file_id", F.lit(None).cast("int").alias("line"))
    s = symbols.select(F.col("id").alias("caller_symbol_id"), "file_id").distinct()
    made = calls.where(F.col("callee_name") == name).join(s, "caller_symbol_id").select(F.lit("call").alias("kind"), "file_id", "line")
    barrels = files.where("is_barrel").select(F.col("id").alias("file_id")).distinct()
    again = refs.where(F.col("name") == name).join(barrels, "file_id", "left_semi").select(F.lit("re-export").alias("kind"), "file_id", F.lit(None).cast("int").alias("line"))
    out = imports.unionByName(made).unionByName(again).distinct()
    return out.orderBy("kind", "file_id", "line").limit(limit) if limit else out


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """``id, score`` of the symbols whose name, path and kind together hold every word of the query, best BM25 first. Words are
    runs of letters and digits in any case; one that ends in ``*`` is the beginning of a word. A query with an odd number of double
    quotes, or without words, finds nothing."""
    words = re.findall(r"([a-z0-9]+)(\*?)", query.lower())
    base = symbols.select("id", "file_id", "name", "kind").distinct().join(files.select(F.col("id").alias("file_id"), "path").distinct(), "file_id")
    if not words or query.count('"') % 2:
        return base.select("id", F.lit(0.0).alias("score")).limit(0)
    base = base.select("id", F.filter(F.split(F.lower(F.concat_ws(" ", "name", "path", "kind")), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    count = lambda q, star: F.size(F.filter("w", lambda x: x.startswith(q) if star else x == q))
    counted = stored(base.select("id", F.size("w").alias("n"), *(count(q, star).alias(f"t{i}") for i, (q, star) in enumerate(words))), "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * 2.2 / (F.col(f"t{i}") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    out = counted.where(" and ".join(f"t{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def signature_at(symbols: DataFrame, files: DataFrame, path: str, line: int) -> DataFrame:
    """The symbol at a line of a path: id, name, kind, signature."""
    f = files.where(F.col("path") == path).select(F.col("id").alias("file_id")).distinct()
    return symbols.join(f, "file_id").where(F.col("line") == line).select("id", "name", "kind", "signature").distinct()


def unused_exports(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Exported symbols whose name no resolved reference has."""
    used = refs.where("source_file_id is not null").select("name").distinct()
    return symbols.where("is_exported").join(used, "name", "left_anti")


def orphan_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that nothing imports, neither barrels nor tests."""
    held = edges.select(F.col("target_file_id").alias("id")).distinct()
    return files.where(~F.col("is_barrel") & ~is_test_like(F.col("path"))).join(held, "id", "left_anti")


def external_packages(imports: DataFrame) -> DataFrame:
    """Per package the number of files that import it and the specifiers named: package, files, specifiers."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.split("specifiers", ","), F.trim)))))
    return imports.groupBy("package").agg(F.countDistinct("file_id").alias("files"), parts.alias("specifiers"))


def duplicate_shapes(shapes: DataFrame) -> DataFrame:
    """The places of shapes (file_id, name, line, shape_hash, node_count) that occur more than once: shape_hash, copies, node_count,
    file_id, name, line. A row a place, as a shape may have any number of them."""
    sizes = shapes.where("shape_hash is not null").groupBy("shape_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("node_count").alias("node_count")).where("copies > 1")
    return shapes.drop("node_count").join(sizes, "shape_hash").select("shape_hash", "copies", "node_count", "file_id", "name", "line")


def rendered_map(files: DataFrame, symbols: DataFrame, top: int = 20, each: int = 5) -> DataFrame:
    """Text of the top files with their first symbols: path, text."""
    best = files.select("id", "path", "pagerank").distinct().orderBy(F.desc("pagerank"), "path").limit(top)
    s = symbols.select("id", "file_id", "name", "kind", "line").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "id"))).where(F.col("nth") <= each)
    per = s.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("  "), "kind", F.lit(" "), "name").alias("t")))).alias("l"))
    return best.join(per, "id", "left").select("path", "pagerank", F.concat_ws("\n", "path", F.array_join(F.col("l.t"), "\n")).alias("text"))


def health(stats: DataFrame) -> DataFrame:
    """Whether a built graph is plausible: many files and symbols without any edge and call are not."""
    bad = (F.col("files") >= 50) & (F.col("symbols") >= 500) & (F.col("edges") == 0) & (F.col("calls") == 0)
    return stats.withColumn("healthy", ~bad)


def question_candidates(surprises: DataFrame, bridges: DataFrame, untested: DataFrame, flows: DataFrame, each: int = 2) -> DataFrame:
    """``kind, nth, text, score, path, other``: the first ``each`` of every kind, by their ``nth``.

    ``surprises`` and ``bridges`` are nth, src, dst (paths), weight; ``untested`` nth, name, path, pagerank; ``flows`` nth, entry_name, entry_kind,
    entry_path, weight, steps, last_name, last_path, of which those of three steps or more count."""
    base = lambda c: F.regexp_replace(c, r"^.*[/\\\\]", "")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    kinds = {
        "surprise": (surprises, F.concat(F.lit("Why does "), tick(base(F.col("src"))), F.lit(" call "), tick(base(F.col("dst"))), F.lit("? It looks like an out-of-module dependency.")), 1 - squash(F.col("weight")), "src", "dst"),
        "bridge": (bridges, F.concat(tick(base(F.col("src"))), F.lit(" is a bridge between modules — what blast radius would breaking it cause?")), squash(F.col("weight")), "src", "dst"),
        "untested": (untested, F.concat(tick(F.col("name")), F.lit(" in "), tick(base(F.col("path"))), F.lit(" is a high-PageRank symbol with no tests — should we add coverage?")), clamp(F.col("pagerank")), "path", None),
        "flow": (flows.where("steps >= 3"), F.concat(F.lit("Walk me through the "), tick(F.col("entry_name")), F.lit(" "), F.col("entry_kind"), F.lit(" flow (ends in "), tick(F.col("last_name")), F.lit(").")), clamp(F.col("weight")), "entry_path", "last_path"),
    }
    out = None
    for kind, (df, text, score, path, other) in kinds.items():
        one = df.orderBy("nth").limit(each).select(F.lit(kind).alias("kind"), F.col("nth").cast("long").alias("nth"), text.alias("text"), score.cast("double").alias("score"), F.col(path).alias("path"), (F.col(other) if other else F.lit(None).cast("string")).alias("other"))
        out = one if out is None else out.unionByName(one)
    return out


def suggested_questions(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """``kind, text, score, path`` of candidates, each text once, best score first, then by path and text."""
    best = Window.partitionBy("text").orderBy(F.desc("score"), "path")
    once = candidates.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return once.select("kind", "text", "score", "path").orderBy(F.desc("score"), "path", "text").limit(limit)


def symbol_radius(calls: DataFrame, symbols: DataFrame, name: str, max_depth: int = 5) -> DataFrame:
    """``id, depth`` of the symbols that call the first symbol of a name (that of the least id), directly or through others; who calls
    a symbol is told by its name alone."""
    s = symbols.select("id", "name").where("id is not null").distinct()
    root = s.where(F.col("name") == name).agg(F.min("id").alias("node")).where("node is not null")
    back = calls.select(F.col("caller_symbol_id").alias("dst"), F.col("callee_name").alias("name")).join(s, "name").select(F.col("id").alias("src"), "dst")
    return reach(back, root, max_depth).where("depth > 0").select(F.col("node").alias("id"), "depth")


def call_cycles(calls: DataFrame, symbols: DataFrame, limit: int | None = 20) -> DataFrame:
    """Cycles of calls: cycle, nth, id, length. Symbols that call each other in a ring form groups; of every group the shortest ring
    through its least symbol is given, of equal ones that of the lesser steps from the end back, and begins and ends with it. A callee is
    found by name and file. Groups come by their least symbol, the first ``limit``."""
    s = symbols.select("id", F.col("name").alias("callee_name"), F.col("file_id").alias("callee_file_id")).where("id is not null").distinct()
    e = calls.where("caller_symbol_id is not null").join(s, ["callee_name", "callee_file_id"]).select(F.col("caller_symbol_id").alias("src"), F.col("id").alias("dst")).distinct()
    e = stored(e, "calls")
    loops = e.where("src = dst").select("src")
    comp = strong_components(e)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("root"))
    rings = sizes.join(loops.select(F.col("src").alias("root")), "root", "left_semi").select("component", "root").union(sizes.where("n > 1").select("component", "root")).distinct()
    if limit:
        rings = rings.orderBy("root").limit(limit)
    rings = stored(rings, "rings")
    c = comp.join(rings.select("component"), "component", "left_semi")
    inner = e.join(c.select(F.col("node").alias("src"), "component"), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst").where("component = _c")
    inner = stored(inner.select("component", "src", "dst"), "inner")
    depth = stored(reach(inner, rings.select("component", F.col("root").alias("node")), keys=["component"]), "depths")
    # back from the root: the nearest symbol that calls it, then ever nearer ones
    last = inner.join(rings, "component").where("dst = root").join(depth.withColumnRenamed("node", "src"), ["component", "src"])
    at = stored(last.groupBy("component", "root").agg(F.min(F.struct("depth", "src")).alias("m")).select("component", "root", F.col("m.src").alias("node"), F.col("m.depth").alias("depth"), (F.col("m.depth") + 2).alias("length")), "ends")
    steps = at.select("root", (F.col("depth") + 1).alias("nth"), "node", "length").union(at.select("root", F.col("depth") + 2, "root", "length"))
    while at.where("depth > 0").limit(1).count():
        before = at.where("depth > 0").join(inner, (at.component == inner.component) & (at.node == inner.dst)).select(at.component, "root", "src", F.col("depth").alias("_d"), "length")
        before = before.join(depth.select("component", F.col("node").alias("src"), "depth"), ["component", "src"]).where("depth = _d - 1")
        at = stored(before.groupBy("component", "root", "depth", "length").agg(F.min("src").alias("node")), "ends")
        steps = steps.union(at.select("root", (F.col("depth") + 1).alias("nth"), "node", "length"))
    return steps.select(F.col("root").alias("cycle"), "nth", F.col("node").alias("id"), "length")
