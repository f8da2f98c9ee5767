"""Queries of the graph operators.

The index tables hold files and symbols; edges are taken from orders: parts follow one another in
an order's lines, so a part-to-part flow graph stands for the graph of imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators import graph_build as B
from skeinwork.operators import graph_query as Q
from skeinwork.operators.outline import outlines, references
from skeinwork.operators.rank import pagerank
from skeinwork.plans.index import TEXT_IMPORTS
from skeinwork.operators.traverse import change_impact, circular, dependencies_of, entry_kind, execution_flows, reach, strong_components, traverse
from skeinwork.functions.paths import is_test_like
from skeinwork.sources.tables import table


def part_flow(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, n: how often a part is followed by another in the lines of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return steps.where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


FLOW = """
flow AS (SELECT src, dst, count(*) AS n FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
         WHERE dst IS NOT NULL GROUP BY 1, 2)"""


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return part_flow(spark, d).select("src", "dst", (F.col("n") * F.log(F.lit(2.0))).alias("weight"))


def edges_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.lead("l_partkey").over(w).alias("source_file_id"))
    e = B.weighted_edges(steps)
    return e.select("source_file_id", "target_file_id", F.round("weight", 9).alias("weight"), B.confidence_tier(F.col("confidence")).alias("tier"))


EDGES_WEIGHTED = f"WITH {FLOW} SELECT src AS source_file_id, dst AS target_file_id, round(n * ln(2), 9) AS weight, 'EXTRACTED' AS tier FROM flow"


def part_ranks(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return pagerank(nodes, _weighted(spark, d)).select("node", F.round("rank", 10).alias("rank"))


def _rank_sql() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT p_partkey AS node, 1.0 / (SELECT count(*) FROM part) AS rank FROM part)"]
    for k in range(20):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT p_partkey AS node, 0.15 / (SELECT count(*) FROM part) + 0.85 * coalesce(g, 0) AS rank FROM part LEFT JOIN (SELECT dst, sum(rank * n / out) AS g FROM w JOIN r{k} ON r{k}.node = w.src GROUP BY dst) ON dst = p_partkey)")
    return f"WITH {FLOW}, w AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src) AS out FROM flow), {', '.join(steps)} SELECT node, round(rank, 10) AS rank FROM r20"


def impact_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the three dearest parts, two steps back."""
    seeds = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.col("p_partkey").alias("node"))
    return change_impact(part_flow(spark, d), seeds, 2)


IMPACT_OF_PARTS = f"""
WITH {FLOW}, seeds AS (SELECT p_partkey AS node FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3),
d1 AS (SELECT DISTINCT src AS node FROM flow WHERE dst IN (FROM seeds) AND src <> dst AND src NOT IN (FROM seeds)),
d2 AS (SELECT DISTINCT src AS node FROM flow WHERE dst IN (FROM d1) AND src NOT IN (FROM seeds) AND src NOT IN (FROM d1))
SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2
"""


def rare_flow(spark: SparkSession, d: str) -> DataFrame:
    """The flow between parts of one brand, a small part of all edges: sparse enough for the SQL of an all-pairs closure.
    The queries of the whole flow are those named ``..._all``."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    e = part_flow(spark, d).join(p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("a")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("b")), "dst")
    return e.where("a = b").select("src", "dst", "n")


RARE = f"{FLOW}, rare AS (SELECT src, dst, n FROM flow JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand = b.p_brand)"
#: The whole flow, under the name by which the SQL of the queries knows its edges.
WHOLE = f"{FLOW}, rare AS (SELECT src, dst, n FROM flow)"


def _radius(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    seeds = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_partkey").alias("node"))
    return dependencies_of(e, seeds)


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return _radius(spark, d, rare_flow(spark, d))


def blast_radius_all(spark: SparkSession, d: str) -> DataFrame:
    return _radius(spark, d, part_flow(spark, d))


BLAST_RADIUS = f"""
WITH RECURSIVE {RARE}, seeds AS (SELECT p_partkey AS node FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
walk AS (SELECT node AS seed, node FROM seeds UNION SELECT seed, dst FROM walk JOIN rare ON src = node)
SELECT seed AS node, count(*) - 1 AS radius FROM walk GROUP BY seed
"""
BLAST_RADIUS_ALL = BLAST_RADIUS.replace(RARE, WHOLE)


def part_walk(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first from the first part, within a budget of characters."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    e = part_flow(spark, d).select("src", "dst", F.when(F.col("n") > 1, 1.0).otherwise(0.7).alias("confidence"))
    return traverse(e, 1, p, "both", 2, 100, 900, 0.7)


PART_WALK = f"""
WITH {FLOW}, e AS (SELECT src, dst FROM flow WHERE src <> dst UNION SELECT dst, src FROM flow WHERE src <> dst),
d1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 1), d2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (FROM d1) AND dst <> 1 AND dst NOT IN (FROM d1)),
m AS (SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2),
c AS (SELECT node, depth, length(p_name) + length(p_brand) AS cost FROM m JOIN part ON p_partkey = node),
n AS (SELECT *, row_number() OVER (ORDER BY depth, node) AS nth, CAST(sum(cost) OVER (ORDER BY depth, node) AS BIGINT) AS tokens FROM c)
SELECT node, depth, cost, nth, tokens, (SELECT count(*) FROM n) > (SELECT count(*) FROM n WHERE nth <= 100 AND tokens <= 900) AS truncated FROM n WHERE nth <= 100 AND tokens <= 900
"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") < 10, "main").when(F.col("p_size") < 20, "handler").when(F.col("p_size") < 30, "test").otherwise("export")
    return p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_retailprice").alias("weight"))


def _confident(e: DataFrame) -> DataFrame:
    return e.withColumn("confidence", F.when(F.col("n") > 1, 1.0).otherwise(0.7))


def flows_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return execution_flows(_entries(spark, d), _confident(rare_flow(spark, d)), 3, 5)


def flows_of_parts_all(spark: SparkSession, d: str) -> DataFrame:
    """As many flows, and as deep, as the operator gives by itself."""
    return execution_flows(_entries(spark, d), _confident(part_flow(spark, d)))


FLOWS_OF_PARTS = f"""
WITH {RARE}, e AS (SELECT src, dst FROM rare WHERE src <> dst),
k AS (SELECT p_partkey AS entry, CASE WHEN p_size < 10 THEN 'main' WHEN p_size < 20 THEN 'handler' WHEN p_size < 30 THEN 'test' ELSE 'export' END AS kind, p_retailprice AS weight,
   CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS o, p_name FROM part),
t AS (SELECT * FROM k ORDER BY weight DESC, o, p_name, entry LIMIT 5),
a0 AS (SELECT entry, entry AS node FROM t), a1 AS (SELECT DISTINCT entry, dst AS node FROM a0 JOIN e ON src = node EXCEPT FROM a0),
a2 AS (SELECT DISTINCT entry, dst AS node FROM a1 JOIN e ON src = node EXCEPT FROM a0 EXCEPT FROM a1),
a3 AS (SELECT DISTINCT entry, dst AS node FROM a2 JOIN e ON src = node EXCEPT FROM a0 EXCEPT FROM a1 EXCEPT FROM a2),
s AS (SELECT *, 0 AS depth FROM a0 UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3)
SELECT s.entry, kind, weight, node, depth, max(depth) OVER (PARTITION BY s.entry) >= 3 AS truncated FROM s JOIN t ON t.entry = s.entry
"""
FLOWS_OF_PARTS_ALL = f"""
WITH {FLOW}, e AS (SELECT src, dst FROM flow WHERE src <> dst),
k AS (SELECT p_partkey AS entry, CASE WHEN p_size < 10 THEN 'main' WHEN p_size < 20 THEN 'handler' WHEN p_size < 30 THEN 'test' ELSE 'export' END AS kind, p_retailprice AS weight,
   CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS o, p_name FROM part),
t AS (SELECT * FROM k ORDER BY weight DESC, o, p_name, entry LIMIT 25),
a0 AS (SELECT entry, entry AS node FROM t), a1 AS (SELECT DISTINCT entry, dst AS node FROM a0 JOIN e ON src = node EXCEPT FROM a0),
a2 AS (SELECT DISTINCT entry, dst AS node FROM a1 JOIN e ON src = node EXCEPT FROM a0 EXCEPT FROM a1),
a3 AS (SELECT DISTINCT entry, dst AS node FROM a2 JOIN e ON src = node EXCEPT FROM a0 EXCEPT FROM a1 EXCEPT FROM a2),
a4 AS (SELECT DISTINCT entry, dst AS node FROM a3 JOIN e ON src = node EXCEPT FROM a0 EXCEPT FROM a1 EXCEPT FROM a2 EXCEPT FROM a3),
s AS (SELECT *, 0 AS depth FROM a0 UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3 UNION ALL SELECT *, 4 FROM a4)
SELECT s.entry, kind, weight, node, depth, max(depth) OVER (PARTITION BY s.entry) >= 4 AS truncated FROM s JOIN t ON t.entry = s.entry
"""


def _cycle_sizes(e: DataFrame) -> DataFrame:
    return strong_components(e).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def part_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _cycle_sizes(rare_flow(spark, d))


def part_cycles_all(spark: SparkSession, d: str) -> DataFrame:
    return _cycle_sizes(part_flow(spark, d))


PART_CYCLES = f"""
WITH RECURSIVE {RARE}, v AS (SELECT src AS n FROM rare UNION SELECT dst FROM rare),
walk AS (SELECT n AS a, n AS b FROM v UNION SELECT a, dst FROM walk JOIN rare ON src = b),
c AS (SELECT x.a, max(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS components FROM s GROUP BY 1
"""


def _circular(e: DataFrame) -> DataFrame:
    return circular(e, None).select("component", "size", F.array_join("members", ",").alias("members"))


def circular_parts(spark: SparkSession, d: str) -> DataFrame:
    return _circular(rare_flow(spark, d))


def circular_parts_all(spark: SparkSession, d: str) -> DataFrame:
    return _circular(part_flow(spark, d))


CIRCULAR_PARTS = f"""
WITH RECURSIVE {RARE}, v AS (SELECT src AS n FROM rare UNION SELECT dst FROM rare),
walk AS (SELECT n AS a, n AS b FROM v UNION SELECT a, dst FROM walk JOIN rare ON src = b),
c AS (SELECT x.a, max(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT component, count(*) AS size, string_agg(a, ',' ORDER BY a) AS members FROM c GROUP BY 1 HAVING count(*) > 1 OR max(a) IN (SELECT src FROM rare WHERE src = dst)
"""


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    files, symbols = table(spark, d, "files").distinct(), table(spark, d, "symbols").distinct()
    return Q.health(Q.graph_stats(files=files, symbols=symbols, edges=part_flow(spark, d), calls=table(spark, d, "chunks").select("id").distinct()))


INDEX_STATS = f"""
WITH {FLOW} SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM files)) AS files, (SELECT count(*) FROM (SELECT DISTINCT * FROM symbols)) AS symbols, (SELECT count(*) FROM flow) AS edges,
 (SELECT count(DISTINCT id) FROM chunks) AS calls, NOT ((SELECT count(DISTINCT id) FROM files) >= 50 AND (SELECT count(DISTINCT id) FROM symbols) >= 500 AND (SELECT count(*) FROM flow) = 0 AND (SELECT count(*) FROM chunks) = 0) AS healthy
"""


def best_files(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_files(table(spark, d, "files").distinct()).select("id", "path", "pagerank")


BEST_FILES = "SELECT DISTINCT id, path, pagerank FROM files ORDER BY pagerank DESC, path LIMIT 20"


def found_symbols(spark: SparkSession, d: str) -> DataFrame:
    return Q.find_symbols(table(spark, d, "symbols").distinct(), table(spark, d, "files").distinct(), "Load").select("id", "name", "path", "pagerank")


FOUND_SYMBOLS = """
SELECT s.id, s.name, f.path, f.pagerank FROM (SELECT DISTINCT * FROM symbols) s JOIN (SELECT DISTINCT id, path, pagerank FROM files) f ON f.id = s.file_id
WHERE contains(lower(s.name), 'load') ORDER BY f.pagerank DESC, f.path, s.line, s.id LIMIT 50
"""


def file_outlines(spark: SparkSession, d: str) -> DataFrame:
    m = Q.rendered_map(table(spark, d, "files"), table(spark, d, "symbols"))
    return m.select("path", F.col("text"))


FILE_OUTLINES = """
WITH f AS (SELECT DISTINCT id, path, pagerank FROM files ORDER BY pagerank DESC, path LIMIT 20),
s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, id) AS nth FROM (SELECT DISTINCT id, file_id, name, kind, line FROM symbols)),
l AS (SELECT file_id, string_agg('  ' || kind || ' ' || name, chr(10) ORDER BY nth) AS t FROM s WHERE nth <= 5 GROUP BY 1)
SELECT path, concat_ws(chr(10), path, t) AS text FROM f LEFT JOIN l ON l.file_id = f.id
"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """A call of a symbol by the one before it in its file, tagged by line distance."""
    s = table(spark, d, "symbols").where("lower(kind) in ('function', 'method')").select("id", "file_id", "name", "line").distinct()
    w = Window.partitionBy("file_id").orderBy("line", "id")
    c = s.select(F.col("id").alias("caller_symbol_id"), F.lead("id").over(w).alias("callee_symbol_id"), F.lead("name").over(w).alias("callee_name"), F.col("file_id").alias("callee_file_id"), "line", F.when(F.pmod("line", F.lit(3)) == 0, 0.4).when(F.pmod("line", F.lit(3)) == 1, 0.7).otherwise(1.0).alias("confidence"))
    return c.where("callee_symbol_id is not null")


_CALLS = """
fn AS (SELECT DISTINCT id, file_id, name, line FROM symbols WHERE lower(kind) IN ('function', 'method')),
calls AS (SELECT * FROM (SELECT id AS caller_symbol_id, lead(id) OVER w AS callee_symbol_id, lead(name) OVER w AS callee_name, file_id AS callee_file_id, line,
  CASE line % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.7 ELSE 1.0 END AS confidence FROM fn WINDOW w AS (PARTITION BY file_id ORDER BY line, id)) WHERE callee_symbol_id IS NOT NULL)"""


def untested_hotspots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").withColumn("kind", F.lower("kind")).distinct()
    return Q.knowledge_gaps(s, table(spark, d, "files"), _calls(spark, d), 0.5, None).select("id", "pagerank", "callers")


UNTESTED_HOTSPOTS = f"""
WITH {_CALLS}, f AS (SELECT DISTINCT id, path, pagerank, symbol_count FROM files),
r AS (SELECT pagerank, row_number() OVER (ORDER BY pagerank) - 1 AS k, count(*) OVER () AS n FROM f WHERE symbol_count > 0),
cut AS (SELECT pagerank AS c FROM r WHERE k = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))),
p AS (SELECT callee_symbol_id AS id, count(*) AS callers, max(regexp_matches(f.path, '\\.test\\.|_test\\.|\\.spec\\.')) AS tested FROM calls JOIN (SELECT DISTINCT id, file_id FROM symbols) s ON s.id = caller_symbol_id JOIN f ON f.id = s.file_id WHERE confidence >= 0.7 GROUP BY 1)
SELECT fn.id, f.pagerank, coalesce(callers, 0) AS callers FROM fn JOIN f ON f.id = fn.file_id LEFT JOIN p ON p.id = fn.id WHERE f.pagerank >= (SELECT c FROM cut) AND NOT coalesce(tested, false)
"""


def who_calls(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").distinct()
    target = s.where("is_exported").select("id", "file_id", "name")
    up = Q.callers(_calls(spark, d), s, target, 0.7).select(F.lit("caller").alias("side"), F.col("target_id").alias("symbol"), F.col("caller_symbol_id").alias("other"), "line")
    down = Q.callees(_calls(spark, d), s, 0.7).select(F.lit("callee").alias("side"), F.col("caller_symbol_id").alias("symbol"), F.col("callee_symbol_id").alias("other"), "line")
    return up.union(down)


WHO_CALLS = f"""
WITH {_CALLS}, s AS (SELECT DISTINCT id, file_id, name, line, is_exported FROM symbols)
SELECT 'caller' AS side, s.id AS symbol, caller_symbol_id AS other, calls.line FROM calls JOIN s ON s.name = callee_name AND (callee_file_id IS NULL OR callee_file_id = s.file_id) WHERE is_exported AND confidence >= 0.7
UNION ALL SELECT 'callee', caller_symbol_id, callee_symbol_id, coalesce(s.line, calls.line) FROM calls LEFT JOIN s ON s.id = callee_symbol_id WHERE confidence >= 0.7
"""


def lonely_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("id", "path", "line_count", "is_barrel").distinct()
    edges = B.test_edges(files).unionByName(B.rescue_edges(files, B.test_edges(files), spark.createDataFrame([], "file_id_a long, file_id_b long, count long")))
    return Q.orphan_files(files, edges).select("id", "line_count")


_TESTED = "regexp_replace(regexp_replace(regexp_replace(path, '\\.test\\.', '.'), '_test\\.', '.'), '\\.spec\\.', '.')"
LONELY_FILES = f"""
WITH f AS (SELECT DISTINCT id, path, line_count, is_barrel, regexp_replace(path, '/?[^/]*$', '') AS folder, path ILIKE '%.test.%' OR path ILIKE '%_test.%' OR path ILIKE '%.spec.%' AS test FROM files),
t AS (SELECT b.id FROM (SELECT *, {_TESTED} AS goal FROM f WHERE test) a JOIN f b ON b.path = a.goal WHERE a.path <> a.goal),
lone AS (SELECT * FROM f WHERE NOT is_barrel AND id NOT IN (FROM t)), good AS (SELECT DISTINCT folder FROM f WHERE id IN (FROM t)),
saved AS (SELECT id FROM lone WHERE folder <> '' AND EXISTS (SELECT 1 FROM good WHERE good.folder = lone.folder OR starts_with(good.folder, lone.folder || '/')))
SELECT id, line_count FROM f WHERE NOT is_barrel AND NOT test AND id NOT IN (FROM t) AND id NOT IN (FROM saved)
"""


def import_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that script texts import, with the file each import resolves to, if any."""
    refs = _refs(spark, d)
    files = table(spark, d, "files").select("id", "path").distinct()
    return refs.drop("source_file_id").join(B.resolve_imports(refs, files), ["file_id", "import_source"], "left").select("file_id", "name", "import_source", "target_file_id")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return references(outlines(table(spark, d, "files"), table(spark, d, "source_texts")))


IMPORT_NAMES = """
WITH i AS (TEXT_IMPORTS), r AS (SELECT DISTINCT file_id, name, source AS import_source FROM i),
f AS (SELECT DISTINCT id, path FROM files), b AS (SELECT r.*, regexp_replace(path, '[^/]*$', '') || substr(import_source, 3) AS base FROM r JOIN f ON f.id = file_id),
e AS (SELECT *, unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.rs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS ending, generate_subscripts(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.rs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], 1) AS nth FROM b),
h AS (SELECT file_id, import_source, arg_min(f.id, nth) AS target FROM e JOIN f ON f.path = base || ending GROUP BY 1, 2)
SELECT r.file_id, r.name, r.import_source, target AS target_file_id FROM r LEFT JOIN h ON h.file_id = r.file_id AND h.import_source = r.import_source
"""


def import_use(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose body names what their file imports."""
    refs = _refs(spark, d).withColumn("source_file_id", F.lit(None).cast("long"))
    lines = table(spark, d, "source_texts").select("file_id", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).select("file_id", (F.col("at") + 1).alias("line"), "text")
    s = table(spark, d, "symbols").withColumn("kind", F.lower("kind"))
    return B.call_graph(s, refs, lines).select("caller_symbol_id", "callee_name", "line", "confidence", "tier")


IMPORT_USE = """
WITH i AS (TEXT_IMPORTS), r AS (SELECT DISTINCT file_id, name FROM i),
l AS (SELECT file_id, unnest(regexp_split_to_array(content, '\\r?\\n')) AS text, generate_subscripts(regexp_split_to_array(content, '\\r?\\n'), 1) AS line FROM source_texts),
s AS (SELECT DISTINCT id, file_id, name, line, end_line FROM symbols WHERE lower(kind) IN ('function', 'method'))
SELECT s.id AS caller_symbol_id, r.name AS callee_name, min(l.line) AS line, 0.7 AS confidence, 'INFERRED' AS tier FROM s JOIN r ON r.file_id = s.file_id AND r.name <> s.name JOIN l ON l.file_id = s.file_id AND l.line BETWEEN s.line AND s.end_line
WHERE regexp_matches(l.text, '\\b' || r.name || '\\b') GROUP BY 1, 2
"""


def unused_symbols(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d).withColumn("source_file_id", F.col("file_id"))
    return Q.unused_exports(table(spark, d, "symbols").distinct(), refs).select("id")


UNUSED_SYMBOLS = """
WITH i AS (TEXT_IMPORTS) SELECT DISTINCT id FROM symbols WHERE is_exported AND name NOT IN (SELECT name FROM i)
"""


def packages_used(spark: SparkSession, d: str) -> DataFrame:
    e = _refs(spark, d).groupBy(F.col("import_source").alias("package"), "file_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("specifiers"))
    return Q.external_packages(e).select("package", "files", F.array_join("specifiers", ",").alias("specifiers"))


PACKAGES_USED = """
WITH i AS (TEXT_IMPORTS), r AS (SELECT DISTINCT file_id, name, source AS p FROM i)
SELECT p AS package, count(DISTINCT file_id) AS files, string_agg(DISTINCT name, ',' ORDER BY name) AS specifiers FROM r GROUP BY 1
"""


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("lower(kind) in ('function', 'method')").select("id", "file_id", "name", "is_exported").distinct()
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct()
    return s.join(f, "file_id").select("id", entry_kind(F.col("name"), is_test_like(F.col("path")), F.col("is_exported")).alias("kind")).where("kind is not null")


ENTRY_POINTS = """
WITH s AS (SELECT DISTINCT s.id, s.name, s.is_exported, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE lower(s.kind) IN ('function', 'method')),
k AS (SELECT id, CASE WHEN name IN ('main', 'run') THEN 'main' WHEN path ILIKE '%.test.%' OR path ILIKE '%_test.%' OR path ILIKE '%.spec.%' THEN 'test'
  WHEN regexp_matches(name, '(?i)^(handle[A-Z_]|route|get|post|put|delete|patch)') OR ends_with(name, 'Handler') THEN 'handler' WHEN is_exported THEN 'export' END AS kind FROM s)
SELECT * FROM k WHERE kind IS NOT NULL
"""


def part_reach(spark: SparkSession, d: str) -> DataFrame:
    return reach(part_flow(spark, d), spark.createDataFrame([(1,)], "node long"), 3)


PART_REACH = f"""
WITH RECURSIVE {FLOW}, w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN flow ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY 1
"""

IMPORT_NAMES, IMPORT_USE, UNUSED_SYMBOLS, PACKAGES_USED = (q.replace("TEXT_IMPORTS", TEXT_IMPORTS.strip()) for q in (IMPORT_NAMES, IMPORT_USE, UNUSED_SYMBOLS, PACKAGES_USED))
QUERIES = {f.__name__: f for f in (edges_weighted, part_ranks, impact_of_parts, blast_radius, blast_radius_all, part_walk, flows_of_parts, flows_of_parts_all, part_cycles, part_cycles_all, circular_parts, circular_parts_all, index_stats, best_files, found_symbols, file_outlines, untested_hotspots, who_calls, lonely_files, import_names, import_use, unused_symbols, packages_used, entry_points, part_reach)}
SQL = {
    "edges_weighted": EDGES_WEIGHTED, "part_ranks": _rank_sql(), "impact_of_parts": IMPACT_OF_PARTS, "blast_radius": BLAST_RADIUS, "part_walk": PART_WALK, "flows_of_parts": FLOWS_OF_PARTS, "part_cycles": PART_CYCLES,
    "circular_parts": CIRCULAR_PARTS, "index_stats": INDEX_STATS, "best_files": BEST_FILES, "found_symbols": FOUND_SYMBOLS, "file_outlines": FILE_OUTLINES, "untested_hotspots": UNTESTED_HOTSPOTS, "who_calls": WHO_CALLS,
    "lonely_files": LONELY_FILES, "import_names": IMPORT_NAMES, "import_use": IMPORT_USE, "unused_symbols": UNUSED_SYMBOLS, "packages_used": PACKAGES_USED, "entry_points": ENTRY_POINTS, "part_reach": PART_REACH,
    "blast_radius_all": BLAST_RADIUS_ALL, "flows_of_parts_all": FLOWS_OF_PARTS_ALL,
}
