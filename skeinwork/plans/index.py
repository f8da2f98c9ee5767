"""Queries of the code graph's operators over a whole index.

The texts at hand import names that no other text declares, so their graph has hardly an edge. Suppliers
therefore stand for files, parts for the symbols in them, and the lines of orders for references, lines of code
and commits; what texts really import and declare is read by the queries on outlines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators import community as K
from skeinwork.operators import graph_build as B
from skeinwork.operators import graph_query as Q
from skeinwork.operators.cooccurrence import cooccurring
from skeinwork.operators.outline import outlines
from skeinwork.sources.tables import table


class Index:
    """files, symbols, refs, lines and commits made of the tables of trade."""

    def __init__(self, spark: SparkSession, d: str):
        k, p = F.col("s_suppkey"), F.col("p_partkey")
        s = table(spark, d, "supplier")
        owners = max(1, s.count() * 4 // 5)
        self.files = s.select(
            k.alias("id"), F.concat(F.lit("src/d"), F.floor(k / 20).cast("string"), F.when(k % 25 == 0, F.concat(F.lit("/m"), k, F.lit("/index.ts"))).when(k % 10 == 3, F.concat(F.lit("/f"), k - 1, F.lit(".test.ts"))).otherwise(F.concat(F.lit("/f"), k, F.lit(".ts")))).alias("path"),
            (F.col("s_acctbal") / 10000).alias("pagerank"), (100 + k % 50).cast("int").alias("line_count"), F.lit(1).alias("symbol_count"), (k % 25 == 0).alias("is_barrel"),
        )
        kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "constant"))), F.col("p_size") % 4 + 1)
        home = lambda c: (F.pmod(c * 7, F.lit(owners)) + 1)
        name = lambda c: F.concat(F.lit("part_"), c)
        self.symbols = table(spark, d, "part").select(p.alias("id"), home(p).alias("file_id"), name(p).alias("name"), kind.alias("kind"), F.col("p_size").alias("line"), (F.col("p_size") + 10).alias("end_line"), (p % 3 == 0).alias("is_exported"))
        i = table(spark, d, "lineitem")
        part, file = F.col("l_partkey"), F.col("l_suppkey")
        self.refs = i.select(file.alias("file_id"), part.alias("p")).distinct().select(
            (F.col("file_id") * 1_000_000_000 + F.col("p")).alias("id"), "file_id", name(F.col("p")).alias("name"), F.concat(F.lit("./f"), home(F.col("p"))).alias("import_source"), F.when(F.col("p") % 2 == 1, home(F.col("p"))).alias("source_file_id"),
        )
        self.lines = i.select(file.alias("file_id"), (F.col("l_linenumber") * 10 + part % 10).cast("int").alias("line"), F.concat(F.lit("x = "), name(part), F.lit("(1)")).alias("text")).distinct()
        self.commits = i.select(F.col("l_orderkey").alias("commit"), file.alias("file_id")).distinct()

    def calls(self) -> DataFrame:
        return B.call_graph(self.symbols, B.resolve_refs(self.refs, self.symbols, self.files), self.lines)


_HOME = "(({} * 7) % (SELECT greatest(1, count(*) * 4 // 5) FROM supplier)) + 1"
INDEX = f"""
fi AS (SELECT s_suppkey AS id, 'src/d' || (s_suppkey // 20) || CASE WHEN s_suppkey % 25 = 0 THEN '/m' || s_suppkey || '/index.ts' WHEN s_suppkey % 10 = 3 THEN '/f' || (s_suppkey - 1) || '.test.ts' ELSE '/f' || s_suppkey || '.ts' END AS path,
  s_acctbal / 10000 AS pagerank, 100 + s_suppkey % 50 AS line_count, s_suppkey % 25 = 0 AS is_barrel FROM supplier),
sy AS (SELECT p_partkey AS id, {_HOME.format('p_partkey')} AS file_id, 'part_' || p_partkey AS name, ['function', 'method', 'class', 'constant'][p_size % 4 + 1] AS kind, p_size AS line, p_size + 10 AS end_line, p_partkey % 3 = 0 AS is_exported FROM part),
rf AS (SELECT DISTINCT l_suppkey AS file_id, l_partkey AS p, 'part_' || l_partkey AS name, {_HOME.format('l_partkey')} AS home FROM lineitem),
re AS (SELECT file_id, p, name, CASE WHEN p % 2 = 1 OR p IN (SELECT id FROM sy WHERE is_exported) THEN home END AS source_file_id FROM rf),
li AS (SELECT DISTINCT l_suppkey AS file_id, l_linenumber * 10 + l_partkey % 10 AS line, 'part_' || l_partkey AS name FROM lineitem),
ca AS (SELECT s.id AS caller_symbol_id, li.name AS callee_name, t.id AS callee_symbol_id, re.source_file_id AS callee_file_id, min(li.line) AS line FROM li JOIN re ON re.file_id = li.file_id AND re.name = li.name
  JOIN sy s ON s.file_id = li.file_id AND s.kind IN ('function', 'method') AND li.line BETWEEN s.line AND s.end_line AND s.name <> li.name LEFT JOIN sy t ON t.name = li.name AND t.is_exported AND t.file_id = re.source_file_id GROUP BY ALL),
ed AS (SELECT file_id AS src, source_file_id AS dst, count(*) * ln(2) AS weight FROM re WHERE source_file_id IS NOT NULL GROUP BY 1, 2),
co AS (SELECT a.f AS file_id_a, b.f AS file_id_b, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS f, count(DISTINCT l_suppkey) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS f FROM lineitem) b
  ON a.o = b.o AND a.f < b.f WHERE a.k BETWEEN 2 AND 20 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def refs_resolved(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    return B.resolve_refs(x.refs, x.symbols, x.files).select("file_id", "name", "source_file_id")


REFS_RESOLVED = f"WITH {INDEX} SELECT file_id, name, source_file_id FROM re"


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d).calls()


CODE_CALLS = f"WITH {INDEX} SELECT *, CASE WHEN callee_symbol_id IS NULL THEN 0.7 ELSE 1.0 END AS confidence, CASE WHEN callee_symbol_id IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS tier FROM ca"


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a full build: of references, of tests, and of the files rescued."""
    x = Index(spark, d)
    g = B.CodeGraph(x.files, x.symbols, x.refs, x.lines, x.commits)
    return g.edges.select("source_file_id", "target_file_id", F.round("weight", 9).alias("weight"), "confidence")


_BUILT = """
te AS (SELECT a.id AS src, b.id AS dst FROM fi a JOIN fi b ON b.path = replace(a.path, '.test.', '.') WHERE a.path LIKE '%.test.%'),
e2 AS (SELECT src, dst, weight, 1.0 AS confidence FROM ed WHERE (src, dst) NOT IN (SELECT (src, dst) FROM te) UNION ALL SELECT src, dst, 1.0, 1.0 FROM te),
lone AS (SELECT id, path FROM fi WHERE NOT is_barrel AND id NOT IN (SELECT dst FROM e2)),
bo AS (SELECT file_id_a AS id, file_id_b AS peer, n FROM co UNION ALL SELECT file_id_b, file_id_a, n FROM co),
to_ AS (SELECT id, arg_max(peer, (n, -peer)) AS peer FROM bo WHERE id IN (SELECT id FROM lone) AND peer NOT IN (SELECT id FROM lone) GROUP BY 1),
fo AS (SELECT l.id, min(f.id) AS peer FROM lone l JOIN fi f ON f.id IN (SELECT dst FROM e2) AND starts_with(f.path, regexp_replace(l.path, '/[^/]*$', '') || '/') WHERE l.id NOT IN (SELECT id FROM to_) GROUP BY 1),
fe AS (SELECT * FROM e2 UNION ALL SELECT peer, id, 0.5, 0.5 FROM to_ UNION ALL SELECT peer, id, 0.3, 0.3 FROM fo)"""
CODE_EDGES = f"WITH {INDEX}, {_BUILT} SELECT src AS source_file_id, dst AS target_file_id, round(weight, 9) AS weight, confidence FROM fe"


def code_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The edges after every 17th file was written anew, without its references to every fifth part, and every 19th removed."""
    x = Index(spark, d)
    g = B.CodeGraph(x.files, x.symbols, x.refs, x.lines, x.commits)
    new = lambda df, key="file_id": df.where((F.col(key) % 17 == 0) & (F.col(key) % 19 != 0))
    refs = new(x.refs).where(~F.col("name").rlike("[05]$"))
    after = g.changed(new(x.files, "id"), new(x.symbols), refs, new(x.lines), x.files.where("id % 19 = 0").select(F.col("id").alias("file_id")))
    return after.edges.select("source_file_id", "target_file_id", F.round("weight", 9).alias("weight"), "confidence")


CODE_REBUILT = f"""WITH {INDEX}, {_BUILT},
r2 AS (SELECT re.* FROM rf JOIN re USING (file_id, p) WHERE rf.file_id % 19 <> 0 AND NOT (rf.file_id % 17 = 0 AND rf.p % 5 = 0)),
r3 AS (SELECT file_id, CASE WHEN p % 2 = 1 THEN source_file_id WHEN p IN (SELECT id FROM sy WHERE is_exported AND file_id % 19 <> 0) THEN source_file_id END AS source_file_id FROM r2),
e3 AS (SELECT file_id AS src, source_file_id AS dst, count(*) * ln(2) AS weight, 1.0 AS confidence FROM r3 WHERE source_file_id IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT * FROM fe WHERE src % 19 <> 0 AND dst % 19 <> 0 AND (src, dst) NOT IN (SELECT (src, dst) FROM ed) AND (src, dst) NOT IN (SELECT (src, dst) FROM e3))
SELECT src AS source_file_id, dst AS target_file_id, round(weight, 9) AS weight, confidence FROM (SELECT * FROM kept UNION ALL SELECT * FROM e3)"""


def symbols_once(spark: SparkSession, d: str) -> DataFrame:
    return B.unique_symbols(table(spark, d, "symbols")).select("id", "file_id", "line", "name", "kind")


SYMBOLS_ONCE = "SELECT min(id) AS id, file_id, line, name, kind FROM symbols GROUP BY file_id, line, name, kind"


def files_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Which files are read anew if those of some symbol counts were known with an older time, and others not at all."""
    f = table(spark, d, "files")
    n = F.col("symbol_count")
    known = f.where(n % 7 != 3).select("path", F.when(n % 5 == 1, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"))
    new, same = B.indexed(f.select("id", "path", "mtime_ms"), known)
    return new.select("id", F.lit("changed").alias("state")).union(same.select("id", F.lit("same")))


FILES_INDEXED = "SELECT DISTINCT id, CASE WHEN symbol_count % 7 = 3 OR symbol_count % 5 = 1 THEN 'changed' ELSE 'same' END AS state FROM files"


def file_neighbours(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    e = B.weighted_edges(B.resolve_refs(x.refs, x.symbols, x.files))
    both = [Q.neighbours(e, x.files, 7, up).select(F.lit(side).alias("side"), "file_id", "path", F.round("weight", 9).alias("weight")) for side, up in (("dependent", True), ("dependency", False))]
    return both[0].union(both[1])


FILE_NEIGHBOURS = f"""WITH {INDEX} SELECT 'dependent' AS side, src AS file_id, path, round(weight, 9) AS weight FROM ed JOIN fi ON fi.id = src WHERE dst = 7
UNION ALL SELECT 'dependency', dst, path, round(weight, 9) FROM ed JOIN fi ON fi.id = dst WHERE src = 7"""


def file_changed_with(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    c = cooccurring(x.commits, "commit", "file_id").select(F.col("item_a").alias("file_id_a"), F.col("item_b").alias("file_id_b"), F.col("together").alias("count"))
    return Q.changed_with(c, x.files, 7)


FILE_CHANGED_WITH = f"""WITH {INDEX}, p AS (SELECT CASE WHEN file_id_a = 7 THEN file_id_b ELSE file_id_a END AS file_id, n AS count FROM co WHERE file_id_a = 7 OR file_id_b = 7)
SELECT file_id, count, path FROM p JOIN fi ON fi.id = file_id ORDER BY count DESC, path LIMIT 20"""


def symbols_of_file(spark: SparkSession, d: str) -> DataFrame:
    return Q.file_symbols(table(spark, d, "symbols").distinct(), 2).select("id", "name", "line")


SYMBOLS_OF_FILE = "SELECT DISTINCT id, name, line FROM symbols WHERE file_id = 2"


def symbols_searched(spark: SparkSession, d: str) -> DataFrame:
    s = Q.search_symbols(table(spark, d, "symbols"), table(spark, d, "files"), "src f* function", None)
    return s.select("id", F.round("score", 7).alias("score"))


SYMBOLS_SEARCHED = """
WITH s AS (SELECT DISTINCT s.id, name, kind, path FROM symbols s JOIN files f ON f.id = s.file_id),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, path, kind)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM s),
t AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'src')) AS a, len(list_filter(w, lambda x: starts_with(x, 'f'))) AS b, len(list_filter(w, lambda x: x = 'function')) AS c FROM w),
g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM t)
SELECT id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))
 + ln(1 + (docs - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)), 7) AS score FROM t, g WHERE a > 0 AND b > 0 AND c > 0
"""


def signature_of_line(spark: SparkSession, d: str) -> DataFrame:
    s, f = table(spark, d, "symbols"), table(spark, d, "files")
    at = s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").where("signature is not null").orderBy("path", "line", s["id"]).select("path", "line").first()
    return Q.signature_at(s, f, at.path, at.line)


SIGNATURE_OF_LINE = """
WITH s AS (SELECT DISTINCT s.id, s.name, s.kind, s.signature, s.line, path FROM symbols s JOIN files f ON f.id = s.file_id),
a AS (SELECT path, line FROM s WHERE signature IS NOT NULL ORDER BY path, line, id LIMIT 1) SELECT id, name, kind, signature FROM s WHERE (path, line) IN (SELECT (path, line) FROM a)
"""


def symbol_used(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    return Q.symbol_references(x.refs, x.calls(), x.symbols, x.files, "part_12", None)


SYMBOL_USED = f"""WITH {INDEX} SELECT DISTINCT 'import' AS kind, file_id, CAST(NULL AS INTEGER) AS line FROM rf WHERE p = 12 UNION ALL SELECT DISTINCT 'call', sy.file_id, ca.line FROM ca JOIN sy ON sy.id = caller_symbol_id WHERE callee_name = 'part_12'
UNION ALL SELECT DISTINCT 're-export', file_id, NULL FROM rf JOIN fi ON fi.id = file_id WHERE p = 12 AND is_barrel"""


def radius_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    return Q.symbol_radius(x.calls(), x.symbols, "part_12")


RADIUS_OF_SYMBOL = f"""WITH RECURSIVE {INDEX}, b AS (SELECT DISTINCT sy.id AS src, caller_symbol_id AS dst FROM ca JOIN sy ON sy.name = callee_name WHERE sy.id <> caller_symbol_id),
w AS (SELECT CAST(12 AS BIGINT) AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN b ON src = w.id WHERE depth < 5) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0"""


def cycles_of_calls(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    return Q.call_cycles(x.calls(), x.symbols, None)


def gaps_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the best files that no test calls, from the calls of the whole index."""
    x = Index(spark, d)
    return Q.knowledge_gaps(x.symbols, x.files, x.calls(), 0.9, None).select("id", F.round("pagerank", 9).alias("pagerank"), "callers")


GAPS_OF_PARTS = f"""WITH {INDEX}, r AS (SELECT pagerank, row_number() OVER (ORDER BY pagerank) - 1 AS k, count(*) OVER () AS n FROM fi), cut AS (SELECT pagerank AS c FROM r WHERE k = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))),
p AS (SELECT callee_symbol_id AS id, count(*) AS callers, max(f.path LIKE '%.test.%') AS tested FROM ca JOIN sy s ON s.id = caller_symbol_id JOIN fi f ON f.id = s.file_id WHERE callee_symbol_id IS NOT NULL GROUP BY 1)
SELECT sy.id, round(pagerank, 9) AS pagerank, coalesce(callers, 0) AS callers FROM sy JOIN fi ON fi.id = sy.file_id LEFT JOIN p ON p.id = sy.id WHERE kind IN ('function', 'method') AND pagerank >= (SELECT c FROM cut) AND NOT coalesce(tested, false)"""


def callers_of_parts(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    calls = x.calls()
    up = Q.callers(calls, x.symbols, x.symbols.where("is_exported"), 0.7).select(F.lit("caller").alias("side"), F.col("target_id").alias("symbol"), F.col("caller_symbol_id").alias("other"), "line")
    down = Q.callees(calls, x.symbols, 0.7).select(F.lit("callee").alias("side"), F.col("caller_symbol_id").alias("symbol"), F.col("callee_symbol_id").alias("other"), "line")
    return up.union(down)


CALLERS_OF_PARTS = f"""WITH {INDEX} SELECT 'caller' AS side, t.id AS symbol, caller_symbol_id AS other, ca.line FROM ca JOIN sy t ON t.name = callee_name AND t.is_exported AND (callee_file_id IS NULL OR callee_file_id = t.file_id)
UNION ALL SELECT 'callee', caller_symbol_id, callee_symbol_id, coalesce(t.line, ca.line) FROM ca LEFT JOIN sy t ON t.id = callee_symbol_id"""


def unused_parts(spark: SparkSession, d: str) -> DataFrame:
    x = Index(spark, d)
    few = x.refs.where("file_id % 10 = 1")
    return Q.unused_exports(x.symbols, B.resolve_refs(few, x.symbols, x.files)).select("id")


UNUSED_PARTS = f"WITH {INDEX} SELECT id FROM sy WHERE is_exported AND name NOT IN (SELECT name FROM re WHERE source_file_id IS NOT NULL AND file_id % 10 = 1)"


def part_shapes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = p.select((F.col("p_partkey") % 97).alias("file_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), F.sha2(F.concat_ws("|", "p_type", "p_size").cast("binary"), 256).alias("shape_hash"), F.col("p_size").alias("node_count"))
    return Q.duplicate_shapes(s)


PART_SHAPES = """WITH s AS (SELECT p_partkey % 97 AS file_id, p_name AS name, p_partkey AS line, sha256(p_type || '|' || p_size) AS shape_hash, p_size AS node_count FROM part),
n AS (SELECT shape_hash, count(*) AS copies FROM s GROUP BY 1 HAVING count(*) > 1) SELECT shape_hash, copies, node_count, file_id, name, line FROM s JOIN n USING (shape_hash)"""


def function_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the source texts whose bodies have one shape."""
    o = outlines(table(spark, d, "files"), table(spark, d, "source_texts")).where("kind = 'function'")
    return Q.duplicate_shapes(o.select("file_id", "name", "line", F.col("shape").alias("shape_hash"), F.col("parts").alias("node_count")))


def text_imports(spark: SparkSession, d: str) -> DataFrame:
    """Every name that a source text imports, of all its languages."""
    o = outlines(table(spark, d, "files"), table(spark, d, "source_texts"))
    return o.where("kind = 'import'").select("file_id", "name", "source", "line")


TEXT_IMPORTS = r"""
WITH l AS (SELECT file_id, lower(split_part(path, '.', -1)) AS ext, unnest(regexp_split_to_array(content, '\r\n|\n|\r')) AS t, generate_subscripts(regexp_split_to_array(content, '\r\n|\n|\r'), 1) AS line FROM (SELECT DISTINCT file_id, content FROM source_texts) JOIN (SELECT DISTINCT id, path FROM files) ON id = file_id),
m AS (SELECT file_id, line, regexp_extract(t, '^import \{ *(\w+) *\} from ''([^'']+)''', ['name', 'source']) AS x FROM l WHERE ext IN ('ts', 'js', 'tsx', 'jsx', 'mjs', 'cjs', 'mts', 'cts')
 UNION ALL SELECT file_id, line, regexp_extract(t, '^from (?P<source>\S+) import (?P<name>\w+)$', ['source', 'name']) FROM l WHERE ext IN ('py', 'pyi')
 UNION ALL SELECT file_id, line, regexp_extract(t, '^use ([\w:]+)::(\w+);', ['source', 'name']) FROM l WHERE ext = 'rs'
 UNION ALL SELECT file_id, line, {'source': regexp_extract(t, '^import "([^"]+)"', 1), 'name': regexp_extract(t, '^import "(?:[^"]*/)?([^"/]+)"', 1)} FROM l WHERE ext = 'go')
SELECT file_id, x.name AS name, x.source AS source, CAST(line AS INTEGER) AS line FROM m WHERE x.name <> ''
"""


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods that the texts of files declare."""
    o = outlines(table(spark, d, "files"), table(spark, d, "source_texts"))
    return o.where("kind = 'function'").select("file_id", "name").distinct()


TEXT_FUNCTIONS = "SELECT DISTINCT file_id, name FROM symbols WHERE lower(kind) IN ('function', 'method') AND file_id IN (SELECT file_id FROM source_texts WHERE content <> '')"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions suggested by the heaviest and lightest flow between parts, by dear parts and by customers' orders."""
    i, p = table(spark, d, "lineitem"), table(spark, d, "part")
    e = i.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(F.concat(F.lit("s/"), "l_suppkey").alias("src"), F.concat(F.lit("p/"), "l_partkey").alias("dst"), "weight")
    nth = lambda df, *by: df.orderBy(*by).limit(5).withColumn("nth", F.row_number().over(Window.orderBy(*by)))
    light, heavy = nth(e, "weight", "src", "dst"), nth(e, F.desc("weight"), "src", "dst")
    dear = nth(p.select(F.col("p_name").alias("name"), F.concat(F.lit("a/b/"), "p_partkey").alias("path"), (F.col("p_retailprice") / 10000).alias("pagerank")), F.desc("pagerank"), "path")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("steps"), F.max("o_orderkey").alias("last"))
    flows = nth(o.select(F.concat(F.lit("c"), "o_custkey").alias("entry_name"), F.lit("main").alias("entry_kind"), F.concat(F.lit("c/"), "o_custkey").alias("entry_path"), (F.col("steps") / 100).alias("weight"), "steps", F.concat(F.lit("o"), "last").alias("last_name"), F.concat(F.lit("o/"), "last").alias("last_path")), F.desc("steps"), "entry_path")
    q = Q.suggested_questions(Q.question_candidates(light, heavy, dear, flows), 8)
    return q.withColumn("score", F.round("score", 9))


QUESTIONS = """
WITH e AS (SELECT 's/' || l_suppkey AS src, 'p/' || l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey),
light AS (SELECT * FROM e ORDER BY weight, src, dst LIMIT 2), heavy AS (SELECT * FROM e ORDER BY weight DESC, src, dst LIMIT 2),
dear AS (SELECT p_name AS name, 'a/b/' || p_partkey AS path, p_retailprice / 10000 AS r FROM part ORDER BY r DESC, path LIMIT 2),
o AS (SELECT o_custkey, count(*) AS steps, max(o_orderkey) AS last FROM orders GROUP BY 1), fl AS (SELECT * FROM (SELECT * FROM o ORDER BY steps DESC, 'c/' || o_custkey LIMIT 5) WHERE steps >= 3 ORDER BY steps DESC, 'c/' || o_custkey LIMIT 2),
q AS (SELECT 'surprise' AS kind, 'Why does `' || substr(src, 3) || '` call `' || substr(dst, 3) || '`? It looks like an out-of-module dependency.' AS text, 1 / (1 + ln(1 + weight)) AS score, src AS path FROM light
 UNION ALL SELECT 'bridge', '`' || substr(src, 3) || '` is a bridge between modules — what blast radius would breaking it cause?', 1 - 1 / (1 + ln(1 + weight)), src FROM heavy
 UNION ALL SELECT 'untested', '`' || name || '` in `' || split_part(path, '/', -1) || '` is a high-PageRank symbol with no tests — should we add coverage?', greatest(0, least(1, r)), path FROM dear
 UNION ALL SELECT 'flow', 'Walk me through the `c' || o_custkey || '` main flow (ends in `o' || last || '`).', greatest(0, least(1, steps / 100)), 'c/' || o_custkey FROM fl),
u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, path) = 1)
SELECT kind, text, round(score, 9) AS score, path FROM u ORDER BY u.score DESC, path, text LIMIT 8
"""


def parts_together(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts as an undirected graph: the weights of both directions of a pair summed."""
    i = table(spark, d, "lineitem")
    e = i.select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight")).where("src <= 1000000")
    return K.undirected(e).withColumn("weight", F.round("weight", 4))


PARTS_TOGETHER = "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, round(sum(l_quantity), 4) AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Folders with what lies in them, and neighbours in a folder with each other: src, dst, weight."""
    p = table(spark, d, "files").select("path").distinct()
    parts = F.split("path", "/")
    up = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dst")).distinct()
    up = up.withColumn("src", F.regexp_replace("dst", "/?[^/]*$", ""))
    beside = up.withColumn("next", F.lead("dst").over(Window.partitionBy("src").orderBy("dst"))).where("next is not null").select(F.col("dst").alias("src"), F.col("next").alias("dst"))
    return up.select("src", "dst").union(beside).withColumn("weight", F.length("dst").cast("double"))


_TREE = """
u AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS dst FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT DISTINCT string_split(path, '/') AS parts FROM files))),
v AS (SELECT dst, regexp_replace(dst, '/?[^/]*$', '') AS src FROM u)"""


def folder_bridges(spark: SparkSession, d: str) -> DataFrame:
    return K.bridges(_tree(spark, d))


FOLDER_BRIDGES = f"WITH {_TREE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(length(dst) AS DOUBLE) AS weight FROM v WHERE src IN (SELECT src FROM v GROUP BY 1 HAVING count(*) = 1)"


def _cliques(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    return f.select(F.col("id").alias("src"), "folder").join(f.select(F.col("id").alias("dst"), "folder"), "folder").where("src < dst").select("src", "dst", F.lit(1.0).alias("weight"))


def folder_communities(spark: SparkSession, d: str) -> DataFrame:
    """Files of one folder, each tied to each: the communities are the folders."""
    return K.communities(_cliques(spark, d))


_CLIQUES = """
f AS (SELECT DISTINCT id, regexp_replace(path, '/[^/]*$', '') AS folder FROM files), g AS (SELECT folder, count(*) AS n, min(id) AS least FROM f GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT folder, n, row_number() OVER (ORDER BY n DESC, least) - 1 AS community FROM g)"""
FOLDER_COMMUNITIES = f"WITH {_CLIQUES} SELECT id AS node, community FROM f JOIN c USING (folder)"


def folder_report(spark: SparkSession, d: str) -> DataFrame:
    """All readings of that graph in one: communities with their weights, bridges and surprises counted."""
    r = K.community_report(_cliques(spark, d))
    some = lambda df, what: df.select(F.lit(what).alias("what"), F.lit(None).cast("long").alias("community"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("internal")).groupBy("what").agg(F.max("community").alias("community"), F.count(F.lit(1)).alias("size"), F.max("internal").alias("internal"))
    own = r["communities"].select(F.lit("community").alias("what"), F.col("community").cast("long").alias("community"), "size", "internal")
    return own.union(some(r["bridges"], "bridges")).union(some(r["surprises"], "surprises"))


FOLDER_REPORT = f"""WITH {_CLIQUES} SELECT 'community' AS what, community, n AS size, CAST(n * (n - 1) / 2 AS DOUBLE) AS internal FROM c UNION ALL SELECT 'bridges', NULL, count(*), NULL FROM c WHERE n = 2 HAVING count(*) > 0"""


def community_sums(spark: SparkSession, d: str) -> DataFrame:
    """Weights inside and between given groups of parts."""
    i = table(spark, d, "lineitem")
    e = i.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    given = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("community", F.col("node") % 11)
    return K.community_weights(e, given)


COMMUNITY_SUMS = """
WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), s AS (SELECT node % 11 AS community, count(*) AS size FROM n GROUP BY 1),
i AS (SELECT src % 11 AS c, sum(w) AS w FROM e WHERE src <> dst AND src % 11 = dst % 11 GROUP BY 1), o AS (SELECT c, sum(w) AS w FROM (SELECT src % 11 AS c, w FROM e WHERE src % 11 <> dst % 11 UNION ALL SELECT dst % 11, w FROM e WHERE src % 11 <> dst % 11) GROUP BY 1)
SELECT community, size, CAST(coalesce(i.w, 0) AS DOUBLE) AS internal, CAST(coalesce(o.w, 0) AS DOUBLE) AS external FROM s LEFT JOIN i ON i.c = community LEFT JOIN o ON o.c = community
"""

_ALL = (refs_resolved, code_calls, code_edges, code_rebuilt, symbols_once, files_indexed, file_neighbours, file_changed_with, symbols_of_file, symbols_searched, signature_of_line, symbol_used, radius_of_symbol, cycles_of_calls, gaps_of_parts, callers_of_parts, unused_parts, part_shapes, function_shapes, text_imports, text_functions, questions, parts_together, folder_bridges, folder_communities, folder_report, community_sums)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
