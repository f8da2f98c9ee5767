"""Queries of the readers, and of path and text functions that need whole lines of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import paths as P
from skeinwork.functions import text as T
from skeinwork.operators import context as C
from skeinwork.operators import retrieval as R
from skeinwork.runtime import session_dir
from skeinwork.sources import readers as D
from skeinwork.sources.tables import table


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path", "mtime_ms", (F.col("line_count") * 37).alias("size")).distinct()


def files_walked(spark: SparkSession, d: str) -> DataFrame:
    return D.walked(_listing(spark, d), 20_000, 4)


_KEPT = "NOT list_has_any(string_split(path, '/'), [{}]) AND NOT regexp_matches(path, '({})$') AND {} <> 'unknown'"


def _indexable() -> str:
    from skeinwork.plans.text import _LANG

    ends = "|".join(x.replace(".", "\\.") for x in P.IGNORED_ENDINGS)
    return _KEPT.format(", ".join(f"'{x}'" for x in P.IGNORED_FOLDERS), ends, f"({_LANG})")


FILES_WALKED = f"""
SELECT path, mtime_ms, size FROM (SELECT DISTINCT path, mtime_ms, line_count * 37 AS size, split_part(path, '/', -1) AS fname FROM files)
WHERE {_indexable()} AND size < 20000 AND NOT regexp_matches(path, '(^|/)\\.') AND len(string_split(path, '/')) - 1 <= 4
"""


def files_listed(spark: SparkSession, d: str) -> DataFrame:
    return D.listed(_listing(spark, d).select("path").distinct(), [".ts", ".js", ".py"])


FILES_LISTED = "SELECT DISTINCT path FROM files WHERE (path LIKE '%.ts' OR path LIKE '%.js' OR path LIKE '%.py') AND path NOT LIKE '%.min.js' AND path NOT LIKE '%.bundle.js' ORDER BY path LIMIT 5000"


def files_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return D.fingerprint(_listing(spark, d))


FILES_FINGERPRINT = "SELECT count(*) AS files, max(mtime_ms) AS latest FROM (SELECT DISTINCT path, mtime_ms, line_count FROM files)"


def commits_read(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log of commits, written to a file and read again by blocks: the names in each of the first 300."""
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("src/"), F.col("l_partkey")))), "\n").alias("l"))
    at = f"{session_dir(spark)}/commits"
    i.repartitionByRange(1, "l_orderkey").sortWithinPartitions("l_orderkey").select(F.concat(F.lit("---COMMIT---\n"), "l")).write.mode("overwrite").text(at)
    return D.commit_files(D.commit_log(spark, at))


COMMITS_READ = "WITH o AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS commit FROM (SELECT DISTINCT l_orderkey FROM lineitem)) SELECT DISTINCT commit, 'src/' || l_partkey AS path FROM lineitem JOIN o USING (l_orderkey) WHERE commit <= 300"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "forge_log").where("message is not null").select("line_id", "log_name", "line_no", "message").distinct()


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Log lines as a searcher's events, of which those of every third line are matches."""
    kind = F.when(F.col("line_id") % 3 == 0, "match").when(F.col("line_id") % 3 == 1, "begin").otherwise("summary")
    e = F.struct(kind.alias("type"), F.struct(F.struct(F.col("log_name").alias("text")).alias("path"), F.col("line_no").alias("line_number"), F.struct(F.concat("message", F.lit(" ")).alias("text")).alias("lines")).alias("data"))
    rows = _lines(spark, d).select("line_id", F.when(F.col("line_id") % 30 == 0, "{broken").otherwise(F.to_json(e)).alias("value"))
    return D.match_events(rows, order="line_id")


SEARCH_HITS = "SELECT log_name AS path, CAST(line_no AS INTEGER) AS line, rtrim(message, ' ') AS text FROM (SELECT DISTINCT line_id, log_name, line_no, message FROM forge_log WHERE message IS NOT NULL) WHERE line_id % 3 = 0 AND line_id % 30 <> 0 ORDER BY line_id LIMIT 100"


def grep_hits(spark: SparkSession, d: str) -> DataFrame:
    """Log lines as a searcher's text of path, line and match between bars; a row without a second bar is none."""
    text = F.when(F.col("line_id") % 7 == 0, F.concat("log_name", F.lit("|broken"))).otherwise(F.concat_ws("|", "log_name", "line_no", "message"))
    return _lines(spark, d).select("line_id", D.match_lines(text).alias("m")).select("line_id", "m.path", "m.line", F.length("m.text").alias("chars"), F.sha2(F.col("m.text").cast("binary"), 256).alias("hash"))


GREP_HITS = """SELECT DISTINCT line_id, CASE WHEN line_id % 7 <> 0 THEN log_name END AS path, CASE WHEN line_id % 7 <> 0 THEN CAST(line_no AS INTEGER) END AS line,
 CASE WHEN line_id % 7 <> 0 THEN CAST(length(left(message, 2000)) AS INTEGER) END AS chars, CASE WHEN line_id % 7 <> 0 THEN sha256(left(message, 2000)) END AS hash FROM forge_log WHERE message IS NOT NULL"""


def grouped_hits(spark: SparkSession, d: str) -> DataFrame:
    from skeinwork.operators.sessions import grouped_matches

    rows = _lines(spark, d).select(F.col("line_id").alias("pos"), F.col("log_name").alias("path"), F.col("line_no").alias("line"), F.substring("message", 1, 30).alias("text"))
    return grouped_matches(rows)


GROUPED_HITS = """WITH t AS (SELECT DISTINCT line_id, log_name, line_no, left(message, 30) AS m FROM forge_log WHERE message IS NOT NULL ORDER BY line_id LIMIT 100)
SELECT log_name AS path, min(line_id) AS first, count(*) AS n, string_agg(line_no || ': ' || m, chr(10) ORDER BY line_id) AS text FROM t GROUP BY 1"""


def cells_placed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a file as the cells of a notebook, those without a symbol as text cells; every fifth code cell's source as a list."""
    c = table(spark, d, "chunks").select("id", "file_path", "start_line", "content", "symbol_kind").where("content is not null and file_path is not null").distinct()
    kind = F.when(F.col("symbol_kind").isNull(), "markdown").otherwise("code")
    cell = F.struct(kind.alias("cell_type"), F.col("content").alias("source"))
    books = c.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", cell.alias("cell")))).alias("l")).select("file_path", F.to_json(F.struct(F.col("l.cell").alias("cells"))).alias("text"))
    return D.notebook_cells(books, "file_path").select("id", "cell", "start_line", F.sha2(F.col("code").cast("binary"), 256).alias("hash"))


CELLS_PLACED = r"""
WITH c AS (SELECT DISTINCT id, file_path, start_line, content, symbol_kind FROM chunks WHERE content IS NOT NULL AND file_path IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, id) - 1 AS cell FROM c),
k AS (SELECT *, CASE WHEN trim(content, ' ') = '' THEN 1 ELSE len(string_split(content, chr(10))) + 1 END AS n FROM n WHERE symbol_kind IS NOT NULL),
s AS (SELECT *, CAST(1 + coalesce(sum(n) OVER (PARTITION BY file_path ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM k)
SELECT file_path AS id, CAST(cell AS INTEGER) AS cell, first AS start_line, sha256(content) AS hash FROM s WHERE trim(content, ' ') <> ''
"""


def scripts_found(spark: SparkSession, d: str) -> DataFrame:
    """Source texts between script tags in a page, one of them a module and one typed."""
    t = F.concat(F.lit('<html>\n<body>\n<SCRIPT type="module">'), "content", F.lit("</SCRIPT>\n<p>\n<script lang='ts' defer>\nlet x\n</script>"))
    pages = table(spark, d, "source_texts").where(~F.lower("content").contains("<script") & ~F.lower("content").contains("</script")).select(F.col("file_id").alias("id"), t.alias("text")).distinct()
    return D.script_blocks(pages).select("id", "nth", "start_line", "lang", "module", F.length("code").alias("chars"))


SCRIPTS_FOUND = """
WITH p AS (SELECT DISTINCT file_id, content FROM source_texts WHERE NOT contains(lower(content), '<script') AND NOT contains(lower(content), '</script'))
SELECT file_id AS id, 0 AS nth, 4 AS start_line, 'js' AS lang, true AS module, CAST(length(content) AS INTEGER) AS chars FROM p
UNION ALL SELECT file_id, 1, CAST(2 + 3 + len(string_split(content, chr(10))) AS INTEGER), 'ts', false, 7 FROM p
"""


def code_reports(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the index as reports of two counters of code, read and added up per language."""
    f = table(spark, d, "files").select("id", "language", "line_count", "symbol_count").distinct().where("language is not null")
    g = f.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("line_count").alias("lines"), F.sum("symbol_count").alias("symbols"))
    one = F.to_json(F.map_from_arrays(F.array(F.col("language")), F.array(F.struct(F.col("lines").alias("code"), F.col("symbols").alias("comments"), F.lit(0).alias("blanks"), F.array(F.struct(F.lit("x").alias("name"))).alias("reports")))))
    two = F.to_json(F.array(F.struct(F.col("language").alias("Name"), F.col("n").alias("Count"), F.col("lines").alias("Code"), F.col("symbols").alias("Comment"), F.lit(1).alias("Blank"))))
    return D.code_stats_of(g.select(F.explode(F.array(one, two, F.lit("{broken"))).alias("value")))


CODE_REPORTS = """WITH f AS (SELECT DISTINCT id, language, line_count, symbol_count FROM files WHERE language IS NOT NULL)
SELECT language, count(*) + 1 AS files, CAST(2 * sum(line_count) AS BIGINT) AS code, CAST(2 * sum(symbol_count) AS BIGINT) AS comments, CAST(1 AS BIGINT) AS blanks FROM f GROUP BY 1"""


def repositories_chosen(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("/r/"), "n_nationkey").alias("path"), F.lit(0).alias("registered_at"))
    n = [x.name for x in r.orderBy("name").limit(3).collect()]
    return D.repositories(r, [n[2], "/r/7", n[0], n[2], "/r/7"])


REPOSITORIES_CHOSEN = "SELECT n_name AS name, '/r/' || n_nationkey AS path FROM nation WHERE n_nationkey = 7 OR n_name IN (SELECT n_name FROM nation ORDER BY n_name LIMIT 3) AND n_name <> (SELECT n_name FROM nation ORDER BY n_name OFFSET 1 LIMIT 1)"


def caches_stale(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", T.scope_hash(F.col("path")).alias("name"), F.col("mtime_ms")).distinct()
    f = f.withColumn("name", F.when(F.col("id") % 9 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    now = f.agg(F.max("mtime_ms")).first()[0]
    return D.stale_caches(f, now, 60).select("name", "mtime_ms")


CACHES_STALE = "SELECT DISTINCT left(sha256(path), 16) AS name, mtime_ms FROM files WHERE id % 9 <> 0 AND mtime_ms < (SELECT max(mtime_ms) FROM files) - 60 * CAST(86400000 AS BIGINT)"


def vectors_made(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in vectors of eight numbers of paths."""
    v = R.pseudo_vectors(table(spark, d, "files").select("id", "path").distinct(), "id", "path", 8)
    return v.select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 5)).alias("vec"))


VECTORS_MADE = """
WITH RECURSIVE h AS (SELECT DISTINCT id, list_reduce([0] || list_transform(string_split(path, ''), lambda c: unicode(c)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM files),
w AS (SELECT id, CAST(h AS BIGINT) AS h, 0 AS i, [CAST(0 AS DOUBLE)] AS v FROM h UNION ALL SELECT id, (h * 31 + i) % 4294967296, i + 1, v || [((h * 31 + i) % 4294967296 & 65535) / 65536 - 0.5] FROM w WHERE i < 8),
n AS (SELECT id, v[2:] AS v, sqrt(list_sum(list_transform(v[2:], lambda x: x * x))) AS n FROM w WHERE i = 8)
SELECT id, list_transform(v, lambda x: round(CAST(CAST(x / n AS FLOAT) AS DOUBLE), 5)) AS vec FROM n
"""


def imported_packages(spark: SparkSession, d: str) -> DataFrame:
    """The package of each name, of names as files import them and of some with a scope."""
    f = table(spark, d, "files").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("@"), "path")).otherwise(F.col("path")).alias("p")).distinct()
    return f.select("id", P.package_name(F.col("p")).alias("package"))


IMPORTED_PACKAGES = "SELECT DISTINCT id, CASE WHEN id % 2 = 0 AND contains(path, '/') THEN '@' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) WHEN id % 2 = 0 THEN '@' || split_part(path, '/', 1) ELSE split_part(path, '/', 1) END AS package FROM files"


def _declared(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct()
    t = table(spark, d, "source_texts").select("file_id", F.split("content", r"\r?\n").alias("l")).distinct()
    return table(spark, d, "symbols").select("id", "file_id", "name", "kind", "line").distinct().join(f, "file_id").join(t, "file_id")


_DECLARED = r"""
de AS (SELECT s.id, s.name, lower(s.kind) AS kind, s.line, f.path, regexp_split_to_array(t.content, '\r?\n') AS l FROM (SELECT DISTINCT id, file_id, name, kind, line FROM symbols) s JOIN (SELECT DISTINCT id, path FROM files) f ON f.id = s.file_id JOIN (SELECT DISTINCT file_id, content FROM source_texts) t ON t.file_id = s.file_id)"""


def symbols_public(spark: SparkSession, d: str) -> DataFrame:
    s = _declared(spark, d)
    return s.select("id", P.is_public(F.col("name"), F.get("l", F.col("line") - 1), P.language_of_path(F.col("path"))).alias("public"))


SYMBOLS_PUBLIC = rf"""
WITH {_DECLARED}, e AS (SELECT id, name, lower(split_part(path, '.', -1)) AS e, ltrim(coalesce(l[line], ''), ' ') AS t FROM de)
SELECT id, CASE WHEN e = 'go' THEN regexp_matches(name, '^[A-Z]') WHEN e IN ('rs', 'zig') THEN starts_with(t, 'pub ') WHEN e IN ('py', 'pyw', 'dart') THEN NOT starts_with(name, '_')
 WHEN e IN ('java', 'kt', 'kts', 'scala', 'sc', 'swift', 'cs') THEN NOT regexp_matches(t, '\bprivate\b') WHEN e = 'php' THEN NOT regexp_matches(t, '\b(private|protected)\b') ELSE true END AS public FROM e
"""


def signatures_cut(spark: SparkSession, d: str) -> DataFrame:
    s = _declared(spark, d)
    return s.select("id", P.signature_of(F.col("l"), F.col("line"), F.lower("kind")).alias("signature"))


SIGNATURES_CUT = rf"""
WITH {_DECLARED}, a AS (SELECT id, ltrim(l[line], ' ') AS x, l[line + 1] AS y, l[line + 2] AS z, kind IN ('function', 'method') AND NOT regexp_matches(ltrim(l[line], ' '), '[)]|\{{|=>') AS open FROM de WHERE line BETWEEN 1 AND len(l)),
b AS (SELECT *, CASE WHEN open AND y IS NOT NULL THEN x || ' ' || trim(y, ' ') ELSE x END AS one FROM a), c AS (SELECT *, CASE WHEN open AND y IS NOT NULL AND NOT regexp_matches(y, '[)]|\{{') AND z IS NOT NULL THEN one || ' ' || trim(z, ' ') ELSE one END AS two FROM b),
e AS (SELECT id, CASE WHEN instr(two, chr(123)) > 1 THEN rtrim(left(two, instr(two, chr(123)) - 1), ' ') ELSE two END AS t FROM c), f AS (SELECT id, rtrim(regexp_replace(t, '\s*[\{{:]\s*$', ''), ' ') AS t FROM e),
g AS (SELECT id, CASE WHEN length(t) > 120 THEN left(t, 117) || '...' ELSE t END AS t FROM f)
SELECT de.id, CASE WHEN t <> '' THEN t END AS signature FROM de LEFT JOIN g ON g.id = de.id
"""


def part_matched(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name or brand holds a word, as the best match or as candidates."""
    p = table(spark, d, "part")
    return C.best_match(p, "brand#1", ["p_name", "p_brand"], "p_partkey").select("p_partkey", "match")


PART_MATCHED = """WITH h AS (SELECT p_partkey, lower(p_name) = 'brand#1' OR lower(p_brand) = 'brand#1' AS e FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1'))
SELECT p_partkey, true AS match FROM h WHERE p_partkey = (SELECT min(p_partkey) FROM h WHERE e) UNION ALL SELECT p_partkey, (SELECT count(*) FROM h) = 1 FROM h WHERE NOT EXISTS (SELECT 1 FROM h WHERE e)"""


def names_free(spark: SparkSession, d: str) -> DataFrame:
    """A free name for every kind of part, where those of some sizes are taken with numbers."""
    p = table(spark, d, "part")
    taken = p.where("p_size <= 30").select(F.when(F.col("p_size") > 1, F.concat(F.substring("p_type", 1, 25), F.lit("-"), F.col("p_size") - 1)).otherwise(F.substring("p_type", 1, 25)).alias("name"))
    return C.unique_names(p.select(F.col("p_type").alias("base")), taken)


NAMES_FREE = """
WITH t AS (SELECT DISTINCT left(p_type, 25) AS cut, p_size - 1 AS n FROM part WHERE p_size <= 30), b AS (SELECT DISTINCT p_type AS base, left(p_type, 25) AS cut FROM part),
f AS (SELECT cut, min(n + 1) AS free FROM t WHERE (cut, n + 1) NOT IN (SELECT (cut, n) FROM t) GROUP BY 1)
SELECT base, CASE WHEN (cut, 0) IN (SELECT (cut, n) FROM t) THEN cut || '-' || free ELSE cut END AS name FROM b LEFT JOIN f USING (cut)
"""


def texts_hashed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", "path").distinct()
    o = F.expr("timestamp'2024-01-01 00:00:00'")
    return f.select("id", C.rolling_hash(F.col("path")).alias("hash"), T.clamp(F.col("id") / 500 - 0.5).alias("clamped"), T.elapsed_seconds(o, F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 777)).alias("elapsed"))


TEXTS_HASHED = """
WITH h AS (SELECT DISTINCT id, CAST(list_reduce([0] || list_transform(string_split(path, ''), lambda c: unicode(c)), lambda a, c: (a * 31 + c) % 4294967296) AS BIGINT) AS h FROM files),
s AS (SELECT id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM h)
SELECT id, CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_base(abs(h), 36)) AS hash, greatest(0.0, least(1.0, id / 500 - 0.5)) AS clamped, CAST(floor(id * 777 / 1000 + 0.5) AS BIGINT) AS elapsed FROM s
"""


def models_named(spark: SparkSession, d: str) -> DataFrame:
    """Providers and models of names with a slash, and each part's chain of models without repetition."""
    p = table(spark, d, "part")
    m = F.concat_ws("/", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), "p_type", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))
    chain = T.fallback_chain(F.array(m, F.lit("none"), F.lit("x/y"), m, F.lit("/z"), F.lit("x/y")))
    return p.select("p_partkey", T.model_parts(m).alias("m"), F.array_join(chain, " ").alias("chain")).select("p_partkey", "m.provider", "m.model", "chain")


MODELS_NAMED = """WITH m AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS a, p_type || CASE WHEN p_size > 25 THEN '/' || p_size ELSE '' END AS b FROM part) SELECT p_partkey, a AS provider, b AS model, a || '/' || b || ' x/y' AS chain FROM m"""


def _skills(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("---\nname: \"skill "), F.floor(k / 3).cast("string"), F.lit('"\n# a note: of ours\nagents: '), F.when(k % 4 == 0, "[builder, 'reviewer' ]").when(k % 4 == 1, "planner").when(k % 4 == 2, "").otherwise("[builder]"),
        F.lit("\nglobs: "), F.when(k % 5 == 0, "[src/**/*.ts, \"*.md\"]").when(k % 5 == 1, "lib/*.py").otherwise(""), F.lit("\npriority: "), (k % 7).cast("string"), F.lit("\n---\nUse "), "p_name", F.lit("\n"),
    )
    scope = F.element_at(F.array(*map(F.lit, C.SCOPES)), (k % 3 + 1).cast("int"))
    fm = T.frontmatter(text)
    get = lambda n: F.coalesce(F.try_element_at(fm, F.lit(n)), F.lit(""))
    return p.select(T.unquoted(get("name")).alias("name"), scope.alias("scope"), T.front_list(get("agents")).alias("agents"), T.front_list(get("globs")).alias("globs"), F.trim(F.replace(T.front_body(text), F.lit("\n"), F.lit(" "))).alias("body"), get("priority").try_cast("int").alias("priority"))


def skills_read(spark: SparkSession, d: str) -> DataFrame:
    return _skills(spark, d).select("name", "scope", F.array_join("agents", ",").alias("agents"), F.array_join("globs", ",").alias("globs"), "body", "priority")


_SKILLS = """sk AS (SELECT 'skill ' || (p_partkey // 3) AS name, ['global', 'user', 'project'][p_partkey % 3 + 1] AS scope, p_partkey % 3 AS r, CASE p_partkey % 4 WHEN 0 THEN 'builder,reviewer' WHEN 1 THEN 'planner' WHEN 2 THEN '' ELSE 'builder' END AS agents,
 CASE p_partkey % 5 WHEN 0 THEN 'src/**/*.ts,*.md' WHEN 1 THEN 'lib/*.py' ELSE '' END AS globs, 'Use ' || p_name AS body, CAST(p_partkey % 7 AS INTEGER) AS priority FROM part)"""
SKILLS_READ = f"WITH {_SKILLS} SELECT name, scope, agents, globs, body, priority FROM sk"


def skills_chosen(spark: SparkSession, d: str) -> DataFrame:
    return C.select_skills(_skills(spark, d), "builder", ["src/a/b.ts", "notes.txt"]).select("name", "scope", "body")


SKILLS_CHOSEN = f"WITH {_SKILLS}, b AS (SELECT * FROM sk QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC) = 1) SELECT name, scope, body FROM b WHERE (agents = '' OR contains(agents, 'builder')) AND globs IN ('', 'src/**/*.ts,*.md')"


def contexts_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as texts that a prompt of 4,000 characters has room for."""
    o = table(spark, d, "orders")
    text = F.concat(F.repeat(F.concat("o_orderstatus", F.lit(" ")), (F.col("o_orderkey") % 700).cast("int")), F.when(F.col("o_orderkey") % 3 == 0, "same").otherwise(F.col("o_orderkey").cast("string")))
    items = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("pos"), F.lit("doc").alias("source"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(text).alias("content"))
    return C.pack_contexts(items, 4000).select("session_id", "nth", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


CONTEXTS_PACKED = """
WITH RECURSIVE t AS (SELECT o_custkey AS s, o_orderkey AS pos, repeat(o_orderstatus || ' ', o_orderkey % 700) || CASE WHEN o_orderkey % 3 = 0 THEN 'same' ELSE CAST(o_orderkey AS VARCHAR) END AS c FROM orders WHERE o_orderkey % 11 <> 0),
u AS (SELECT s, c, min(pos) AS pos FROM t GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos) AS k FROM u),
w AS (SELECT s, k, CASE WHEN length(c) > 4000 THEN left(c, 4000) || chr(10) || chr(10) || '[... truncated ...]' ELSE c END AS out, CASE WHEN length(c) > 4000 THEN 4000 + 21 ELSE length(c) END AS used, 0 AS nth, true AS held FROM n WHERE k = 1
 UNION ALL SELECT n.s, n.k, CASE WHEN length(c) <= 4000 - used THEN c WHEN 4000 - used > 200 THEN left(c, 4000 - used) || chr(10) || chr(10) || '[... truncated ...]' END,
  CASE WHEN length(c) <= 4000 - used THEN used + length(c) WHEN 4000 - used > 200 THEN used + 4000 - used + 21 ELSE used END, nth + CASE WHEN length(c) <= 4000 - used OR 4000 - used > 200 THEN 1 ELSE 0 END, length(c) <= 4000 - used OR 4000 - used > 200 FROM w JOIN n ON n.s = w.s AND n.k = w.k + 1)
SELECT s AS session_id, CAST(nth AS INTEGER) AS nth, sha256(out) AS hash FROM w WHERE held
"""


def slop_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of the source texts that add nothing."""
    return C.comment_slop(table(spark, d, "source_texts").distinct(), "file_id", "content").groupBy("id", "category").agg(F.count(F.lit(1)).alias("comments"), F.max("warned").alias("warned"))


def _sql_slop() -> str:
    any_ = lambda p: f"regexp_matches(c, '(?i){p.replace(chr(39), chr(39) * 2)}')"
    rules = " ".join(f"WHEN {any_(p)} THEN '{c}'" for c, p in T.SLOP_RULES)
    return rf"""
WITH RECURSIVE t AS (SELECT file_id AS id, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS l FROM (SELECT DISTINCT * FROM source_texts WHERE content IS NOT NULL)),
r AS (SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM t),
w AS (SELECT id, CAST(0 AS BIGINT) AS k, '' AS s, false AS opened, false AS before, false AS inside FROM t
 UNION ALL SELECT r.id, r.k, r.s, NOT w.inside AND contains(r.s, '/*'), w.inside, (w.inside OR contains(r.s, '/*')) AND NOT contains(r.s, '*/') FROM w JOIN r ON r.id = w.id AND r.k = w.k + 1),
c AS (SELECT id, s, trim(regexp_replace(regexp_replace(s, '^.*?/\*+\s*', ''), '\*/\s*$', ''), ' ' || chr(9)) AS c FROM w WHERE opened AND regexp_replace(s, '^.*?/\*+\s*', '') <> '' AND NOT starts_with(regexp_replace(s, '^.*?/\*+\s*', ''), '*')
 UNION ALL SELECT id, s, trim(regexp_replace(regexp_replace(s, '\*/.*$', ''), '^\s*\*?\s*', ''), ' ' || chr(9)) FROM w WHERE (opened OR before) AND k > 0 UNION ALL SELECT id, s, regexp_extract(s, '^(?://|#)\s*(.+)', 1) FROM w WHERE NOT opened AND NOT before AND regexp_matches(s, '^(//|#)\s*.')),
f AS (SELECT DISTINCT id, s, CASE {rules} END AS category FROM c WHERE length(c) >= 5), g AS (SELECT * FROM f WHERE category IS NOT NULL), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1)
SELECT g.id, category, count(*) AS comments, max(n >= 2) AS warned FROM g JOIN n ON n.id = g.id GROUP BY 1, 2
"""


SLOP_COMMENTS = _sql_slop()


def docs_of_symbols(spark: SparkSession, d: str) -> DataFrame:
    return C.symbol_docs(table(spark, d, "symbols"), table(spark, d, "source_texts"))


_ALL = (files_walked, files_listed, files_fingerprint, commits_read, search_hits, grep_hits, grouped_hits, cells_placed, scripts_found, code_reports, repositories_chosen, caches_stale, vectors_made, imported_packages, symbols_public, signatures_cut, part_matched, names_free, texts_hashed, models_named, skills_read, skills_chosen, contexts_packed, slop_comments, docs_of_symbols)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
