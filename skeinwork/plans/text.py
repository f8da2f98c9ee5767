"""Queries of the path and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import paths as P
from skeinwork.functions import text as T
from skeinwork.sources.tables import table

_LF = "chr(10)"


def path_features(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return (
        table(spark, d, "files").select("id", "path").distinct()
        .select("id", P.language_of_path(p).alias("lang"), P.is_barrel(p).alias("barrel"), P.folder_group(p).alias("folder"), P.is_test_like(p).alias("test_like"), P.is_test_path(p).alias("test_path"), P.tested_path(p).alias("tested"), P.is_indexable(p).alias("indexable"), P.relative_path(p, "services").alias("relative"), p.rlike(P.glob_pattern("**/src/*.ts")).alias("globbed"))
    )


_EXTS = "MAP {" + ", ".join(f"'{e}': '{lang}'" for lang, exts in P.LANGUAGE_EXTENSIONS.items() for e in exts) + "}"
_LANG = f"CASE WHEN contains(path, '.') THEN coalesce({_EXTS}[lower(split_part(path, '.', -1))], 'unknown') WHEN fname = 'Dockerfile' OR fname LIKE 'Dockerfile.%' THEN 'dockerfile' ELSE 'unknown' END"
PATH_FEATURES = f"""
WITH f AS (SELECT DISTINCT id, path, split_part(path, '/', -1) AS fname, string_split(path, '/') AS parts FROM files)
SELECT id, {_LANG} AS lang, lower(fname) IN ({', '.join(f"'{x}'" for x in P.BARREL_FILES)}) AS barrel,
 CASE WHEN len(parts) >= 3 THEN parts[1] || '/' || parts[2] WHEN len(parts) = 2 THEN parts[1] END AS folder,
 path ILIKE '%.test.%' OR path ILIKE '%_test.%' OR path ILIKE '%.spec.%' AS test_like, regexp_matches(path, '\\.test\\.|_test\\.|\\.spec\\.') AS test_path,
 regexp_replace(regexp_replace(regexp_replace(path, '\\.test\\.', '.'), '_test\\.', '.'), '\\.spec\\.', '.') AS tested,
 NOT list_has_any(parts, [{', '.join(f"'{x}'" for x in P.IGNORED_FOLDERS)}]) AND NOT regexp_matches(path, '({'|'.join(x.replace('.', chr(92) * 2 + '.').replace(chr(92) * 2, chr(92)) for x in P.IGNORED_ENDINGS)})$') AND ({_LANG}) <> 'unknown' AS indexable,
 CASE WHEN starts_with(path, 'services') THEN regexp_replace(substr(path, 9), '^/+', '') ELSE path END AS relative, regexp_matches(path, '^.*/src/[^/]*\\.ts$') AS globbed FROM f
"""


def symbol_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("id", "name", "kind", "file_id").distinct()
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct()
    n = F.col("name")
    return s.join(f, "file_id").select("id", P.symbol_summary(n, F.col("kind"), F.col("path")).alias("summary"), P.kind_tag(F.col("kind")).alias("tag"), F.array_join(P.identifier_words(n), " ").alias("words"))


SYMBOL_LABELS = """
WITH s AS (SELECT DISTINCT s.id, s.name, s.kind, f.path, string_split(f.path, '/') AS parts FROM symbols s JOIN (SELECT DISTINCT id, path FROM files) f ON s.file_id = f.id),
w AS (SELECT *, array_to_string(list_transform(CASE WHEN contains(name, '_') THEN list_filter(string_split(name, '_'), lambda x: x <> '')
   ELSE string_split(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ') END, lambda x: lower(x)), ' ') AS words FROM s),
t AS (SELECT id, words, kind, CASE WHEN len(parts) >= 2 THEN '[' || parts[-2] || '] ' ELSE '' END || kind || ': ' || words AS t FROM w)
SELECT id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS summary,
  CASE WHEN kind IN ('function', 'method') THEN 'f:' WHEN kind = 'class' THEN 'c:' WHEN kind = 'interface' THEN 'i:' WHEN kind = 'type' THEN 't:' WHEN kind IN ('variable', 'constant') THEN 'v:' WHEN kind = 'enum' THEN 'e:' ELSE '' END AS tag, words FROM t
"""


def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.truncate_shell(t, 5, 5, 60).alias("shell"), T.truncate_search(t, 6, 50).alias("search"), T.truncate_fetch(t, 400).alias("fetch"), T.clip_line(t, 100).alias("clip"),
        T.trim_to_tokens(t, 60, "low").alias("low"), T.trim_to_tokens(t, 60, "medium").alias("medium"), T.trim_to_tokens(t, 60, "high").alias("high"),
        T.estimated_tokens(t).alias("tokens"), T.estimated_tokens(t, 3.5).alias("graph_tokens"),
    )


def _sql_clip(most: int) -> str:
    return f"list_transform(raw, lambda x: CASE WHEN length(x) > {most} THEN left(x, {most}) || '...[' || (length(x) - {most}) || ' more chars truncated]' ELSE x END)"


def _sql_long(most: int) -> str:
    n = f"len(list_filter(raw, lambda x: length(x) > {most}))"
    return f"CASE WHEN {n} > 0 THEN '; ' || {n} || ' long lines clipped' ELSE '' END"


def _sql_trim(lines: str) -> str:
    fit = f"len(list_filter(range(1, len({lines}) + 1), lambda i: list_sum(list_transform(({lines})[1:i], lambda x: length(x) + 1)) <= 240))"
    return f"CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 240 THEN text ELSE array_to_string(({lines})[1:{fit}], {_LF}) || CASE WHEN {fit} = 0 THEN '...' WHEN {fit} < len({lines}) THEN {_LF} || '...' ELSE '' END END"


TRUNCATED_TEXTS = f"""
WITH r AS (SELECT doc_id, text, string_split(text, {_LF}) AS raw FROM documents),
c AS (SELECT *, {_sql_clip(60)} AS a, {_sql_clip(50)} AS b FROM r)
SELECT doc_id,
 array_to_string(CASE WHEN len(raw) <= 10 THEN a ELSE a[1:5] || ['...[' || (len(raw) - 10) || ' lines hidden' || {_sql_long(60)} || ']...'] || a[-5:] END, {_LF}) AS shell,
 array_to_string(CASE WHEN len(raw) <= 6 THEN b ELSE b[1:6] || ['...[' || (len(raw) - 6) || ' more matches truncated'
   || CASE WHEN len(list_filter(b, lambda x: instr(x, ':') > 1)) > 0 THEN ' across ' || len(list_distinct(list_transform(list_filter(b, lambda x: instr(x, ':') > 1), lambda x: split_part(x, ':', 1)))) || ' files' ELSE '' END || {_sql_long(50)} || ']'] END, {_LF}) AS search,
 CASE WHEN length(text) > 400 THEN left(text, 400) || {_LF} || '...[' || (length(text) - 400) || ' chars truncated]' ELSE text END AS fetch,
 CASE WHEN length(text) > 100 THEN left(text, 100) || '...[+' || (length(text) - 100) || ' chars]' ELSE text END AS clip,
 CASE WHEN length(text) > 240 THEN left(text, 240) || '...' ELSE text END AS low, {_sql_trim('raw[1:len(raw) - CAST(floor(len(raw) * 0.2) AS BIGINT)]')} AS medium, {_sql_trim('raw')} AS high,
 CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3.5) AS BIGINT) AS graph_tokens FROM c
"""


def line_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "content").distinct()
    return c.select("id", T.anchored_view(F.col("content")).alias("view"), T.scope_hash(F.col("id")).alias("scope"))


LINE_HASHES = f"""
SELECT DISTINCT id, CASE WHEN content = '' THEN '' ELSE array_to_string(list_transform(string_split(CASE WHEN ends_with(content, {_LF}) THEN left(content, length(content) - 1) ELSE content END, {_LF}),
  lambda x, i: i || '#' || left(sha256(x), 8) || ': ' || x), {_LF}) END AS view, left(sha256(id), 16) AS scope FROM chunks
"""


def slop_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    found = lines.select("doc_id", "line", T.slop_category(F.trim("s")).alias("category")).where("category is not null")
    return found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("lines"))


def _sql_any(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


SLOP_LINES = f"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, {_LF})), ' ') AS s FROM documents),
c AS (SELECT doc_id, CASE {' '.join(f"WHEN {_sql_any('s', p)} THEN '{c}'" for c, p in T.SLOP_RULES)} END AS category FROM l WHERE length(s) >= 5)
SELECT doc_id, category, count(*) AS lines FROM c WHERE category IS NOT NULL GROUP BY ALL
"""


def intents(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.traits(F.col("text")).alias("s"))
    i = rows.select("doc_id", T.intent(s).alias("i"), T.complexity(s).alias("complexity"), T.conversation_type(s).alias("kind"), T.scope_of(s).alias("scope"))
    return i.select("doc_id", "i.tag", "i.role", F.round("i.confidence", 9).alias("confidence"), "complexity", "kind", "scope", T.gate_passes(F.col("i"), F.col("complexity"), F.lit("reviewer")).alias("passes"))


def _sql_intents() -> str:
    cols = ", ".join(f"({' + '.join(f'CAST({_sql_any("text", p)} AS INT)' for p in ps)}) * {w} AS s{k}" for k, (_, _, w, ps) in enumerate(T.INTENTS))
    n = len(T.INTENTS)
    best, total = f"greatest({', '.join(f's{k}' for k in range(n))})", " + ".join(f"s{k}" for k in range(n))
    tag = "CASE WHEN best <= 0 THEN 'unknown' " + " ".join(f"WHEN s{k} = best THEN '{t[0]}'" for k, t in enumerate(T.INTENTS)) + " END"
    role = "CASE WHEN best <= 0 THEN 'builder' " + " ".join(f"WHEN s{k} = best THEN '{t[1]}'" for k, t in enumerate(T.INTENTS)) + " END"
    refs = f"len(regexp_extract_all(text, '{T.FILE_REFERENCE}'))"
    return f"""
WITH a AS (SELECT doc_id, text, {cols}, {refs} AS refs, len(regexp_split_to_array(text, '\\s+')) AS words, {_sql_any('text', T.ARCHITECTURE)} AS arch, {_sql_any('text', T.MANY_FILES)} AS many,
   regexp_matches(text, '(?im){T.QUESTION[4:]}') AS asks, regexp_matches(text, '(?im){T.COMMAND[4:]}') AS tells FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, {best} AS best, {total} AS total FROM a),
c AS (SELECT *, {tag} AS tag0, {role} AS role0, CASE WHEN asks AND tells THEN 'mixed' WHEN asks THEN 'question' ELSE 'command' END AS kind,
   CASE WHEN arch THEN 'architectural' WHEN many OR refs > 2 THEN 'multi-file' ELSE 'single-file' END AS scope,
   CASE WHEN arch OR words > 150 THEN 'architectural' WHEN many OR refs > 3 OR words > 80 THEN 'complex' WHEN refs > 1 OR words > 30 THEN 'moderate' WHEN words > 10 THEN 'simple' ELSE 'trivial' END AS complexity FROM b),
e AS (SELECT *, kind = 'question' AND scope = 'architectural' AND role0 <> 'reviewer' AND s1 > 0 AND s1 >= best * 0.6 AS re, kind = 'command' AND scope = 'architectural' AND tag0 = 'implement' AS pl FROM c),
g AS (SELECT doc_id, CASE WHEN re THEN 'research' WHEN pl THEN 'plan' ELSE tag0 END AS tag, CASE WHEN re THEN 'reviewer' WHEN pl THEN 'planner' ELSE role0 END AS role,
   CASE WHEN total > 0 THEN CAST(CASE WHEN re THEN s1 ELSE best END AS DOUBLE) / total ELSE 0 END AS conf, complexity, kind, scope FROM e)
SELECT doc_id, tag, role, round(conf, 9) AS confidence, complexity, kind, scope, conf < 0.5 OR role = 'reviewer' OR (complexity = 'trivial' AND tag IN ('quick-fix', 'unknown')) AS passes FROM g
"""


def message_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message")
    log = table(spark, d, "forge_log").where("message is not null").select("line_id", "message").distinct()
    return log.select("line_id", T.error_kind(m).alias("error"), T.base_command(m).alias("program"), T.shell_reason(m, F.array(F.lit("Caused"), F.lit("quoted:"))).alias("reason"))


MESSAGE_KINDS = f"""
WITH m AS (SELECT DISTINCT line_id, message, trim(split_part(regexp_replace(regexp_replace(regexp_replace(trim(message, ' '), '^(?:[A-Za-z_][A-Za-z0-9_]*=\\S+\\s+)+', ''), '[|;&]', chr(1), 'g'), '^$', ''), chr(1), 1), ' ') AS seg FROM forge_log WHERE message IS NOT NULL),
p AS (SELECT *, CASE WHEN length(seg) > 0 THEN regexp_split_to_array(seg, '\\s+')[1] END AS program FROM m)
SELECT line_id, CASE {' '.join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{k}'" for k, p in T.ERROR_KINDS)} ELSE 'unknown' END AS error, program,
 CASE WHEN program IS NULL THEN 'unparseable' WHEN {' OR '.join(f"regexp_matches(message, '{p}')" for p in T.DANGEROUS)} THEN 'dangerous' WHEN program IN ('Caused', 'quoted:') THEN 'listed' ELSE 'not listed' END AS reason FROM p
"""


def rendered(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = F.concat(F.lit("order {{id}} of {{customer}}: {{state}} {{nobody}} {{id}} "), F.col("o_orderpriority"))
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey", T.render(t, {"id": key.cast("string"), "customer": F.col("o_custkey").cast("string"), "state": F.col("o_orderstatus")}).alias("text"), F.array_join(T.unknown_names(t, ["id", "state"]), ",").alias("unknown"),
        T.format_tokens(key).alias("tokens"), T.format_duration(key).alias("duration"), F.round(T.squash(F.col("o_totalprice")), 9).alias("squashed"), F.signum(T.compare_versions(F.concat_ws(".", F.pmod(key, F.lit(7)), F.pmod(key, F.lit(5))), F.lit("3.2.1"))).cast("int").alias("compared"),
        T.escape_xml(F.concat(F.lit("<a b=\"'&'\">"), F.col("o_orderpriority"))).alias("xml"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        T.window_around(F.col("o_orderpriority"), F.lit(3), F.lit(5), 2).alias("around"), T.partial_match(F.col("o_orderpriority"), "1-urgent").alias("match"),
    )


RENDERED = """
WITH v AS (SELECT *, o_orderkey % 7 AS a, o_orderkey % 5 AS b FROM orders)
SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || o_custkey || ': ' || o_orderstatus || ' {{nobody}} ' || o_orderkey || ' ' || o_orderpriority AS text, 'customer,nobody' AS unknown,
 CASE WHEN o_orderkey >= 1000 THEN printf('%.1f', CASE WHEN o_orderkey % 1000 IN (250, 750) THEN (o_orderkey + 1) / 1000 ELSE o_orderkey / 1000 END) || 'k' ELSE CAST(o_orderkey AS VARCHAR) END AS tokens,
 CASE WHEN o_orderkey >= 60 THEN (o_orderkey // 60) || 'm ' || (o_orderkey % 60) || 's' ELSE o_orderkey || 's' END AS duration,
 round(1 - 1 / (1 + ln(1 + greatest(o_totalprice, 0))), 9) AS squashed,
 CAST(CASE WHEN a <> 3 THEN sign(a - 3) WHEN b <> 2 THEN sign(b - 2) ELSE -1 END AS INTEGER) AS compared, '&lt;a b=&quot;&apos;&amp;&apos;&quot;&gt;' || o_orderpriority AS xml, strftime(o_orderdate, '%Y-%m-%d') AS day,
 '…' || substr(o_orderpriority, 2, least(length(o_orderpriority), 7) - 1) || CASE WHEN length(o_orderpriority) > 7 THEN '…' ELSE '' END AS around,
 CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 2 WHEN contains(lower(o_orderpriority), '1-urgent') THEN 1 ELSE 0 END AS match FROM v
"""

QUERIES = {f.__name__: f for f in (path_features, symbol_labels, truncated_texts, line_hashes, slop_lines, intents, message_kinds, rendered)}
SQL = {"path_features": PATH_FEATURES, "symbol_labels": SYMBOL_LABELS, "truncated_texts": TRUNCATED_TEXTS, "line_hashes": LINE_HASHES, "slop_lines": SLOP_LINES, "intents": _sql_intents(), "message_kinds": MESSAGE_KINDS, "rendered": RENDERED}
