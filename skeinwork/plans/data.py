"""Queries of the key-value, telemetry, version, clone, retrieval, session, community and export operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import clones as C
from skeinwork.operators import community as K
from skeinwork.operators import export as X
from skeinwork.operators import kv as V
from skeinwork.operators import retrieval as R
from skeinwork.operators import sessions as S
from skeinwork.operators import telemetry as L
from skeinwork.operators import versioning as H
from skeinwork.operators.cooccurrence import cooccurring
from skeinwork.plans.graph import RARE, WHOLE, part_flow, rare_flow
from skeinwork.runtime import stored
from skeinwork.sources import readers as D
from skeinwork.sources.tables import table

WEEK = 7 * 86_400_000


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as writes to a store: a key per user and type that expires a week on; every fifth kind of value deletes."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(7)).cast("string")).alias("project_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("props")).alias("data"), (at + WEEK).alias("expires_at"), at.alias("updated_at"), "event_id",
    )


_LOG = """
log AS (SELECT 'p' || (user_id % 7) AS project_id, user_id || ':' || event_type AS key, CASE WHEN event_id % 5 <> 0 THEN props END AS data, (epoch_us(ts) // 1000) + 604800000 AS expires_at, (epoch_us(ts) // 1000) AS updated_at, event_id FROM events),
now AS (SELECT max(updated_at) AS now FROM log),
cur AS (SELECT * FROM (SELECT *, min(updated_at) OVER (PARTITION BY project_id, key) AS created_at, row_number() OVER (PARTITION BY project_id, key ORDER BY updated_at DESC, event_id DESC) AS r FROM log) WHERE r = 1 AND data IS NOT NULL)"""


def _now(log: DataFrame) -> int:
    return log.agg(F.max("updated_at")).first()[0]


def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return V.visible(V.latest(log, tie="event_id"), _now(log))


KV_LATEST = f"WITH {_LOG} SELECT project_id, key, data, expires_at, created_at, updated_at FROM cur WHERE expires_at > (SELECT now FROM now)"


def kv_prefix(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return V.list_keys(V.latest(log, tie="event_id"), "p1", _now(log), "1").select("key", "updated_at")


KV_PREFIX = f"WITH {_LOG} SELECT key, updated_at FROM cur WHERE project_id = 'p1' AND starts_with(key, '1') AND expires_at > (SELECT now FROM now)"


def kv_purged(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return V.purge(V.latest(log, tie="event_id"), _now(log)).groupBy("project_id").agg(F.count(F.lit(1)).alias("keys"))


KV_PURGED = f"WITH {_LOG} SELECT project_id, count(*) AS keys FROM cur WHERE expires_at >= (SELECT now FROM now) GROUP BY 1"


def plan_headings(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "documents").where("lower(trim(source)) = 'plan'").select(F.col("doc_id").alias("key"), F.col("text").alias("data"))
    return V.plan_lines(plans, "^#+ ")


PLAN_HEADINGS = """
WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE lower(trim(source)) = 'plan')
SELECT key, CAST(line AS INTEGER) AS line, text FROM l WHERE regexp_matches(text, '^#+ ')
"""


def plan_edits(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", V.plan_edit(t, "the ", "THE ", 0).alias("every"), V.plan_edit(t, "the ", "THE ", 2).alias("second"), V.plan_edit(t, "because", "BECAUSE").alias("only"), V.plan_append(t, F.lit("Next"), F.col("source")).alias("longer"))


PLAN_EDITS = """
WITH p AS (SELECT *, string_split(text, 'the ') AS t, string_split(text, 'because') AS b FROM documents)
SELECT doc_id, CASE WHEN len(t) > 1 THEN replace(text, 'the ', 'THE ') END AS every, CASE WHEN len(t) > 2 THEN array_to_string(t[1:2], 'the ') || 'THE ' || array_to_string(t[3:], 'the ') END AS second,
 CASE WHEN len(b) = 2 THEN b[1] || 'BECAUSE' || b[2] END AS only, left(text || chr(10) || chr(10) || '## Next' || chr(10) || source, 8000) AS longer FROM p
"""


def archive_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", V.archived(F.col("text")).alias("a")).select("doc_id", "a.preview", "a.archived", "a.chars", "a.id")


ARCHIVE_PREVIEWS = "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS preview, length(text) > 4096 AS archived, length(text) AS chars, left(sha256(text), 16) AS id FROM documents WHERE text IS NOT NULL"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderkey") % 3000 == 0, "running").when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))


def tasks_admitted(spark: SparkSession, d: str) -> DataFrame:
    return V.admitted(_tasks(spark, d), 40, 9).select("id", "model")


TASKS_ADMITTED = """
WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS model, CASE WHEN o_orderkey % 3000 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status, o_orderdate AS created_at FROM orders),
u AS (SELECT model, count(*) AS used FROM t WHERE status = 'running' GROUP BY 1),
q AS (SELECT t.*, row_number() OVER (PARTITION BY t.model ORDER BY created_at, id) + coalesce(used, 0) AS k FROM t LEFT JOIN u ON u.model = t.model WHERE status = 'pending'),
f AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS n FROM q WHERE k <= 9)
SELECT id, model FROM f WHERE n <= 40 - (SELECT count(*) FROM t WHERE status = 'running')
"""


def telemetry_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.event_stats(table(spark, d, "telemetry_events").distinct())


TELEMETRY_STATS = """
WITH e AS (SELECT DISTINCT * FROM telemetry_events)
SELECT type, count(*) AS events, min(timestamp) AS first, max(timestamp) AS last FROM e WHERE type IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*), min(timestamp), max(timestamp) FROM e
"""


def telemetry_last(spark: SparkSession, d: str) -> DataFrame:
    return L.query_events(table(spark, d, "telemetry_events").distinct(), 50, since=1_770_000_000_000, until=1_800_000_000_000, type="undo").select("id", "timestamp")


TELEMETRY_LAST = "SELECT DISTINCT id, timestamp FROM telemetry_events WHERE type = 'undo' AND timestamp BETWEEN 1770000000000 AND 1800000000000 ORDER BY timestamp DESC, id DESC LIMIT 50"


def telemetry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = L.outcome_report(table(spark, d, "telemetry_events").distinct())
    return o.withColumn("rate", F.round("rate", 9))


TELEMETRY_OUTCOMES = """
WITH e AS (SELECT *, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.status') END AS status FROM (SELECT DISTINCT * FROM telemetry_events)),
c AS (SELECT count(*) FILTER (WHERE type = 'loop_outcome' AND status IN ('completed', 'success')) AS g, count(*) FILTER (WHERE type = 'loop_outcome' AND status NOT IN ('completed', 'success')) AS b,
 count(*) FILTER (WHERE type = 'fallback') AS f, count(*) FILTER (WHERE type = 'undo') AS u FROM e)
SELECT g AS successes, b AS failures, round(g / CAST(g + b AS DOUBLE), 9) AS rate, f AS fallbacks, u AS undos FROM c
"""


def telemetry_kept(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "telemetry_events").distinct()
    now = 1_780_000_000_000
    return L.kept(e, now).agg(F.count(F.lit(1)).alias("kept")).crossJoin(L.expired(e, now).agg(F.count(F.lit(1)).alias("expired")))


TELEMETRY_KEPT = "SELECT count(*) FILTER (WHERE timestamp >= 1777408000000) AS kept, count(*) FILTER (WHERE timestamp < 1777408000000) AS expired FROM (SELECT DISTINCT * FROM telemetry_events)"


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return H.symbol_hashes(table(spark, d, "files"), table(spark, d, "symbols")).select("path", "hash", "symbol_count")


_HASHES = """
s AS (SELECT file_id, string_agg(name || ':' || line, '|' ORDER BY line, name) AS t FROM (SELECT DISTINCT file_id, name, line, id FROM symbols) GROUP BY 1),
h AS (SELECT path, sha256(coalesce(t, '')) AS hash, symbol_count, pagerank FROM (SELECT DISTINCT id, path, symbol_count, pagerank FROM files) f LEFT JOIN s ON s.file_id = f.id)"""
FILE_HASHES = f"WITH {_HASHES} SELECT path, hash, symbol_count FROM h"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An earlier version of the files, in which those of some symbol counts were absent or other."""
    after = H.symbol_hashes(table(spark, d, "files"), table(spark, d, "symbols"))
    n = F.col("symbol_count")
    before = after.where(n % 7 != 3).withColumn("hash", F.when(n % 5 == 1, F.sha2(F.col("path").cast("binary"), 256)).otherwise(F.col("hash")))
    return before, after.where(n % 11 != 2)


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    return H.diff_hashes(*_versions(spark, d))


_VERSIONS = f"{_HASHES}, b AS (SELECT path, CASE WHEN symbol_count % 5 = 1 THEN sha256(path) ELSE hash END AS hash FROM h WHERE symbol_count % 7 <> 3), a AS (SELECT path, hash FROM h WHERE symbol_count % 11 <> 2)"
VERSION_DIFF = f"WITH {_VERSIONS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path"


def folder_roots(spark: SparkSession, d: str) -> DataFrame:
    return H.folder_hashes(H.symbol_hashes(table(spark, d, "files"), table(spark, d, "symbols")))


_DEEP = 12
FOLDER_ROOTS = (
    f"WITH {_HASHES}, f AS (SELECT path, max(hash) AS hash FROM h GROUP BY 1),\n"
    "k AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, 0 AS r, split_part(path, '/', -1) AS name, 'file:' || split_part(path, '/', -1) || ':' || hash AS t FROM f),\n"
    + ",\n".join(
        f"d{n} AS (SELECT folder AS path, sha256(string_agg(t, chr(10) ORDER BY r, name)) AS hash FROM (SELECT * FROM k WHERE CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END = {n}"
        + (f" UNION ALL SELECT regexp_replace(path, '/?[^/]*$', ''), 1, split_part(path, '/', -1), 'dir:' || split_part(path, '/', -1) || ':' || hash FROM d{n + 1}" if n < _DEEP else "")
        + ") GROUP BY 1)"
        for n in range(_DEEP, -1, -1)
    )
    + "\n"
    + " UNION ALL ".join(f"SELECT path, hash FROM d{n}" for n in range(_DEEP + 1))
)


def folders_skipped(spark: SparkSession, d: str) -> DataFrame:
    before, after = _versions(spark, d)
    same = H.diff_hashes(H.folder_hashes(before), H.folder_hashes(after)).where("change = 'unchanged'")
    return H.skippable(after.select("path"), same)


def document_copies(spark: SparkSession, d: str) -> DataFrame:
    return C.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


DOCUMENT_COPIES = "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_texts").select(F.col("file_id").alias("id"), C.tokens(F.col("content")).alias("tokens"))
    return t.select("id", F.size("tokens").alias("n"), F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("hash"))


_TOKENS = f"""
tok AS (SELECT file_id AS id, list_transform(regexp_extract_all(content, '({C.TOKEN.replace("'", "''")})'), lambda t: CASE WHEN regexp_matches(t, '^["''`]') THEN '$S' WHEN regexp_matches(t, '^[0-9]') THEN '$N'
  WHEN regexp_matches(t, '^[a-zA-Z_$]') THEN CASE WHEN list_contains([{', '.join(f"'{k}'" for k in C.KEYWORDS)}], t) THEN t ELSE '$I' END ELSE t END) AS tokens FROM source_texts)"""
CODE_TOKENS = f"WITH {_TOKENS} SELECT id, len(tokens) AS n, sha256(array_to_string(tokens, ' ')) AS hash FROM tok"


def code_fragments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_texts").select(F.col("file_id").alias("id"), C.tokens(F.col("content")).alias("tokens"))
    f = C.fragments(t)
    return f.groupBy("hash").agg(F.countDistinct("id").alias("files"), F.count(F.lit(1)).alias("places")).where("files > 1")


CODE_FRAGMENTS = f"""
WITH {_TOKENS}, w AS (SELECT id, sha256(array_to_string(tokens[k:k + 11], chr(0))) AS hash FROM (SELECT id, tokens, unnest(range(1, len(tokens) - 10)) AS k FROM tok WHERE len(tokens) >= 16))
SELECT hash, count(DISTINCT id) AS files, count(*) AS places FROM w GROUP BY 1 HAVING count(DISTINCT id) > 1
"""


def code_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by the class of their signature, and to how many other classes each is near."""
    t = table(spark, d, "source_texts").select("file_id", F.split("content", r"\r?\n").alias("l"), C.tokens(F.col("content")).alias("t"))
    s = table(spark, d, "symbols").select("id", "file_id", "line", "end_line").distinct().join(t, "file_id")
    rows = s.select("id", "file_id", C.symbol_tokens(F.col("t"), F.col("line"), F.col("end_line"), F.size("l")).alias("tokens"))
    members, links = C.near_classes(C.signatures(rows))
    links = stored(links, "links")
    n = links.select(F.col("class_a").alias("class")).union(links.select("class_b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(n, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def shapes_shared(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_texts").select("file_id", C.shape(F.col("content")).alias("shape_hash"))
    return s.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first")).where("copies > 1")


SHAPES_SHARED = "SELECT sha256(regexp_replace(content, '[^()\\[\\]{};]', '', 'g')) AS shape_hash, count(*) AS copies, min(file_id) AS first FROM source_texts GROUP BY 1 HAVING count(*) > 1"


def chunked_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.line_chunks(table(spark, d, "documents"), "doc_id", "text", 5, 1).withColumnRenamed("id", "doc_id")


CHUNKED_LINES = """
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, l, CAST(0 AS BIGINT) AS a FROM l UNION ALL SELECT doc_id, l, CASE WHEN least(a + 5, len(l)) - 1 <= a THEN least(a + 5, len(l)) ELSE least(a + 5, len(l)) - 1 END FROM c
  WHERE CASE WHEN least(a + 5, len(l)) - 1 <= a THEN least(a + 5, len(l)) ELSE least(a + 5, len(l)) - 1 END < len(l)),
o AS (SELECT doc_id, a + 1 AS start_line, least(a + 5, len(l)) AS end_line, array_to_string(l[a + 1:a + 5], chr(10)) AS content FROM c)
SELECT doc_id, start_line, end_line, content FROM o WHERE regexp_matches(content, '\\S')
"""


def chunks_split(spark: SparkSession, d: str) -> DataFrame:
    return R.split_chunks(table(spark, d, "chunks").select("id", "start_line", "content").distinct(), 1500)


def chunks_rolled(spark: SparkSession, d: str) -> DataFrame:
    return R.roll_up(table(spark, d, "chunks"))


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id 100 divides, against all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    return R.cosine_top(q, e, 10).select("query", "id", F.round("score", 7).alias("score"), "rank")


NEAREST_VECTORS = """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS query, b.id, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, round(score, 7) AS score, rank FROM r WHERE rank <= 10
"""
_QUERY = "merge the budget cache"


def word_search(spark: SparkSession, d: str) -> DataFrame:
    s = R.bm25(table(spark, d, "documents"), _QUERY, "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), F.round("score", 7).alias("score"))


_BM25 = """
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT unnest(['merge', 'the', 'budget', 'cache']) AS q), t AS (SELECT doc_id, q, len(list_filter(w, lambda x: x = q)) AS tf, len(w) AS n FROM w, q),
g AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), df AS (SELECT q, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1),
b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM t JOIN df ON df.q = t.q, g WHERE tf > 0 GROUP BY 1)"""
WORD_SEARCH = f"WITH {_BM25} SELECT doc_id, round(score, 7) AS score FROM b"


def fused_search(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents and the rank of their length, fused."""
    docs = table(spark, d, "documents")
    words = R.ranked(R.bm25(docs, _QUERY, "doc_id", "text").select("id", F.round("score", 7).alias("score")), 60)
    long = R.ranked(docs.where("text is not null").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("score")), 60)
    f = R.fuse({"words": words, "long": long})
    return f.select("id", F.round("score", 9).alias("score"), "words_rank", "long_rank")


FUSED_SEARCH = f"""
WITH {_BM25}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 7) DESC, doc_id) AS r FROM b), l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL),
u AS (SELECT id, r AS words_rank, NULL AS long_rank FROM a WHERE r <= 60 UNION ALL SELECT id, NULL, r FROM l WHERE r <= 60)
SELECT id, round(sum(1.0 / (60 + coalesce(words_rank, long_rank))), 9) AS score, min(words_rank) AS words_rank, min(long_rank) AS long_rank FROM u GROUP BY 1
"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type", "ts", "value")


def repeated_calls(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last events end in a repeated pattern."""
    return S.loops(_calls(spark, d), "session_id", ["ts", "event_id"], "event_type", 64, 3)


def running_budgets(spark: SparkSession, d: str) -> DataFrame:
    e = _calls(spark, d).withColumn("day", F.to_date("ts"))
    one = F.lit(1)
    b = S.budgets(e, "session_id", ["ts", "event_id"], "day", {"turns": 60, "failures": 2, "tokens": 3000}, {"turns": (one, False), "failures": ((F.col("event_type") == "error").cast("int"), True), "tokens": (F.floor("value"), False)})
    return b.select("event_id", "turns", "turns_state", "failures", "failures_state", "tokens", "tokens_state")


_STATE = "CASE WHEN {0} >= {1} THEN 'over' WHEN {0} >= {1} * 0.8 THEN 'warn' ELSE 'ok' END AS {0}_state"
RUNNING_BUDGETS = f"""
WITH c AS (SELECT event_id, count(*) OVER w AS turns, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER dd AS BIGINT) AS failures, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS tokens FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), dd AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, turns, {_STATE.format('turns', 60)}, failures, {_STATE.format('failures', 2)}, tokens, {_STATE.format('tokens', 3000)} FROM c
"""


def user_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = lambda t: F.sum((F.col("event_type") == t).cast("int"))
    g = e.groupBy("user_id").agg((F.sum(F.floor("value")) * 100).alias("chars"), n("view").alias("reads"), n("signup").alias("stale"), n("purchase").alias("large"), n("error").alias("refs"), F.count(F.lit(1)).alias("messages"), n("click").alias("decisions"))
    q = S.quality(F.col("chars"), F.col("reads"), F.col("stale"), F.col("large"), F.col("refs"), F.col("refs") % 3, F.col("reads") % 12, F.col("messages"), F.floor(F.col("decisions") / 4), F.col("large") % 4)
    return g.select("user_id", q.alias("q")).select("user_id", "q.score", "q.grade")


USER_QUALITY = """
WITH g AS (SELECT user_id, sum(floor(value)) * 100 AS chars, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'purchase') AS p,
  count(*) FILTER (WHERE event_type = 'error') AS e, count(*) AS m, floor(count(*) FILTER (WHERE event_type = 'click') / 4) AS dcs FROM events GROUP BY 1),
c AS (SELECT user_id, CAST(floor((1 - least(1.0, ceil(chars / 4) / 500000)) * 20 + (1 - least(1.0, CASE WHEN v > 0 THEN s / CAST(v AS DOUBLE) ELSE 0 END)) * 20 + (1 - least(1.0, CASE WHEN p > 0 THEN greatest(p - e, 0) / CAST(p AS DOUBLE) ELSE 0 END)) * 20
  + (1 - least(1.0, 1 - pow(0.4, greatest(e % 3, 1)))) * 15 + (1 - least(1.0, (v % 12) / 10.0)) * 10 + least(1.0, dcs / CAST(m AS DOUBLE) * 5) * 8 + (1 - least(1.0, (p % 4) / 3.0)) * 7 + 0.5) AS INTEGER) AS score FROM g)
SELECT user_id, score, CASE WHEN score >= 90 THEN 'S' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM c
"""


def fill_marks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("project_id is not null and text is not null").select("project_id", "doc_id", "text")
    return S.fill_checkpoints(docs, "project_id", ["doc_id"], F.length("text"), tokens=4000)


FILL_MARKS = """
WITH r AS (SELECT project_id, doc_id, floor(ceil(sum(length(text)) OVER (PARTITION BY project_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) / 4) / 4000 * 100 + 0.5) AS fill FROM documents WHERE project_id IS NOT NULL AND text IS NOT NULL)
SELECT project_id, mark, min(doc_id) AS doc_id FROM r, (SELECT unnest([20, 35, 50, 65, 80]) AS mark) WHERE fill >= mark GROUP BY 1, 2
"""


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.runs(_calls(spark, d), "session_id", ["ts", "event_id"], "event_type").groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"))


EVENT_RUNS = "WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (WHERE b IS DISTINCT FROM event_type) AS runs FROM r GROUP BY 1"


def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return S.debounced(e, "user_id", "at", 3_600_000).select("event_id", "user_id")


EVENT_BURSTS = "WITH g AS (SELECT event_id, user_id, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000)) - (epoch_us(ts) // 1000) AS g FROM events) SELECT event_id, user_id FROM g WHERE g >= 3600000 OR g IS NULL"


def session_sums(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "click", "assistant").otherwise("user")).withColumn("amount", F.floor("value"))
    t = S.session_totals(e, "user_id", "role", ["amount"])
    last = S.last_n(e, "user_id", ["ts", "event_id"], 3).groupBy("user_id").agg(F.max("event_id").alias("newest"), F.sum("amount").alias("recent"))
    return t.join(last, "user_id")


SESSION_SUMS = """
WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS messages, count(*) FILTER (WHERE event_type = 'click') AS answers, max(event_id) FILTER (WHERE k <= 3) AS newest, CAST(sum(amount) FILTER (WHERE k <= 3) AS BIGINT) AS recent FROM e GROUP BY 1
"""


def file_matches(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "forge_log").select("line_id", "message").distinct()
    return S.matches_per_file(lines, "message")


FILE_MATCHES = "SELECT split_part(message, ':', 1) AS file, count(*) AS matches FROM (SELECT DISTINCT line_id, message FROM forge_log) WHERE instr(message, ':') > 1 GROUP BY 1"


def extensions(spark: SparkSession, d: str) -> DataFrame:
    return D.extension_counts(table(spark, d, "files").select("path").distinct())


EXTENSIONS = "WITH n AS (SELECT split_part(path, '/', -1) AS n FROM (SELECT DISTINCT path FROM files)) SELECT CASE WHEN length(n) - length(split_part(n, '.', -1)) > 1 THEN lower(split_part(n, '.', -1)) ELSE '(none)' END AS extension, count(*) AS files FROM n GROUP BY 1"


def part_communities(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought together twice or more, by label propagation."""
    p = cooccurring(table(spark, d, "lineitem"), "l_orderkey", "l_partkey").select(F.col("item_a").alias("src"), F.col("item_b").alias("dst"), F.col("together").cast("double").alias("weight"))
    found = K.communities(p)
    return K.community_weights(p, found)


def part_bridges(spark: SparkSession, d: str) -> DataFrame:
    return K.bridges(part_flow(spark, d).select("src", "dst", F.col("n").cast("double").alias("weight")))


def _surprises(flow: DataFrame) -> DataFrame:
    e = flow.select("src", "dst", F.col("n").cast("double").alias("weight"))
    given = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("community", F.col("node") % 3)
    return K.surprises(e, given)


def part_surprises(spark: SparkSession, d: str) -> DataFrame:
    return _surprises(rare_flow(spark, d))


def part_surprises_all(spark: SparkSession, d: str) -> DataFrame:
    return _surprises(part_flow(spark, d))


PART_SURPRISES = f"""
WITH {RARE}, k AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM rare), cut AS (SELECT n FROM k WHERE k = greatest(0, CAST(floor(c * 0.25) AS BIGINT) - 1))
SELECT src, dst, CAST(n AS DOUBLE) AS weight FROM rare WHERE n <= (SELECT n FROM cut) AND src % 3 <> dst % 3
"""
PART_SURPRISES_ALL = PART_SURPRISES.replace(RARE, WHOLE)


def _texts(spark: SparkSession, d: str, flow: DataFrame) -> DataFrame:
    e = flow.select("src", "dst", F.col("n").alias("weight"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    parts = {"graphml": X.graphml(n, e), "mermaid": X.mermaid(n, e), "cypher": X.cypher(n, e, "Part", "NEXT")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("form"), "part", "nth", "line")
        out = df if out is None else out.union(df)
    return out


def graph_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, rare_flow(spark, d))


def graph_texts_all(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, part_flow(spark, d))


GRAPH_TEXTS = f"""
WITH {RARE}, n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS nth, replace(replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xname FROM part), e AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS nth FROM rare)
SELECT 'graphml' AS form, 0 AS part, CAST(nth AS BIGINT) AS nth, line FROM (SELECT unnest(range(0, 7)) AS nth, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.1/graphml.xsd">',
 '  <key id="n_brand" for="node" attr.name="brand" attr.type="string" />', '  <key id="n_size" for="node" attr.name="size" attr.type="double" />', '  <key id="n_label" for="node" attr.name="label" attr.type="string" />', '  <key id="e_weight" for="edge" attr.name="weight" attr.type="double" />', '  <graph id="G" edgedefault="directed">']) AS line)
UNION ALL SELECT 'graphml', 1, nth, '    <node id="' || p_partkey || '">' || chr(10) || '      <data key="n_label">' || xname || '</data>' || chr(10) || '      <data key="n_brand">' || p_brand || '</data>' || chr(10) || '      <data key="n_size">' || p_size || '</data>' || chr(10) || '    </node>' FROM n
UNION ALL SELECT 'graphml', 2, nth, '    <edge id="e' || nth || '" source="' || src || '" target="' || dst || '">' || chr(10) || '      <data key="e_weight">' || n || '</data>' || chr(10) || '    </edge>' FROM e
UNION ALL SELECT 'graphml', 3, 0, '  </graph>' UNION ALL SELECT 'graphml', 3, 1, '</graphml>' UNION ALL SELECT 'mermaid', 0, 0, 'flowchart LR'
UNION ALL SELECT 'mermaid', 1, nth, '  n_' || p_partkey || '["' || replace(p_name, '"', '#quot;') || '"]' FROM n
UNION ALL SELECT 'mermaid', 2, nth, '  n_' || src || CASE WHEN n = 1 THEN ' --> ' ELSE ' -->|' || n || '| ' END || 'n_' || dst FROM e
UNION ALL SELECT 'cypher', 1, nth, 'MERGE (:Part {{ path: ''' || p_partkey || ''', label: ''' || replace(replace(p_name, '\\', '\\\\'), '''', '\\''') || ''', brand: ''' || p_brand || ''', size: ' || p_size || ' }});' FROM n
UNION ALL SELECT 'cypher', 2, nth, 'MATCH (a:Part {{ path: ''' || src || ''' }}), (b:Part {{ path: ''' || dst || ''' }}) MERGE (a)-[:NEXT {{ weight: ' || n || ' }}]->(b);' FROM e
"""
GRAPH_TEXTS_ALL = GRAPH_TEXTS.replace(RARE, WHOLE)


def weekly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """An extension beyond the reference: events per week and type with subtotals."""
    e = table(spark, d, "events").withColumn("week", F.date_trunc("week", "ts"))
    return e.rollup("week", "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


WEEKLY_ROLLUP = "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ROLLUP (1, 2)"

_ALL = (kv_latest, kv_prefix, kv_purged, plan_headings, plan_edits, archive_previews, tasks_admitted, telemetry_stats, telemetry_last, telemetry_outcomes, telemetry_kept, file_hashes, version_diff, folder_roots, folders_skipped, document_copies, code_tokens, code_fragments, code_near_copies, shapes_shared, chunked_lines, chunks_split, chunks_rolled, nearest_vectors, word_search, fused_search, repeated_calls, running_budgets, user_quality, fill_marks, event_runs, event_bursts, session_sums, file_matches, extensions, part_communities, part_bridges, part_surprises, part_surprises_all, graph_texts, graph_texts_all, weekly_rollup)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
