"""Queries of stores, versions, clones, retrieval and sessions that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators import clones as C
from skeinwork.operators import context as X
from skeinwork.operators import kv as V
from skeinwork.operators import retrieval as R
from skeinwork.operators import sessions as S
from skeinwork.operators import versioning as H
from skeinwork.functions.text import error_kind
from skeinwork.plans import data as A
from skeinwork.runtime import session_dir
from skeinwork.sources import readers as D
from skeinwork.sources.tables import table


def kv_wild(spark: SparkSession, d: str) -> DataFrame:
    """Keys that begin with any sign, a 1 and, somewhere on, an s."""
    log = A._log(spark, d)
    return V.list_keys(V.latest(log, tie="event_id"), "p1", A._now(log), "_1%s", wild=True).select("key", "updated_at")


KV_WILD = f"WITH {A._LOG} SELECT key, updated_at FROM cur WHERE project_id = 'p1' AND key ILIKE '_1%s%' AND expires_at > (SELECT now FROM now)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    body = F.struct(F.col("o_orderpriority").alias("severity"), F.concat(F.lit("b"), F.col("o_custkey") % 5).alias("branch"), F.col("o_orderkey").alias("n"))
    key = F.concat(F.when(F.col("o_orderstatus") == "P", "note:").otherwise("review-finding:"), F.lit("src/f"), F.col("o_custkey") % 50, F.lit(".ts:"), F.col("o_orderkey"))
    return o.select(key.alias("key"), F.to_json(body).alias("data"))


def findings_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = _findings(spark, d)
    one = V.findings(rows, "src/f7.ts").select(F.lit("file").alias("how"), "file", "line")
    two = V.findings(rows, pattern="URGENT").select(F.lit("pattern").alias("how"), "file", "line")
    three = V.findings(V.branch_findings(rows, "b3")).select(F.lit("branch").alias("how"), "file", "line")
    return one.union(two).union(three)


FINDINGS_KEPT = """WITH f AS (SELECT 'src/f' || (o_custkey % 50) || '.ts' AS file, CAST(o_orderkey AS INTEGER) AS line, o_custkey % 5 AS b, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P')
SELECT 'file' AS how, file, line FROM f WHERE file = 'src/f7.ts' UNION ALL SELECT 'pattern', file, line FROM f WHERE contains(p, 'URGENT') UNION ALL SELECT 'branch', file, line FROM f WHERE b = 3"""


def _loop_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    loop = F.to_json(F.struct(F.concat(F.lit("loop"), k).alias("loopName"), F.when(k % 7 != 0, F.concat(F.lit("s"), F.col("o_custkey"))).alias("sessionId"), (F.col("o_orderstatus") == "O").alias("active"), F.when(k % 3 == 0, "auditing").alias("phase"), (k % 20).cast("int").alias("iteration"), (F.col("o_totalprice") * 10).cast("long").alias("totalTokens"), (k % 9 / 2.0).alias("totalCostUsd")))
    budget = F.to_json(F.struct(F.col("o_orderpriority").alias("agent"), F.concat(F.lit("s"), F.col("o_custkey")).alias("sessionId"), (F.lit(1_000_000_000) - k * 50).alias("updatedAt"), F.struct((k % 8).alias("turns"), (k * 3).alias("tokensUsed")).alias("state")))
    data = F.when(k % 13 == 0, "{broken").when(k % 2 == 0, loop).otherwise(budget)
    return o.select(F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("project_id"), F.concat(F.when(k % 2 == 0, "loop:").otherwise("budget:"), k).alias("key"), data.alias("data"), (F.lit(1_000_000_000) + k % 5 - 2).alias("expires_at"))


_LOOPS = "o AS (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 13 <> 0 AND o_custkey % 3 = 1 AND o_orderkey % 5 > 2)"


def loops_over(spark: SparkSession, d: str) -> DataFrame:
    """Loops that are kept, with the first limit each exceeds, and as they stand once their host has gone."""
    s = X.loop_states(_loop_rows(spark, d), 1_000_000_000, "p1")
    s = s.withColumn("limit", V.loop_reason(F.col("iteration"), F.col("tokens"), F.col("cost"), 18, 2_000_000, 3.5))
    return V.ended(s, "now").select("key", "name", "session_id", "active", "phase", "iteration", "most_iterations", "limit", "completed", "reason")


LOOPS_OVER = f"""WITH {_LOOPS} SELECT 'loop:' || k AS key, 'loop' || k AS name, 's' || o_custkey AS session_id, false AS active, CASE WHEN k % 3 = 0 THEN 'auditing' ELSE 'coding' END AS phase, CAST(k % 20 AS INTEGER) AS iteration, 0 AS most_iterations,
 CASE WHEN k % 20 >= 18 THEN 'iterations' WHEN CAST(trunc(o_totalprice * 10) AS BIGINT) >= 2000000 THEN 'tokens' WHEN k % 9 / 2 >= 3.5 THEN 'cost' END AS "limit", CASE WHEN o_orderstatus = 'O' THEN 'now' END AS completed, CASE WHEN o_orderstatus = 'O' THEN 'shutdown' END AS reason FROM o WHERE k % 2 = 0 AND k % 7 <> 0"""


def budgets_shown(spark: SparkSession, d: str) -> DataFrame:
    return X.fresh_budgets(_loop_rows(spark, d), 1_000_000_000, "p1")


BUDGETS_SHOWN = f"WITH {_LOOPS} SELECT 'budget:' || k AS key, o_orderpriority AS agent, 's' || o_custkey AS session_id, 1000000000 - k * 50 AS updated_at, k % 8 AS turns, k * 3 AS tokens FROM o WHERE k % 2 = 1 AND k * 50 <= 600000"


def tasks_shown(spark: SparkSession, d: str) -> DataFrame:
    t = A._tasks(spark, d).select("id", F.col("model").alias("target_agent"), "status", F.concat(F.lit("task "), F.col("id")).alias("summary"), "created_at")
    return X.open_tasks(t)


TASKS_SHOWN = "SELECT o_orderkey AS id, o_orderpriority AS target_agent, CASE WHEN o_orderkey % 3000 = 0 THEN 'running' ELSE 'pending' END AS status, 'task ' || o_orderkey AS summary FROM orders WHERE o_orderkey % 3000 = 0 OR o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"


def files_undone(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.struct("o_orderdate", "o_orderkey").alias("taken_at"), F.col("o_orderkey").alias("data"))
    return V.undo(s, 2).select("file", "data")


FILES_UNDONE = "SELECT o_custkey AS file, o_orderkey AS data FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2"


def _tops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, s = table(spark, d, "files"), table(spark, d, "symbols")
    return H.top_symbols(f.withColumn("pagerank", F.when(F.col("id") % 3 == 0, F.col("pagerank") / 2).otherwise(F.col("pagerank"))), s), H.top_symbols(f, s)


def symbols_on_top(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d)[1]


_TOP = "(SELECT name, path, {} AS pagerank FROM (SELECT DISTINCT id, file_id, name FROM symbols) s JOIN (SELECT DISTINCT id AS fid, path, pagerank FROM files) f ON f.fid = s.file_id ORDER BY 3 DESC, name, path LIMIT 50)"
SYMBOLS_ON_TOP = f"FROM {_TOP.format('pagerank')}"


def ranks_changed(spark: SparkSession, d: str) -> DataFrame:
    return H.diff_ranks(*_tops(spark, d))


RANKS_CHANGED = f"""WITH b AS (FROM {_TOP.format('CASE WHEN fid % 3 = 0 THEN pagerank / 2 ELSE pagerank END')}), a AS (FROM {_TOP.format('pagerank')})
SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, b.pagerank AS before, a.pagerank AS after, coalesce(a.pagerank, 0) - coalesce(b.pagerank, 0) AS delta FROM b FULL JOIN a ON a.path = b.path AND a.name = b.name
WHERE a.pagerank IS DISTINCT FROM b.pagerank ORDER BY abs(delta) DESC, 1, 2 LIMIT 25"""


def counts_changed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").distinct()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols"), F.sum("line_count").alias("lines"))
    return H.stat_deltas(count(f.where("id % 9 <> 0")), count(f))


COUNTS_CHANGED = "SELECT count(*) AS files_delta, CAST(sum(symbol_count) AS BIGINT) AS symbols_delta, CAST(sum(line_count) AS BIGINT) AS lines_delta FROM (SELECT DISTINCT * FROM files) WHERE id % 9 = 0"


def _roots_sql(name: str, of: str) -> str:
    deep = A._DEEP
    out = [f"{name}k AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, 0 AS r, split_part(path, '/', -1) AS name, 'file:' || split_part(path, '/', -1) || ':' || hash AS t FROM (SELECT path, max(hash) AS hash FROM {of} GROUP BY 1))"]
    for n in range(deep, -1, -1):
        up = f" UNION ALL SELECT regexp_replace(path, '/?[^/]*$', ''), 1, split_part(path, '/', -1), 'dir:' || split_part(path, '/', -1) || ':' || hash FROM {name}{n + 1}" if n < deep else ""
        out.append(f"{name}{n} AS (SELECT folder AS path, sha256(string_agg(t, chr(10) ORDER BY r, name)) AS hash FROM (SELECT * FROM {name}k WHERE CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END = {n}{up}) GROUP BY 1)")
    return ",\n".join([*out, f"{name} AS ({' UNION ALL '.join(f'SELECT path, hash FROM {name}{n}' for n in range(deep + 1))})"])


def folder_changes(spark: SparkSession, d: str) -> DataFrame:
    before, after = A._versions(spark, d)
    return H.diff_hashes(H.folder_hashes(before), H.folder_hashes(after))


_BOTH = f"{A._VERSIONS}, {_roots_sql('x', 'b')}, {_roots_sql('y', 'a')}"
FOLDER_CHANGES = f"WITH {_BOTH} SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'removed' WHEN x.hash = y.hash THEN 'unchanged' ELSE 'changed' END AS change FROM x FULL JOIN y ON x.path = y.path"
FOLDERS_SKIPPED = f"""WITH {_BOTH}, alike AS (SELECT x.path FROM x JOIN y ON x.path = y.path AND x.hash = y.hash)
SELECT DISTINCT a.path FROM a JOIN alike ON alike.path = '' OR starts_with(a.path, alike.path || '/')"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m, v=1: F.when(k % m == 0, 0).otherwise(k * v)
    return table(spark, d, "orders").select("o_orderkey", (k % 11 != 0).alias("recorded"), n(5).alias("files"), (k * 10).alias("symbols"), n(2).alias("edges"), n(2).alias("calls"), n(10).alias("files_now"), (k % 4 + 10).alias("latest_now"), F.when(k % 17 != 0, n(10) + (k % 19 == 0).cast("int")).alias("files_then"), F.lit(12).alias("latest_then"))


def scans_needed(spark: SparkSession, d: str) -> DataFrame:
    return H.scan_reason(_states(spark, d)).select("o_orderkey", "scan", "reason")


SCANS_NEEDED = """SELECT o_orderkey, CASE WHEN k % 11 = 0 THEN true WHEN k % 10 = 5 THEN true WHEN k % 10 = 0 THEN false WHEN k % 17 = 0 OR k % 19 = 0 OR k % 4 = 3 THEN true WHEN k >= 50 AND k % 2 = 0 THEN true ELSE false END AS scan,
 CASE WHEN k % 11 = 0 THEN 'no record' WHEN k % 10 = 5 THEN 'empty index' WHEN k % 10 = 0 THEN 'empty folder' WHEN k % 17 = 0 THEN 'no fingerprint' WHEN k % 19 = 0 THEN 'other number of files' WHEN k % 4 = 3 THEN 'later changes' WHEN k >= 50 AND k % 2 = 0 THEN 'unhealthy' ELSE 'fresh' END AS reason
FROM (SELECT *, o_orderkey AS k FROM orders)"""


def seeds_usable(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k, F.col("o_custkey").alias("files"), (F.col("o_custkey") + (k % 3 == 0).cast("int")).alias("recorded_files"), F.when(k % 5 != 0, k).alias("fingerprint"), F.when(k % 5 != 0, k + (k % 7 == 0).cast("int")).alias("recorded_fingerprint"))
    return H.seed_is_valid(c).select("o_orderkey", "valid")


SEEDS_USABLE = "SELECT o_orderkey, o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0) AS valid FROM orders"


def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of files, saved under a label and read again."""
    h = H.symbol_hashes(table(spark, d, "files"), table(spark, d, "symbols")).select("path", "hash")
    D.save_snapshot(h, f"{session_dir(spark)}/snapshots", " v1: of today")
    return D.load_snapshot(spark, f"{session_dir(spark)}/snapshots", "v1--of-today".replace("--", ": "))


SNAPSHOT_READ = f"WITH {A._HASHES} SELECT path, hash FROM h"


def reads_answered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a file as what is read of it one time after another."""
    c = table(spark, d, "chunks").select("id", "file_path", "start_line", "content").where("content is not null and length(content) < 4000 and file_path is not null").distinct()
    seq = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))
    reads = c.select(F.lit("s").alias("session_id"), seq.alias("seq"), F.col("file_path").alias("path"), F.floor(seq / 2).alias("mtime"), "content")
    return X.read_answers(reads).select("path", "seq", "answer", F.length("delta").alias("chars"))


def todos_changed(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's open orders as a list, and when it changes."""
    o = table(spark, d, "orders")
    one = lambda n: F.struct(F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed").alias("status"), F.concat(F.lit(n), F.col("o_orderpriority")).alias("content"))
    lists = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.array(one("b"), one("a")).alias("todos"))
    return S.pending_changes(lists).select("session_id", "seq", F.size("pending").alias("n"))


TODOS_CHANGED = """WITH l AS (SELECT o_custkey AS s, o_orderkey AS seq, o_orderstatus || o_orderpriority AS k FROM orders WHERE o_orderstatus IN ('O', 'P')) SELECT s AS session_id, seq, 2 AS n FROM (SELECT *, lag(k) OVER (PARTITION BY s ORDER BY seq) AS b FROM l) WHERE k IS DISTINCT FROM b"""


def users_nudged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.floor("value").cast("int").alias("score"), (F.col("event_type") == "signup").alias("compacted"))
    return S.nudges(e, 20, 86_400_000 * 3, 4).where("nudge").select("session_id", "at")


USERS_NUDGED = """
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS s, epoch_us(ts) // 1000 AS t FROM events WHERE floor(value) < 20 AND event_type <> 'signup'),
w AS (SELECT s, min(t) AS t, 1 AS n FROM e GROUP BY 1 UNION ALL SELECT w.s, (SELECT min(e.t) FROM e WHERE e.s = w.s AND e.t >= w.t + 259200000), n + 1 FROM w WHERE n < 4 AND w.t IS NOT NULL)
SELECT s AS session_id, t AS "at" FROM w WHERE t IS NOT NULL
"""


def quality_marks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("score", F.lit(100) - F.col("value"))
    return S.quality_checkpoints(e, "user_id", ["event_id"], "score")


QUALITY_MARKS = "SELECT user_id, mark, min(event_id) AS event_id FROM events, (SELECT unnest([80, 70, 50, 40]) AS mark) WHERE 100 - value < mark GROUP BY 1, 2"


def recent_parts(spark: SparkSession, d: str) -> DataFrame:
    return S.recent_values(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], "l_partkey", 20)


RECENT_PARTS = """WITH f AS (SELECT l_suppkey, l_partkey, min((l_orderkey, l_linenumber)) AS a FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY a DESC, l_partkey) AS INTEGER) AS place FROM f QUALIFY place <= 20"""


def checkpoints_best(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 50).alias("messages"), (F.col("o_orderkey") % 7 * 10).alias("quality"))
    return S.best_checkpoint(c)


CHECKPOINTS_BEST = """WITH c AS (SELECT o_custkey AS session_id, o_orderkey AS seq, o_orderkey % 50 AS messages, o_orderkey % 7 * 10 AS quality FROM orders)
SELECT session_id, seq, messages, quality FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY messages * CAST(0.6 AS DOUBLE) + quality * CAST(0.4 AS DOUBLE) DESC, seq) = 1"""


def calls_recovered(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the errors of one call to a model."""
    m = F.element_at(F.array(*map(F.lit, ("request timed out", "rate limit hit", "prompt is too long", "request timed out", "rate limit hit", "request timed out", "invalid request"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("seq"), m.alias("message"), error_kind(m).alias("kind"))
    return S.recovery_log(e)


CALLS_RECOVERED = """
WITH e AS (SELECT o_custkey AS call_id, o_orderkey AS seq, ['timeout', 'overloaded', 'context_window', 'timeout', 'overloaded', 'timeout', 'provider'][o_orderkey % 7 + 1] AS kind FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id, kind ORDER BY seq) AS k, CASE kind WHEN 'timeout' THEN 3 WHEN 'overloaded' THEN 3 WHEN 'context_window' THEN 2 ELSE 0 END AS most FROM e),
o AS (SELECT *, min(CASE WHEN k > most THEN seq END) OVER (PARTITION BY call_id) AS stop FROM k)
SELECT call_id, seq, CASE kind WHEN 'timeout' THEN 'timeout_backoff' WHEN 'overloaded' THEN 'overload_backoff' WHEN 'provider' THEN 'provider_fallback' ELSE CASE WHEN k > most THEN 'context_window_fallback' ELSE 'compaction_retry' END END AS action,
 CASE WHEN kind = 'provider' THEN 'invalid request' WHEN k > most THEN 'exhausted ' || CASE kind WHEN 'timeout' THEN 'timeout' WHEN 'overloaded' THEN 'overload' ELSE 'context' END || ' retries'
  ELSE 'attempt ' || k || '/' || most || CASE kind WHEN 'timeout' THEN ', backoff ' || [1000, 2000, 4000][k] || 'ms' WHEN 'overloaded' THEN ', backoff ' || [2000, 4000, 8000][k] || 'ms' ELSE '' END END AS detail, k <= most AS success FROM o WHERE stop IS NULL OR seq <= stop
"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    role = F.element_at(F.array(*map(F.lit, ("system", "user", "user", "assistant", "assistant", "assistant"))), (F.col("l_orderkey") % 6 + 1).cast("int"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "file").when(F.col("l_linenumber") % 3 == 1, "todo")
    pos = F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    return i.select(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("seq"), role.alias("role"), pos.alias("pos"), kind.alias("kind"), F.concat(F.when(F.col("l_partkey") % 2 == 0, "/work/").otherwise("/etc/"), F.col("l_partkey") % 4).alias("resource"), F.col("l_partkey").cast("string").alias("text"))


def messages_summed(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_messages(spark, d), "/work/").select("session_id", "seq", "role", "pos", "resource")


_MESSAGES = """
m AS (SELECT l_suppkey AS s, l_orderkey AS seq, ['system', 'user', 'user', 'assistant', 'assistant', 'assistant'][l_orderkey % 6 + 1] AS role, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos,
 CASE l_linenumber % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'todo' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN '/work/' ELSE '/etc/' END || (l_partkey % 4) AS resource, CAST(l_partkey AS VARCHAR) AS text FROM lineitem)"""
MESSAGES_SUMMED = f"""
WITH {_MESSAGES}, a AS (SELECT * FROM m WHERE role <> 'system'),
h AS (SELECT s, seq, role, lag(role) OVER (PARTITION BY s ORDER BY seq) AS p FROM (SELECT DISTINCT s, seq, role FROM a)),
b AS (SELECT a.*, row_number() OVER (PARTITION BY a.s, a.seq ORDER BY pos) AS k FROM a JOIN h ON h.s = a.s AND h.seq = a.seq WHERE NOT (h.role = 'user' AND h.p IS NOT DISTINCT FROM 'user')),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, seq, kind, resource ORDER BY pos DESC) AS n FROM b WHERE role <> 'user' OR k = 1) WHERE NOT (role = 'assistant' AND kind IS NOT NULL AND kind <> 'todo' AND n > 1)),
h2 AS (SELECT s, seq, role, lag(role) OVER (PARTITION BY s ORDER BY seq) AS p FROM (SELECT DISTINCT s, seq, role FROM c)),
e AS (SELECT c.* EXCLUDE (k), row_number() OVER (PARTITION BY c.s, c.seq ORDER BY pos) AS k FROM c JOIN h2 ON h2.s = c.s AND h2.seq = c.seq WHERE NOT (h2.role = 'assistant' AND h2.p IS NOT DISTINCT FROM 'assistant'))
SELECT s AS session_id, seq, role, CAST(pos AS INTEGER) AS pos, CASE WHEN kind = 'file' AND starts_with(resource, '/work/') THEN substr(resource, 7) ELSE resource END AS resource FROM e WHERE role <> 'assistant' OR k = 1
"""


def messages_written(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    part = F.struct("pos", F.when(F.col("kind") == "file", "tool").when(F.col("kind") == "todo", "text").otherwise("step").alias("kind"), F.when(F.col("pos") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    g = m.groupBy("session_id", "seq", "role").agg(F.array_sort(F.collect_list(part)).alias("l"))
    return g.select("session_id", "seq", X.message_text(F.col("role"), F.transform("l", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))).alias("text"))


MESSAGES_WRITTEN = f"""WITH {_MESSAGES}, p AS (SELECT *, CASE WHEN pos % 4 = 0 THEN ' ' ELSE text END AS t FROM m)
SELECT s AS session_id, seq, any_value(role) || ': ' || coalesce(string_agg(CASE kind WHEN 'todo' THEN t WHEN 'file' THEN '[' || t || ']' END, chr(10) ORDER BY pos) FILTER (WHERE kind = 'file' OR kind = 'todo' AND t <> ' '), '') AS text FROM p GROUP BY 1, 2"""


def symbols_sliced(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_texts").select("file_id", F.size(F.split("content", r"\r?\n")).alias("n"), C.tokens(F.col("content")).alias("t")).distinct()
    s = table(spark, d, "symbols").select("id", "file_id", "line", "end_line").distinct().join(t, "file_id")
    k = C.symbol_tokens(F.col("t"), F.col("line"), F.col("end_line"), F.col("n"))
    return s.select("id", F.size(k).alias("tokens"), F.sha2(F.array_join(k, " ").cast("binary"), 256).alias("hash"))


_SLICES = rf"""{A._TOKENS}, ln AS (SELECT DISTINCT file_id, len(regexp_split_to_array(content, '\r?\n')) AS n FROM source_texts), tk AS (SELECT DISTINCT id, tokens FROM tok),
sl AS (SELECT s.id, s.file_id, tokens[CAST(floor((line - 1) * len(tokens) / n) AS BIGINT) + 1 : CAST(floor(end_line * len(tokens) / n) AS BIGINT)] AS t FROM (SELECT DISTINCT id, file_id, line, end_line FROM symbols) s JOIN tk ON tk.id = s.file_id JOIN ln ON ln.file_id = s.file_id)"""
SYMBOLS_SLICED = f"WITH {_SLICES} SELECT id, CAST(len(t) AS INTEGER) AS tokens, sha256(array_to_string(t, ' ')) AS hash FROM sl"

_SIGNED = f"""{_SLICES}, ru AS (SELECT id, file_id, list_distinct(list_transform(range(1, len(t) - 1), lambda k: array_to_string(t[k:k + 2], chr(0)))) AS r FROM sl WHERE len(t) >= 5),
di AS (SELECT DISTINCT unnest(r) AS r FROM ru), ha AS MATERIALIZED (SELECT r, list_transform(range(0, 128), lambda h: CAST('0x' || left(sha256(h || chr(1) || r), 8) AS BIGINT)) AS h FROM di),
ex AS (SELECT id, file_id, unnest(r) AS r FROM ru), mi AS MATERIALIZED (SELECT id, file_id, [{', '.join(f'min(h[{k}])' for k in range(1, 129))}] AS m FROM ex JOIN ha USING (r) GROUP BY 1, 2)"""


def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Min-hash signatures of the symbols' tokens, written as one text each."""
    t = table(spark, d, "source_texts").select("file_id", F.size(F.split("content", r"\r?\n")).alias("n"), C.tokens(F.col("content")).alias("t")).distinct()
    s = table(spark, d, "symbols").select("id", "file_id", "line", "end_line").distinct().join(t, "file_id")
    rows = s.select("id", C.symbol_tokens(F.col("t"), F.col("line"), F.col("end_line"), F.col("n")).alias("tokens"))
    return C.signatures(rows).where("minhash is not null").select("id", F.sha2(F.array_join(F.transform("minhash", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("hash"))


CODE_SIGNATURES = f"WITH {_SIGNED} SELECT id, sha256(array_to_string(m, ',')) AS hash FROM mi"
CODE_NEAR_COPIES = f"""WITH {_SIGNED}, cl AS (SELECT id, file_id, m, min(id) OVER (PARTITION BY m) AS class, min(file_id) OVER (PARTITION BY m) AS low, max(file_id) OVER (PARTITION BY m) AS high FROM mi), oc AS (SELECT * FROM cl WHERE id = class),
bd AS (SELECT id, low, high, b, array_to_string(m[b * 8 + 1 : b * 8 + 8], ',') AS k FROM oc, (SELECT unnest(range(0, 16)) AS b)),
pa AS (SELECT DISTINCT x.id AS a, y.id AS z FROM bd x JOIN bd y ON x.b = y.b AND x.k = y.k AND x.id < y.id AND least(x.low, y.low) <> greatest(x.high, y.high)),
si AS (SELECT a, z FROM pa JOIN oc p ON p.id = a JOIN oc q ON q.id = z WHERE len(list_filter(list_zip(p.m, q.m), lambda e: e[1] = e[2])) >= 0.8 * 128), n AS (SELECT c, count(*) AS links FROM (SELECT a AS c FROM si UNION ALL SELECT z FROM si) GROUP BY 1)
SELECT id, class, coalesce(links, 0) AS links FROM cl LEFT JOIN n ON c = class"""


def chunks_at_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "source_texts").select("file_id", F.size(F.split("content", r"\r?\n")).alias("n")).distinct()
    return R.symbol_chunks(table(spark, d, "symbols"), n)


CHUNKS_AT_SYMBOLS = r"""
WITH n AS (SELECT DISTINCT file_id, len(regexp_split_to_array(content, '\r?\n')) AS n FROM source_texts), s AS (SELECT DISTINCT file_id, name, line, end_line FROM symbols),
b AS (SELECT *, coalesce(max(end_line) OVER (PARTITION BY file_id ORDER BY line, end_line, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), l AS (SELECT file_id, max(end_line) AS last FROM s GROUP BY 1)
SELECT file_id, line AS start_line, end_line, name AS symbol_name FROM b UNION ALL SELECT file_id, before + 1, line - 1, NULL FROM b WHERE line > before + 1
UNION ALL SELECT n.file_id, coalesce(last, 0) + 1, n, NULL FROM n LEFT JOIN l ON l.file_id = n.file_id WHERE n > coalesce(last, 0)
"""
CHUNKS_SPLIT = """
WITH RECURSIVE c AS (SELECT id, coalesce(CASE WHEN start_line = 0 THEN 1 ELSE start_line END, 1) AS top, content, string_split(content, chr(10)) AS l FROM (SELECT DISTINCT id, start_line, content FROM chunks WHERE content IS NOT NULL)),
s AS (SELECT id, top, l, list_reduce([CAST(0 AS BIGINT)] || list_transform(l, lambda x: length(x) + 1), lambda a, x: a + x) AS total FROM c WHERE length(content) > 1500),
p AS (SELECT id, top, l, list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: length(x) + 1))) AS sums FROM s),
w AS (SELECT id, top, l, sums, 0 AS part, CAST(0 AS BIGINT) AS a, greatest(1, len(list_filter(sums, lambda x: x <= 1500))) AS b FROM p
 UNION ALL SELECT id, top, l, sums, part + 1, b, greatest(b + 1, len(list_filter(sums, lambda x: x <= 1500 + sums[b]))) FROM w WHERE b < len(l))
SELECT id, part, CAST(top + a AS INTEGER) AS start_line, CAST(top + b - 1 AS INTEGER) AS end_line, array_to_string(l[a + 1:b], chr(10)) AS content FROM w
UNION ALL SELECT id, 0, CAST(top AS INTEGER), CAST(top + len(l) - 1 AS INTEGER), content FROM c WHERE length(content) <= 1500
"""
CHUNKS_ROLLED = """
WITH RECURSIVE c AS (SELECT DISTINCT file_path, start_line, end_line, content, symbol_name, symbol_kind FROM chunks WHERE file_path IS NOT NULL AND content IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, content) AS k FROM c),
w AS (SELECT file_path, start_line, end_line, content, symbol_name, symbol_kind, k, 1 AS g FROM n WHERE k = 1
 UNION ALL SELECT n.file_path, CASE WHEN j THEN w.start_line ELSE n.start_line END, n.end_line, CASE WHEN j THEN w.content || chr(10) || n.content ELSE n.content END, CASE WHEN NOT j THEN n.symbol_name WHEN same THEN w.symbol_name END, CASE WHEN NOT j THEN n.symbol_kind WHEN same THEN w.symbol_kind END, n.k, g + CASE WHEN j THEN 0 ELSE 1 END
  FROM w JOIN n ON n.file_path = w.file_path AND n.k = w.k + 1, LATERAL (SELECT coalesce(w.end_line + 1 = n.start_line AND (ceil(length(w.content) / 4) < 50 OR ceil(length(n.content) / 4) < 50) AND ceil(length(w.content) / 4) + ceil(length(n.content) / 4) + 1 <= 400, false) AS j,
   w.symbol_name IS NOT NULL AND w.symbol_name IS NOT DISTINCT FROM n.symbol_name AND w.symbol_kind IS NOT DISTINCT FROM n.symbol_kind AS same))
SELECT file_path, start_line, end_line, content, symbol_name, symbol_kind FROM w QUALIFY row_number() OVER (PARTITION BY file_path, g ORDER BY k DESC) = 1
"""
REPEATED_CALLS = """
WITH r AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k <= 64), g AS (SELECT user_id, list(t ORDER BY k) AS l FROM r GROUP BY 1),
p AS (SELECT user_id, l, unnest(range(1, len(l) // 2 + 1)) AS p FROM g), s AS (SELECT user_id, p, coalesce(list_position(list_transform(range(1, len(l) - p + 1), lambda i: l[i] = l[i + p]), false) - 1, len(l) - p) AS same, len(l) AS n, p AS q FROM p),
c AS (SELECT user_id, p, same // p + 1 AS times FROM s) SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(arg_min(times, p) AS INTEGER) AS repeats FROM c WHERE times >= 3 GROUP BY 1
"""


def chunks_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found by words, by the vector of the first chunk, and by both."""
    c = table(spark, d, "chunks").where("content is not null and size(embedding) = 64").select("id", F.col("content").alias("text"), F.col("embedding").alias("vec")).distinct()
    v = [float(x) for x in c.orderBy("id").first().vec]
    out = None
    for mode in ("semantic", "keyword", "hybrid"):
        one = R.search(c, "return record queue", v, mode).select(F.lit(mode).alias("mode"), "id", F.round("score", 7).alias("score"), F.col("rank").cast("int").alias("rank"))
        out = one if out is None else out.union(one)
    return out


CHUNKS_FOUND = """
WITH c AS (SELECT DISTINCT id, content, embedding::DOUBLE[] AS e FROM chunks WHERE content IS NOT NULL AND len(embedding) = 64),
v AS (SELECT e AS v FROM c ORDER BY id LIMIT 1), d AS (SELECT id, list_dot_product(e, v) AS dot, sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)) AS n FROM c, v),
s AS (SELECT id, CASE WHEN n > 0 THEN dot / n ELSE 0 END AS score, row_number() OVER (ORDER BY CASE WHEN n > 0 THEN dot / n ELSE 0 END DESC, id) AS rank FROM d),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM c), q AS (SELECT unnest(['return', 'record', 'queue']) AS q),
t AS (SELECT id, q, len(list_filter(w, lambda x: x = q)) AS tf, len(w) AS n FROM w, q), g AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), df AS (SELECT q, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1),
b AS (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM t JOIN df ON df.q = t.q, g WHERE tf > 0 GROUP BY 1),
k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b), u AS (SELECT id, rank FROM s WHERE rank <= 30 UNION ALL SELECT id, rank FROM k WHERE rank <= 30),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1), h AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f)
SELECT 'semantic' AS mode, id, round(score, 7) AS score, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 10 UNION ALL SELECT 'keyword', id, round(score, 7), CAST(rank AS INTEGER) FROM k WHERE rank <= 10 UNION ALL SELECT 'hybrid', id, round(CAST(score AS DOUBLE), 7), CAST(rank AS INTEGER) FROM h WHERE rank <= 10
"""


def chunks_replaced(spark: SparkSession, d: str) -> DataFrame:
    """An index of chunks after those of some lines came anew and the files of others went."""
    c = table(spark, d, "chunks").select("id", "file_path", F.length("content").alias("n"), "start_line").distinct()
    new = c.where("start_line % 7 = 1").withColumn("n", F.lit(-1))
    return R.replace_chunks(c, new, c.where("start_line % 5 = 2").select("file_path").distinct()).select("id", "file_path", "n")


CHUNKS_REPLACED = """WITH c AS (SELECT DISTINCT id, file_path, length(content) AS n, start_line AS a FROM chunks), g AS (SELECT DISTINCT file_path FROM c WHERE a % 5 = 2)
SELECT id, file_path, n FROM c WHERE id NOT IN (SELECT id FROM c WHERE a % 7 = 1) AND (file_path IS NULL OR file_path NOT IN (SELECT file_path FROM g WHERE file_path IS NOT NULL)) UNION ALL SELECT id, file_path, -1 FROM c WHERE a % 7 = 1"""

_ALL = (kv_wild, findings_kept, loops_over, budgets_shown, tasks_shown, files_undone, symbols_on_top, ranks_changed, counts_changed, folder_changes, scans_needed, seeds_usable, snapshot_read, reads_answered, todos_changed, users_nudged, quality_marks, recent_parts, checkpoints_best, calls_recovered, messages_summed, messages_written, symbols_sliced, code_signatures, chunks_at_symbols, chunks_found, chunks_replaced)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
#: SQL of queries that stand in the module of the data queries.
SQL |= {"folders_skipped": FOLDERS_SKIPPED, "code_near_copies": CODE_NEAR_COPIES, "chunks_split": CHUNKS_SPLIT, "chunks_rolled": CHUNKS_ROLLED, "repeated_calls": REPEATED_CALLS}
