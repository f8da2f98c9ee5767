"""Per-session logic in batch form: repetition, budgets, quality, checkpoints, summaries, debouncing.

Where a rule is a running sum or a comparison with the row beside, it is worked out in ranges of rows that hand over
at their ends, as one session may hold a large share of all rows; where it is a fold over a bounded ring, only the
ring is gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.runtime import beside, running_sums

# Ring and repetitions of the loop rule, warning share of budgets, sizes and marks of quality and checkpoints.
RING, REPEATS, WARN_AT = 64, 3, 0.8
QUALITY_TOKENS, CHECKPOINT_TOKENS = 500_000, 200_000
WEIGHTS = {"fill": 20, "stale": 20, "bloat": 20, "compaction": 15, "duplicates": 10, "decisions": 8, "loops": 7}
FILL_MARKS, QUALITY_MARKS = [20, 35, 50, 65, 80], [80, 70, 50, 40]


def repetitions(ring: Column, least: int = REPEATS) -> Column:
    """Of an array of signatures in order, how often the shortest pattern at its end is repeated, if at
    least ``least`` times; else null."""
    n = F.size(ring)
    lengths = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def times(p: Column) -> Column:
        # positions whose element equals the one p later, counted from the end without a break
        same = F.transform(F.sequence(F.lit(1), n - p), lambda i: F.element_at(ring, i) == F.element_at(ring, i + p))
        broken = F.array_position(F.reverse(same), False).cast("int")
        run = F.when(broken > 0, broken - 1).otherwise(n - p)
        return F.floor(run / p).cast("int") + 1

    counts = F.transform(lengths, lambda p: F.when(n >= p * 2, times(p)).otherwise(F.lit(0)))
    first = F.filter(counts, lambda c: c >= least)
    return F.when((n >= least) & (F.size(first) > 0), F.get(first, F.lit(0)))


def loops(calls: DataFrame, key: str, order: list[str], signature: str, ring: int = RING, least: int = REPEATS) -> DataFrame:
    """``key, repeats`` of the sessions whose last ``ring`` signatures end in a repeated pattern. The ring is cut out
    by rank before it is gathered."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    last = calls.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= ring)
    rings = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), F.col(signature).alias("s")))), lambda x: x["s"]).alias("ring"))
    return rings.select(key, repetitions(F.col("ring"), least).alias("repeats")).where("repeats is not null")


def pending_changes(lists: DataFrame) -> DataFrame:
    """Todo lists (session_id, seq, todos array<struct<status, content>>) whose pending entries differ, as a set with
    counts, from those of the last list that had any: session_id, seq, pending."""
    open_ = F.filter("todos", lambda t: t["status"].isin("pending", "in_progress"))
    key = F.array_join(F.sort_array(F.transform(open_, lambda t: F.concat(t["status"], F.lit(":"), t["content"]))), "\n")
    rows = lists.withColumn("pending", open_).where(F.size("pending") > 0).withColumn("_k", key)
    w = Window.partitionBy("session_id").orderBy("seq")
    return rows.withColumn("_b", F.lag("_k").over(w)).where(~F.col("_k").eqNullSafe(F.col("_b"))).select("session_id", "seq", "pending")


def budgets(events: DataFrame, key: str, order: list[str], turn: str, limits: dict[str, float], counters: dict[str, tuple[Column, bool]]) -> DataFrame:
    """``events`` with the running value of each counter and its state: ok, warn (from four fifths of its limit) or
    over. A counter is (amount per event, whether it starts anew with each ``turn``); a missing or zero limit is none."""
    out = events
    for each in (False, True):
        some = {n: a for n, (a, e) in counters.items() if e == each}
        if some:
            out = running_sums(out, [key, turn] if each else [key], order, some)
    states = []
    for name in counters:
        limit, used = limits.get(name) or 0, F.col(name)
        state = F.lit("ok") if limit <= 0 else F.when(used >= limit, "over").when(used >= limit * WARN_AT, "warn").otherwise("ok")
        states += [used, state.alias(f"{name}_state")]
    return out.select(*events.columns, *states)


def quality(chars: Column, reads: Column, stale: Column, large: Column, referenced: Column, compactions: Column, duplicates: Column, messages: Column, decisions: Column, loops_: Column) -> Column:
    """Struct of a session's score and grade from seven weighted signals. A session without
    anything scores 91: one compaction is always reckoned with."""
    ratio = lambda a, b, none: F.when(b > 0, a / b).otherwise(F.lit(float(none)))
    signals = {
        "fill": 1 - F.least(F.lit(1.0), F.ceil(chars / 4) / QUALITY_TOKENS),
        "stale": 1 - F.least(F.lit(1.0), ratio(stale, reads, 0)),
        "bloat": 1 - F.least(F.lit(1.0), ratio(F.greatest(large - referenced, F.lit(0)), large, 0)),
        "compaction": 1 - F.least(F.lit(1.0), 1 - F.pow(F.lit(0.4), F.greatest(compactions, F.lit(1)))),
        "duplicates": 1 - F.least(F.lit(1.0), duplicates / 10),
        "decisions": F.least(F.lit(1.0), ratio(decisions, messages, 1) * 5),
        "loops": 1 - F.least(F.lit(1.0), loops_ / 3),
    }
    score = F.floor(sum((signals[n] * w for n, w in WEIGHTS.items()), F.lit(0.0)) + 0.5).cast("int")
    grade = F.when(score >= 90, "S").when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").when(score >= 50, "D").otherwise("F")
    return F.struct(score.alias("score"), grade.alias("grade"))


def nudges(checks: DataFrame, threshold: int = 60, cooldown: int = 300_000, most: int = 10) -> DataFrame:
    """Quality checks (session_id, at, score, compacted: whether since the check before) with ``nudge``: below the threshold,
    not right after a compaction, not within the cooldown of the last nudge, at most ``most`` a session. A nudge depends on those before
    it, so only checks that can bring one are folded, a session's in one task."""
    kind = dict(checks.dtypes)["session_id"]
    able = checks.where((F.col("score") < threshold) & ~F.coalesce("compacted", F.lit(False)) & F.col("at").isNotNull()).select("session_id", "at").distinct()

    def fold(key: tuple, group: pa.Table) -> pa.Table:
        out, last = [], None
        for at in sorted(group.column("at").to_pylist()):
            if len(out) < most and (last is None or at - last >= cooldown):
                out.append(at)
                last = at
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(out), key[0].type), "at": pa.array(out, pa.int64())})

    hit = able.select("session_id", F.col("at").cast("long").alias("at")).groupBy("session_id").applyInArrow(fold, f"session_id {kind}, at long").withColumn("_n", F.lit(True))
    can = (F.col("score") < threshold) & ~F.coalesce("compacted", F.lit(False))
    return checks.join(hit, ["session_id", "at"], "left").withColumn("nudge", F.coalesce(F.col("_n") & can, F.lit(False))).drop("_n")


def quality_checkpoints(scores: DataFrame, key: str, order: list[str], score: str, marks: list[int] = QUALITY_MARKS) -> DataFrame:
    """``key, mark`` and the order columns of the first row at which a session's score lies below each mark."""
    rows = scores.withColumn("mark", F.explode(F.array(*map(F.lit, marks)))).where(F.col(score) < F.col("mark"))
    return rows.groupBy(key, "mark").agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in order))


def recent_values(rows: DataFrame, key: str, order: list[str], value: str, n: int = 50) -> DataFrame:
    """The last ``n`` distinct values of each key by the time they were first seen: key, value, place."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(key).orderBy(F.desc("_at"), value)
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("_at")


# Retries of each kind of error, and the least and greatest pause in milliseconds.
CONTEXT_RETRIES, TIMEOUT_RETRIES, OVERLOAD_RETRIES, FIRST_PAUSE, LONGEST_PAUSE = 2, 3, 3, 1000, 30_000


def recovery_log(errors: DataFrame, context: int = CONTEXT_RETRIES, timeout: int = TIMEOUT_RETRIES, overload: int = OVERLOAD_RETRIES, first: int = FIRST_PAUSE, longest: int = LONGEST_PAUSE) -> DataFrame:
    """What is done about the errors (call_id, seq, kind, message) of model calls: call_id, seq, action, detail, success. An error is met
    by another try while its kind has tries left: after compaction where the context is full, after a pause that doubles
    with every timeout, or a pause by the number of overloads. Other errors end the call; what comes after the end counts no more."""
    w = Window.partitionBy("call_id", "kind").orderBy("seq")
    rows = errors.withColumn("k", F.row_number().over(w))
    most = F.when(F.col("kind") == "context_window", context).when(F.col("kind") == "timeout", timeout).when(F.col("kind") == "overloaded", overload).otherwise(0)
    rows = rows.withColumn("most", most).withColumn("over", F.col("k") > F.col("most"))
    ends = rows.where("over").groupBy("call_id").agg(F.min("seq").alias("end"))
    rows = rows.join(ends, "call_id", "left").where("end is null or seq <= end")
    action = F.expr("CASE kind WHEN 'context_window' THEN CASE WHEN over THEN 'context_window_fallback' ELSE 'compaction_retry' END WHEN 'timeout' THEN 'timeout_backoff' WHEN 'overloaded' THEN 'overload_backoff' ELSE 'provider_fallback' END")
    pause = F.least(F.when(F.col("kind") == "timeout", F.lit(first) * F.pow(F.lit(2), F.col("k") - 1)).otherwise(F.lit(first) * F.pow(F.lit(2), F.col("k"))), F.lit(longest)).cast("long")
    tried = F.concat(F.lit("attempt "), F.col("k").cast("string"), F.lit("/"), F.col("most").cast("string"))
    spent = F.concat(F.lit("exhausted "), F.expr("CASE kind WHEN 'context_window' THEN 'context' WHEN 'timeout' THEN 'timeout' ELSE 'overload' END"), F.lit(" retries"))
    detail = F.when(action == "provider_fallback", F.col("message")).when(F.col("over"), spent).when(F.col("kind") == "context_window", tried).otherwise(F.concat(tried, F.lit(", backoff "), pause.cast("string"), F.lit("ms")))
    return rows.select("call_id", "seq", action.alias("action"), detail.alias("detail"), (~F.col("over")).alias("success"))


def fill_checkpoints(messages: DataFrame, key: str, order: list[str], chars: Column, marks: list[int] = FILL_MARKS, tokens: int = CHECKPOINT_TOKENS) -> DataFrame:
    """``key, mark`` and the order columns of the message at which a session's text first fills each share of the window."""
    fill = F.floor(F.ceil(F.col("_sum") / 4) / tokens * 100 + 0.5)
    rows = running_sums(messages, [key], order, {"_sum": chars}).withColumn("_fill", fill).withColumn("mark", F.explode(F.array(*map(F.lit, marks)))).where(F.col("_fill") >= F.col("mark"))
    return rows.groupBy(key, "mark").agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in order))


def best_checkpoint(checkpoints: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session the checkpoint (messages, quality, seq) of most messages and quality; the first of equals."""
    score = F.col("messages") * 0.6 + F.col("quality") * 0.4
    return checkpoints.groupBy(key).agg(F.max_by(F.struct("seq", "messages", "quality"), F.struct(score, -F.col("seq"))).alias("b")).select(key, "b.*")


def last_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The first row of every run of equal values (null is a value): deduplicated runs."""
    got = beside(rows, [key], order, F.col(value), "_before")
    return got.where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_before")


def summary(messages: DataFrame, cwd: str) -> DataFrame:
    """Messages (session_id, seq, role, pos, kind, resource, text: one row per content) reduced for a summary.

    In this order: system messages go; of a run of user messages the first stays, with its first content; in an
    assistant message only the last operation on a resource stays (todos all stay); of a run of
    assistant messages the first stays, with its first content left; the working folder is cut off files' paths.
    """
    rows = messages.where("role <> 'system'")

    def first_of_runs(rows: DataFrame, role: str) -> DataFrame:
        heads = rows.select("session_id", "seq", "role").distinct()
        w = Window.partitionBy("session_id").orderBy("seq")
        gone = heads.withColumn("_p", F.lag("role").over(w)).where((F.col("role") == role) & (F.col("_p") == role)).select("session_id", "seq")
        rows = rows.join(gone, ["session_id", "seq"], "left_anti")
        k = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("pos"))
        return rows.withColumn("_k", k).where((F.col("role") != role) | (F.col("_k") == 1)).drop("_k")

    rows = first_of_runs(rows, "user")
    op = Window.partitionBy("session_id", "seq", "kind", "resource").orderBy(F.desc("pos"))
    later = (F.col("role") == "assistant") & F.col("kind").isNotNull() & (F.col("kind") != "todo") & (F.row_number().over(op) > 1)
    rows = rows.withColumn("_l", later).where("not _l").drop("_l")
    rows = first_of_runs(rows, "assistant")
    base = cwd.rstrip("/")
    inside = (F.col("kind") == "file") & F.col("resource").startswith(base)
    cut = F.regexp_replace(F.substring("resource", len(base) + 1, 1 << 30), r"^[\\/]", "")
    return rows.withColumn("resource", F.when(inside, F.when(cut == "", ".").otherwise(cut)).otherwise(F.col("resource")))


def debounced(events: DataFrame, key: str, at: str, quiet: int) -> DataFrame:
    """The last event of every burst of a key: events less than ``quiet`` apart belong to one burst."""
    got = beside(events, [key], [at], F.col(at), "_next", ahead=True)
    return got.where(F.col("_next").isNull() | (F.col("_next.v") - F.col(at) >= quiet)).drop("_next")


def session_totals(messages: DataFrame, key: str, role: str, amounts: list[str]) -> DataFrame:
    """Sums of the amounts over all messages of a session, and how many there are, all and of the assistant."""
    return messages.groupBy(key).agg(*(F.sum(c).alias(c) for c in amounts), F.count(F.lit(1)).alias("messages"), F.sum((F.col(role) == "assistant").cast("int")).alias("answers"))


def matches_per_file(lines: DataFrame, text: str) -> DataFrame:
    """``file, matches`` of search output lines: what stands before the first colon, if anything does."""
    file = F.when(F.instr(text, ":") > 1, F.substring_index(text, ":", 1))
    return lines.select(file.alias("file")).where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("matches"))


def grouped_matches(rows: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` matches (pos, path, line, text) by file, files in the order of their first match: path, first, n, text."""
    top = rows.orderBy("pos").limit(most)
    g = top.groupBy("path").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.concat("line", F.lit(": "), "text").alias("t")))).alias("l"))
    return g.select("path", "first", "n", F.array_join(F.col("l.t"), "\n").alias("text"))
