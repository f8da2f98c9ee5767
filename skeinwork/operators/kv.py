"""A time-to-live key-value view over a log of writes, and documents kept in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import sha256_hex

#: Characters a plan may have; characters and lines of an archived output's preview.
PLAN_CHARS, ARCHIVE_CHARS, PREVIEW_LINES = 8000, 4096, 5


def latest(log: DataFrame, order: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The current row per project_id and key of a log of upserts (project_id, key, data, expires_at,
    updated_at): data and expiry of the last write, created_at of the first. A null data deletes.
    Aggregated per key with map-side combining; writes of equal time fall to the greater ``tie`` or data."""
    by = F.struct(order, tie or "data", "expires_at")
    rows = log.groupBy("project_id", "key").agg(F.max_by(F.struct("data", "expires_at", F.col(order).alias("updated_at")), by).alias("r"), F.min(order).alias("created_at"))
    return rows.select("project_id", "key", "r.data", "r.expires_at", "created_at", "r.updated_at").where("data is not null")


def visible(rows: DataFrame, now: Column | int) -> DataFrame:
    """Rows that have not expired; one that expires now has."""
    return rows.where(F.col("expires_at") > now)


def get(rows: DataFrame, project: str, key: str, now: Column | int) -> DataFrame:
    return visible(rows, now).where((F.col("project_id") == project) & (F.col("key") == key))


def list_keys(rows: DataFrame, project: str, now: Column | int, prefix: str = "", wild: bool = False) -> DataFrame:
    """Visible rows of a project whose key starts with ``prefix``, the last written first: literally or, if ``wild``, with ``_`` for any
    character, ``%`` for any number of them, and letters in any case."""
    starts = F.col("key").ilike(prefix + "%") if wild else F.col("key").startswith(prefix)
    return visible(rows, now).where((F.col("project_id") == project) & starts).orderBy(F.desc("updated_at"), "key")


def purge(rows: DataFrame, now: Column | int) -> DataFrame:
    """Rows left by a purge, which spares those that expire at the very moment."""
    return rows.where(F.col("expires_at") >= now)


def plan_lines(plans: DataFrame, pattern: str | None = None, offset: int = 1, limit: int | None = None) -> DataFrame:
    """Numbered lines of plan texts (key, data): those that match, or a range from ``offset``."""
    lines = plans.select("key", F.posexplode(F.split("data", "\n")).alias("at", "text")).select("key", (F.col("at") + 1).alias("line"), "text")
    if pattern is not None:
        return lines.where(F.col("text").rlike(pattern))
    return lines.where((F.col("line") >= offset) & (F.lit(True) if limit is None else F.col("line") < offset + limit))


def plan_append(text: Column, heading: Column, addition: Column) -> Column:
    """A plan with a section added, cut at the greatest length."""
    return F.substring(F.concat(text, F.lit("\n\n## "), heading, F.lit("\n"), addition), 1, PLAN_CHARS)


def plan_edit(text: Column, old: str, new: str, nth: int | None = None) -> Column:
    """``old`` replaced by ``new``: everywhere with nth 0, the nth time it occurs, or, if nth is None, only
    if it occurs once; null where it cannot be."""
    parts = F.split(text, "\\Q" + old + "\\E")
    n = F.size(parts) - 1
    if nth == 0:
        return F.when(n > 0, F.replace(text, F.lit(old), F.lit(new)))
    k = nth or 1
    one = F.concat(F.array_join(F.slice(parts, 1, k), old), F.lit(new), F.array_join(F.slice(parts, F.lit(k + 1), F.size(parts)), old))
    return F.when((n == 1) if nth is None else (n >= k), one)


def findings(rows: DataFrame, file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Review findings (keys ``review-finding:file:line``), of one file or matching a pattern in their data."""
    out = rows.where(F.col("key").startswith("review-finding:" + (f"{file}:" if file else "")))
    if pattern is not None:
        out = out.where(F.col("data").rlike(pattern))
    return out.withColumn("file", F.regexp_extract("key", r"^review-finding:(.*):\d+$", 1)).withColumn("line", F.regexp_extract("key", r":(\d+)$", 1).try_cast("int"))


def branch_findings(rows: DataFrame, branch: str) -> DataFrame:
    """Findings whose data names a branch."""
    return findings(rows).where(F.get_json_object("data", "$.branch") == branch)


def ended(states: DataFrame, at: str) -> DataFrame:
    """Loop states (name, active, ...) of a store whose host has gone: those active end at a time, for a shutdown."""
    return states.withColumn("completed", F.when(F.col("active"), F.lit(at))).withColumn("reason", F.when(F.col("active"), "shutdown")).withColumn("active", F.lit(False))


def archived(text: Column) -> Column:
    """Struct of an output's preview, whether it is long enough to be archived, its size and its id."""
    lines = F.split(text, "\n")
    return F.struct(F.array_join(F.slice(lines, 1, PREVIEW_LINES), "\n").alias("preview"), (F.length(text) > ARCHIVE_CHARS).alias("archived"), F.length(text).alias("chars"), F.substring(sha256_hex(text), 1, 16).alias("id"))


def loop_reason(iterations: Column, tokens: Column, cost: Column, most_iterations: int, most_tokens: int, most_cost: float) -> Column:
    """The first limit that a loop exceeds: iterations, tokens, cost; null within all."""
    return F.when(iterations >= most_iterations, "iterations").when(tokens >= most_tokens, "tokens").when(cost >= most_cost, "cost")


def admitted(tasks: DataFrame, total: int, per_model: int) -> DataFrame:
    """Pending tasks (id, model, status, created_at) that may start, first come first served: as many as the
    places left overall and per model by those that run."""
    running = tasks.where("status = 'running'")
    used = running.groupBy("model").agg(F.count(F.lit(1)).alias("used"))
    free = max(0, total - running.count())
    queue = tasks.where("status = 'pending'").join(used, "model", "left")
    own = Window.partitionBy("model").orderBy("created_at", "id")
    fit = queue.withColumn("k", F.row_number().over(own)).where(F.col("k") + F.coalesce("used", F.lit(0)) <= per_model)
    return fit.orderBy("created_at", "id").limit(free).drop("k", "used")


def undo(snapshots: DataFrame, step: int = 1) -> DataFrame:
    """The ``step``-th newest snapshot (file, taken_at, data) of each file."""
    w = Window.partitionBy("file").orderBy(F.desc("taken_at"))
    return snapshots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == step).drop("_n")
