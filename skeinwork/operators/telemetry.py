"""Queries over the event log: filters, counts, retention, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Fixed value: days that events are kept.
KEEP_DAYS = 30


def query_events(events: DataFrame, limit: int = 100, since: int = 0, until: int = 0, **equal: str) -> DataFrame:
    """The last events that meet all given conditions; 0 and empty values are no condition."""
    out = events
    for c, v in equal.items():
        if v:
            out = out.where(F.col(c) == v)
    if since:
        out = out.where(F.col("timestamp") >= since)
    if until:
        out = out.where(F.col("timestamp") <= until)
    return out.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def event_stats(events: DataFrame) -> DataFrame:
    """Per type and over all (type null): events, first and last timestamp. One pass over partial counts."""
    per = events.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    whole = per.agg(F.lit(None).cast("string").alias("type"), F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))
    return per.where("type is not null").unionByName(whole)


def expired(events: DataFrame, now: int, days: int = KEEP_DAYS) -> DataFrame:
    return events.where(F.col("timestamp") < now - days * DAY_MS)


def kept(events: DataFrame, now: int, days: int = KEEP_DAYS) -> DataFrame:
    return events.where(F.col("timestamp") >= now - days * DAY_MS)


def outcome_report(events: DataFrame, success: str = "loop_outcome", counted: tuple[str, ...] = ("fallback", "undo")) -> DataFrame:
    """One row: outcomes by success and failure, their share, and the number of other counted types. A payload
    that is no JSON counts as neither."""
    status = F.get_json_object("data", "$.status")
    out = F.col("type") == success
    good = F.sum((out & status.isin("completed", "success")).cast("int"))
    bad = F.sum((out & status.isNotNull() & ~status.isin("completed", "success")).cast("int"))
    cols = [F.coalesce(F.sum((F.col("type") == t).cast("int")), F.lit(0)).alias(f"{t}s") for t in counted]
    return events.agg(F.coalesce(good, F.lit(0)).alias("successes"), F.coalesce(bad, F.lit(0)).alias("failures"), (good / F.when(good + bad > 0, good + bad)).alias("rate"), *cols)
