"""One row per entity with counts, recency and totals for every event type.

Rows are spread over (entity, type, salt), the salt coming from the row's id, time and payload: a heavy
entity-type group is divided, with ids or without, and repeated rows still meet, so the one shuffle
of rows serves both their removal and the partial statistics. Partials are merged
per (entity, type), and the complete list of types is expanded at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import stored

#: Fixed value of the event log: a timestamp below this is in seconds.
SECONDS_BELOW = 100_000_000_000
WEEK_MS = 7 * 86_400_000
#: Most event types that are laid out as columns.
MOST_TYPES = 2000


def plain_type(kind: Column) -> Column:
    """One spelling of an event type; null and blank become ``unknown``."""
    name = F.regexp_replace(F.lower(F.trim(F.translate(kind, "-", "_"))), r"\s+", "_")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "unknown").otherwise(name)


def token_total(data: Column) -> Column:
    """The number after a ``tokens`` key anywhere in a payload, quoted, nested or in broken
    JSON, if the number itself is complete, whatever its length; 0 where there is none, or none
    that 64 bits hold."""
    found = F.regexp_extract(data, r'"tokens"\s*:\s*"?([0-9]+)\s*[",}]', 1)
    return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))


def in_ms(stamp: Column) -> Column:
    return F.when(stamp < SECONDS_BELOW, stamp * 1000).otherwise(stamp)


def last_full_week(events: DataFrame, stamp: str = "timestamp") -> int | None:
    """The last timestamp of the last week with at least a twentieth of the mean week's rows."""
    ts = in_ms(F.col(stamp))
    weeks = events.where(F.col(stamp).isNotNull()).groupBy(F.floor(ts / WEEK_MS).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    mean = weeks.agg(F.avg("n").alias("mean"))
    return weeks.join(F.broadcast(mean), F.col("n") >= F.col("mean") / 20).agg(F.max("last")).first()[0]


def session_features(events: DataFrame, as_of: int | None = None, salts: int = 16, layout: str = "wide", types: list[str] | None = None) -> DataFrame:
    """One row per session: its project, and for every event type the number of events,
    the milliseconds from the last of them to ``as_of``, and the tokens they total.

    Types differing in case, blanks or ``-`` for ``_`` are one; null or blank ones are
    ``unknown``. Timestamps in seconds become milliseconds. ``as_of`` defaults to the last
    timestamp of the last week that holds at least a twentieth of the mean week's rows;
    events after it (clocks running ahead) count and add tokens but are no last event, as
    do those without timestamp. The time is null where a type has no other event. Sessions
    without id have no row; a session's project is its greatest non-null one. Repeated
    rows (equal id, timestamp and payload within a session and type) count once.
    Missing or unreadable tokens add 0. Other columns are left aside.

    ``layout``: ``wide`` has columns ``<type>__n``, ``__since_ms`` and ``__tokens`` of every type
    in the data (or in ``types``), at most 2000 of them, and none where there are no events; ``long`` has one row per session and
    type that occurs.
    """
    if as_of is None:
        as_of = last_full_week(events)
    now = F.lit(as_of).cast("long")
    known = events.where("session_id is not null")
    # apart from the rest, whose buffers thus hold numbers only and need no sorting
    project = known.select("session_id", "project_id").distinct().groupBy("session_id").agg(F.max("project_id").alias("project_id"))
    rows = known.select("session_id", plain_type(F.col("type")).alias("type"), "id", in_ms(F.col("timestamp")).alias("ts"), token_total(F.col("data")).alias("tokens"), F.xxhash64("data").alias("payload"), F.pmod(F.xxhash64("id", in_ms(F.col("timestamp")), "data"), F.lit(salts)).cast("int").alias("salt"))
    # one shuffle: the two groupings that follow need no other
    rows = rows.repartition("session_id", "type", "salt")
    once = rows.groupBy("session_id", "type", "salt", "id", "ts", "payload").agg(F.max("tokens").alias("tokens"))
    last = F.max(F.when(F.col("ts") <= now, F.col("ts")))
    part = once.groupBy("session_id", "type", "salt").agg(F.count(F.lit(1)).alias("n"), last.alias("last"), F.sum("tokens").alias("tokens"))
    merged = part.groupBy("session_id", "type").agg(F.sum("n").alias("n"), (now - F.max("last")).alias("since_ms"), F.sum("tokens").alias("tokens"))
    # one row a session, so a hash table per partition holds it
    project = project.hint("shuffle_hash")
    if layout == "long":
        return merged.join(project, "session_id").select("session_id", "project_id", "type", "n", "since_ms", "tokens")
    merged = stored(merged, "features")
    if types is None:
        found = merged.select("type").distinct().orderBy("type").limit(MOST_TYPES + 1).collect()
        if len(found) > MOST_TYPES:
            raise ValueError(f"more than {MOST_TYPES} event types; use layout='long' or name the types")
        types = [r.type for r in found]
    if not types:
        return project
    wide = merged.groupBy("session_id").pivot("type", types).agg(F.max("n").alias("_n"), F.max("since_ms").alias("_since_ms"), F.max("tokens").alias("_tokens"))
    cols = []
    for t in types:
        cols += [F.coalesce(F.col(f"`{t}__n`"), F.lit(0).cast("long")).alias(f"{t}__n"), F.col(f"`{t}__since_ms`"), F.coalesce(F.col(f"`{t}__tokens`"), F.lit(0).cast("long")).alias(f"{t}__tokens")]
    return wide.join(project, "session_id").select("session_id", "project_id", *cols)
