"""Streaming twins of the batch operators, on Structured Streaming.

Stateful ones give, over a finished stream, what their batch forms give over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinwork.operators.sessions import REPEATS, RING


def type_counts(events: DataFrame) -> DataFrame:
    """Running number of events and first and last timestamp per type (update or complete mode)."""
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def windowed_counts(events: DataFrame, at: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of event time; rows later than the watermark are left out (an extension)."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "type", "events")


def bursts(events: DataFrame, key: str, at: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """One row per burst of a key: its last time and its events; closed once the watermark passes the quiet time."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, quiet).alias("w"), key).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("events")).select(key, "last", "events")


def tail_repeats(ring: list, least: int = REPEATS) -> int | None:
    """How often the shortest pattern at the end of a list is repeated, if ``least`` times or more."""
    n = len(ring)
    for p in range(1, n):
        if n < 2 * p:
            break
        k = 0
        while n - 1 - k - p >= 0 and ring[n - 1 - k] == ring[n - 1 - k - p]:
            k += 1
        if k // p + 1 >= least:
            return k // p + 1
    return None


def live_loops(calls: DataFrame, least: int = REPEATS, ring: int = RING) -> DataFrame:
    """session_id, seq, repeats for every call (session_id, seq, signature) that ends a repeated pattern. The state of
    a session is its last ``ring`` signatures; rows of a micro-batch are taken in the order of seq."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            held = (held + [r.signature])[-ring:]
            if (n := tail_repeats(held, least)) is not None:
                out.append((key[0], int(r.seq), n))
        state.update((held,))
        yield pd.DataFrame(out, columns=["session_id", "seq", "repeats"])

    return calls.groupBy("session_id").applyInPandasWithState(step, "session_id string, seq long, repeats int", "ring array<string>", "append", GroupStateTimeout.NoTimeout)


def live_budgets(events: DataFrame, limit: float, warn: float = 0.8) -> DataFrame:
    """session_id, seq, used, state for every event (session_id, seq, tokens) from the warning share on. The state is a sum."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            used += int(r.tokens)
            if used >= limit * warn:
                out.append((key[0], int(r.seq), used, "over" if used >= limit else "warn"))
        state.update((used,))
        yield pd.DataFrame(out, columns=["session_id", "seq", "used", "state"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, seq long, used long, state string", "used long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str], order: str):
    """A ``foreachBatch`` function that keeps the latest row per key in a Parquet folder, written beside and then swapped by
    batch number, so that a batch repeated after a failure leaves the same table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        old = f"{path}/v={number - 1}"
        rows = batch
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(old)):
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        names = [c for c in batch.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(order, *[c for c in names if c != order])).alias("r")).select(*keys, "r.*")
        best.select(batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


#: Fixed value: how often events that have come in are written to the log.
FLUSH = "5 seconds"


def ingest(events: DataFrame, path: str, checkpoint: str, now: bool = False):
    """Append a stream of events to a log in Parquet, a flush every five seconds, or all that is there at once; gives the running query.
    A flush cut short is written again from the checkpoint, once."""
    w = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if now else w.trigger(processingTime=FLUSH)).start()
