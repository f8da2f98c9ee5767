from pyspark.sql import functions as F

from skeinwork.operators.sessions import loops
from skeinwork.streaming import live


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def source(spark, tmp_path, rows, schema, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_loops_as_in_batch(spark, tmp_path):
    rows = [("s", k, "abcabcabcxyz"[k]) for k in range(9)] + [("t", 100 + k, "q") for k in range(2)]
    schema = "session_id string, seq long, signature string"
    got = run(spark, live.live_loops(source(spark, tmp_path, rows, schema)), "loops")
    last = {r.session_id: r.repeats for r in got.groupBy("session_id").agg(F.max_by("repeats", "seq").alias("repeats")).collect()}
    want = {r.session_id: r.repeats for r in loops(spark.createDataFrame(rows, schema), "session_id", ["seq"], "signature").collect()}
    assert last == want == {"s": 3}


def test_budgets(spark, tmp_path):
    rows = [("s", k, 10) for k in range(10)] + [("t", 50, 5)]
    got = run(spark, live.live_budgets(source(spark, tmp_path, rows, "session_id string, seq long, tokens long"), 90), "budgets").collect()
    assert sorted((r.seq, r.used, r.state) for r in got) == [(7, 80, "warn"), (8, 90, "over"), (9, 100, "over")]


def test_counts_and_bursts(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1)
    rows = [("x", t0 + dt.timedelta(seconds=s), int(s)) for s in (0, 1, 2, 100, 101, 5000)]
    src = source(spark, tmp_path, rows, "type string, at timestamp, timestamp long", 1)
    got = run(spark, live.type_counts(src), "counts", "complete").collect()
    assert [(r.type, r.events, r["first"], r["last"]) for r in got] == [("x", 6, 0, 5000)]
    src = spark.readStream.schema("type string, at timestamp, timestamp long").parquet(str(tmp_path))
    b = run(spark, live.bursts(src, "type", "at", "10 seconds", "1 second"), "bursts").collect()
    assert sorted(r.events for r in b)[:2] == [2, 3]


def test_upserts(spark, tmp_path):
    write = live.upsert_sink(str(tmp_path / "kv"), ["key"], "at")
    s = "key string, data string, at long"
    write(spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], s), 0)
    for _ in range(2):  # a batch that is repeated leaves the same
        write(spark.createDataFrame([("a", "3", 5), ("b", "0", 1)], s), 1)
    assert {(r.key, r.data) for r in spark.read.parquet(str(tmp_path / "kv" / "v=1")).collect()} == {("a", "3"), ("b", "2")}


def test_windows_leave_out_what_is_late(spark, tmp_path):
    import os
    from datetime import datetime

    from skeinwork.streaming.live import windowed_counts

    schema = "type string, at timestamp"
    batches = [[("a", "2026-01-01 10:05:00"), ("a", "2026-01-01 10:50:00"), ("b", "2026-01-01 10:10:00")], [("a", "2026-01-01 12:30:00")], [("a", "2026-01-01 12:31:00")], [("a", "2026-01-01 10:01:00"), ("b", "2026-01-01 12:40:00")], [("b", "2026-01-01 20:00:00")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(t, datetime.fromisoformat(x)) for t, x in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        for f in (tmp_path / "in" / f"{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "at").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.type, r.start.hour): r.events for r in spark.table("windows").collect()}
    # the row of 10:01 came when the watermark had passed its window
    assert got[("a", 10)] == 2 and got[("b", 10)] == 1 and got[("a", 12)] == 2


def test_ingest_by_flushes(spark, tmp_path):
    from skeinwork.streaming.live import ingest

    rows = [(k, "undo", None, "p", 1_770_000_000_000 + k, "{}") for k in range(7)]
    schema = "id long, type string, session_id string, project_id string, timestamp long, data string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    q = ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck"), now=True)
    q.awaitTermination()
    assert spark.read.schema(schema).parquet(str(tmp_path / "log")).count() == 7
