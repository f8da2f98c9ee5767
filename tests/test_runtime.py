import random

import pytest
from pyspark.sql import functions as F

from skeinwork.runtime import beside, hinted, numbered, running_sums, session_dir, shared_dir, stored


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [("hot", k, r.choice([None, 1, 2, 3])) for k in range(700)] + [(f"k{r.randrange(9)}", k, r.randrange(5)) for k in range(700, 900)] + [(None, k, 1) for k in range(900, 1000)]
    r.shuffle(out)
    return out


def test_running_sums_of_a_hot_key(spark, rows):
    df = spark.createDataFrame(rows, "key string, at int, v int")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["at"]: (r.s, r.n) for r in running_sums(df, ["key"], ["at"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
        seen: dict = {}
        for key, at, v in sorted(rows, key=lambda r: r[1]):
            s, n = seen.get(key, (None, 0))
            seen[key] = (s if v is None else v + (s or 0), n + 1)
            assert got[at] == seen[key]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert running_sums(df.limit(0), ["key"], ["at"], {"s": F.col("v")}).count() == 0


def test_rows_beside_of_a_hot_key(spark, rows):
    df = spark.createDataFrame(rows, "key string, at int, v int")
    for ahead in (False, True):
        got = {r["at"]: r.x and (r.x.v,) for r in beside(df, ["key"], ["at"], F.col("v"), "x", ahead).collect()}
        last: dict = {}
        for key, at, v in sorted(rows, key=lambda r: r[1], reverse=ahead):
            assert got[at] == last.get(key)
            last[key] = (v,)


def test_numbers(spark, rows):
    got = numbered(spark.createDataFrame(rows, "key string, at int, v int"), ["at"], "n").collect()
    assert sorted((r["at"], r.n) for r in got) == [(k, k) for k in range(1000)]


def test_folders_and_broadcasts(spark, monkeypatch):
    at = stored(spark.range(3), "three").inputFiles()[0]
    assert session_dir(spark) in at and shared_dir(spark) in session_dir(spark)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(hinted(wide)).lower() and "broadcast" not in plan(hinted(wide, 5)).lower()
    monkeypatch.setattr("skeinwork.runtime.BROADCAST_BYTES", 5000)
    assert "broadcast" not in plan(hinted(wide)).lower()


def test_a_cluster_needs_a_shared_folder():
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            @staticmethod
            def getConf():
                return {}

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class E:
                                @staticmethod
                                def isEmpty():
                                    return True

                            return E

                    return S

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        shared_dir(Far)
