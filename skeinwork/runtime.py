"""Session set-up and the shared folder in which lineage is cut.

On a cluster ``spark.checkpoint.dir`` names a folder every executor can reach;
it is read from the session and never replaced. Where it is unset a temporary
folder is made, but only if the master is local: elsewhere that is an error. All tables
of a session lie in one folder of their own in it, which goes when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose rows are small is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000
#: Bytes up to which such a side is broadcast.
BROADCAST_BYTES = 256 << 20
_MARKED: set[str] = set()


def build_session(app: str = "skeinwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, made if the session has none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        made = tempfile.mkdtemp(prefix="skeinwork-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one. It is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/skeinwork-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _MARKED.add(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there.

    Unlike a cached or locally checkpointed frame it survives lost executors, and
    columns are still pruned by later readers. Column names must be unique.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (counted up to that bound only)."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int = 256) -> DataFrame:
    """``df`` with a broadcast hint if it is within the bounds of rows and of bytes, else unchanged. Bytes are
    counted as ``row_bytes`` for what has a fixed width, plus the lengths of texts and binaries."""
    wide = [c for c, k in df.dtypes if k in ("string", "binary")]
    some = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.octet_length(F.col(f"`{c}`"))).alias(f"b{i}") for i, c in enumerate(wide))).first()
    size = some[0] * row_bytes + sum(b or 0 for b in some[1:])
    return df.hint("broadcast") if some[0] <= rows and size <= BROADCAST_BYTES else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a column that numbers its rows from 0 by ``order``. Rows are dealt out by range and numbered within
    their range from what lies before it, so that no task holds them all."""
    from pyspark.sql import Window

    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # a row per partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def _dealt(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows by ranges of key and order together, so that the rows of one key may lie in any number of ranges: with ``_range``."""
    return stored(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, key: list[str], order: list[str], amounts: dict) -> DataFrame:
    """``df`` with the running sum of each amount, a named column, within a key by ``order``, the row itself included. Sums run within
    ranges and are carried over from a key's earlier ranges, so that no task holds all rows of a large key."""
    from pyspark.sql import Window

    names = [f"_amount_{n}" for n in amounts]
    dealt = _dealt(df.select("*", *(a.alias(n) for a, n in zip(amounts.values(), names))), key, order)
    part = dealt.groupBy(*key, "_range").agg(*(F.sum(n).alias(f"{n}_in") for n in names))
    # a row for each range that a key has rows in
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_range").alias("_r"), *(F.sum(f"{n}_in").over(before).alias(f"{n}_before") for n in names))
    carry = hinted(stored(carry.where(" or ".join(f"{n}_before is not null" for n in names)), "carried"))
    within = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(n).over(within).alias(f"{n}_sum") for n in names))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(carry, same, "left")
    total = lambda n: F.when(F.col(f"{n}_sum").isNull(), F.col(f"{n}_before")).otherwise(F.col(f"{n}_sum") + F.coalesce(F.col(f"{n}_before"), F.lit(0)))
    return out.select(*df.columns, *(total(n).alias(name) for n, name in zip(names, amounts)))


def beside(df: DataFrame, key: list[str], order: list[str], value, name: str, ahead: bool = False) -> DataFrame:
    """``df`` with ``name``: a struct of the ``value`` of the row before (or ahead) of the same key by ``order``, null where there is none.
    Ranges hand theirs over at their ends, so that no task holds all rows of a large key."""
    from pyspark.sql import Window

    dealt = _dealt(df.withColumn("_value", F.struct(value.alias("v"))), key, order)
    end = (F.min_by if ahead else F.max_by)("_value", F.struct(*order))
    ends = dealt.groupBy(*key, "_range").agg(end.alias("_end"))
    step = F.lead if ahead else F.lag
    carry = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_range").alias("_r"), step("_end").over(Window.partitionBy(*key).orderBy("_range")).alias("_carried"))
    carry = hinted(stored(carry.where("_carried is not null"), "carried"))
    out = dealt.withColumn(name, step("_value").over(Window.partitionBy(*key, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out.join(carry, same, "left").select(*df.columns, F.coalesce(name, "_carried").alias(name))
