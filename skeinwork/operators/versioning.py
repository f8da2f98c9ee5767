"""Content hashes of a dataset's files and folders, and what differs between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import sha256_hex
from skeinwork.runtime import stored


def symbol_hashes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, symbol_count, pagerank, hash`` per file; the hash covers ``name:line`` of its symbols by line and name."""
    s = symbols.select("file_id", "name", "line", "id").distinct()
    per = s.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("l"))
    text = F.array_join(F.transform(F.coalesce("l", F.array()), lambda x: F.concat(x["name"], F.lit(":"), x["line"].cast("string"))), "|")
    f = files.select("id", "path", "symbol_count", "pagerank").distinct()
    return f.join(per, "id", "left").select("path", "symbol_count", "pagerank", sha256_hex(text).alias("hash"))


def top_symbols(files: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    f = files.select(F.col("id").alias("file_id"), "path", "pagerank").distinct()
    s = symbols.select("id", "file_id", "name").distinct().join(f, "file_id")
    return s.orderBy(F.desc("pagerank"), "name", "path").limit(limit).select("name", "path", "pagerank")


def diff_hashes(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """``key, change``: added, removed, changed or unchanged. A null hash differs from any other, not from null."""
    a = before.select(key, F.col("hash").alias("h1"), F.lit(True).alias("in1"))
    b = after.select(key, F.col("hash").alias("h2"), F.lit(True).alias("in2"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(F.col("h1").eqNullSafe(F.col("h2")), "unchanged").otherwise("changed")
    return both.select(key, kind.alias("change"))


def diff_ranks(before: DataFrame, after: DataFrame, limit: int = 25) -> DataFrame:
    """Top symbols (name, path, pagerank) whose rank differs: rank before and after, null where absent, and the
    difference, largest first."""
    both = before.select("path", "name", F.col("pagerank").alias("before")).join(after.select("path", "name", F.col("pagerank").alias("after")), ["path", "name"], "full")
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    return both.where("not before <=> after").withColumn("delta", delta).orderBy(F.desc(F.abs("delta")), "path", "name").limit(limit)


def folder_hashes(files: DataFrame) -> DataFrame:
    """``path, hash`` of every folder ('' the root) over ``path, hash`` of files: a folder's hash covers its files'
    names and hashes, then its folders', both in order. Built from the deepest folders up, a
    round per depth, each a grouping with one row per child. A file's path counts once."""
    once = files.groupBy("path").agg(F.max("hash").alias("hash")).where("path is not null")
    depth = lambda p: F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))
    parent = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    name = lambda p: F.substring_index(p, "/", -1)
    kids = stored(once.select(parent(F.col("path")).alias("folder"), F.lit(0).alias("rank"), name(F.col("path")).alias("name"), F.concat(F.lit("file:"), name(F.col("path")), F.lit(":"), F.coalesce("hash", F.lit(""))).alias("text")), "kids")
    deepest = kids.agg(F.max(depth(F.col("folder")))).first()[0] or 0
    done, up = None, None
    for k in range(deepest, -1, -1):
        here = kids.where(depth(F.col("folder")) == k)
        if up is not None:
            here = here.unionByName(up)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "text"))), lambda x: x["text"]), "\n")
        hashes = here.groupBy(F.col("folder").alias("path")).agg(sha256_hex(text).alias("hash"))
        if k == 0:
            hashes = hashes.unionByName(kids.sparkSession.createDataFrame([("",)], "path string").join(hashes, "path", "left_anti").withColumn("hash", sha256_hex(F.lit(""))))
        # a folder's rows come once more by way of its parent; every third depth they are written down
        if (deepest - k) % 3 == 2 or k == 0:
            hashes = stored(hashes, "folders")
        done = hashes if done is None else done.unionByName(hashes)
        up = hashes.select(parent(F.col("path")).alias("folder"), F.lit(1).alias("rank"), name(F.col("path")).alias("name"), F.concat(F.lit("dir:"), name(F.col("path")), F.lit(":"), F.col("hash")).alias("text"))
    return done


def skippable(paths: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Paths with an unchanged folder above them (unchanged: path), the root included."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = paths.select("path", F.explode(F.array_distinct(steps)).alias("above"))
    return up.join(unchanged.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()


def stat_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: by how much each count of ``after`` (one row of counts) exceeds that of ``before``."""
    names = after.columns
    return before.select(*(F.col(c).alias(f"_{c}") for c in names)).crossJoin(after).select(*((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in names))


def seed_is_valid(counts: DataFrame) -> DataFrame:
    """Whether a copied index can be used: rows and fingerprint agree with what was recorded (files, recorded_files,
    fingerprint, recorded_fingerprint)."""
    return counts.withColumn("valid", (F.col("files") == F.col("recorded_files")) & F.col("fingerprint").eqNullSafe(F.col("recorded_fingerprint")))


def scan_reason(state: DataFrame) -> DataFrame:
    """``state`` with ``scan`` and ``reason``: whether an index has to be built anew at the start, by the first rule that holds.

    State has recorded (whether there is a record of the index), files, symbols, edges and calls of the index, files_now and latest_now
    of the folder, and files_then and latest_then as recorded, the last two null in records of old."""
    rules = [
        (~F.col("recorded"), True, "no record"), ((F.col("files") == 0) & (F.col("files_now") > 0), True, "empty index"), (F.col("files") == 0, False, "empty folder"),
        (F.col("files_then").isNull() | F.col("latest_then").isNull(), True, "no fingerprint"), (F.col("files_now") != F.col("files_then"), True, "other number of files"), (F.col("latest_now") > F.col("latest_then"), True, "later changes"),
        ((F.col("files") >= 50) & (F.col("symbols") >= 500) & (F.col("edges") == 0) & (F.col("calls") == 0), True, "unhealthy"),
    ]
    out = F.struct(F.lit(False).alias("scan"), F.lit("fresh").alias("reason"))
    for rule, scan, reason in reversed(rules):
        out = F.when(rule, F.struct(F.lit(scan).alias("scan"), F.lit(reason).alias("reason"))).otherwise(out)
    return state.withColumn("_r", out).select(*state.columns, F.col("_r.scan").alias("scan"), F.col("_r.reason").alias("reason"))


class _Hunks:
    """Hunks of a line diff in the making: up to three equal lines before a change, and after it until three are together."""

    def __init__(self, context: int):
        self.context, self.done, self.rows, self.ahead = context, [], [], []
        self.at = (1, 1)

    def equal(self, row: str) -> None:
        self.ahead.append(row)
        if not self.rows:
            del self.ahead[: -self.context]
            return
        self.rows.append(" " + row)
        if len(self.ahead) >= self.context:
            self.close()
            self.ahead = []

    def change(self, i: int, j: int, rows: list[str]) -> None:
        if not self.rows:
            self.at = (i - len(self.ahead) + 1, j - len(self.ahead) + 1)
            self.rows = [" " + r for r in self.ahead]
        self.ahead = []
        self.rows += rows

    def close(self) -> None:
        if self.rows:
            old, new = (sum(r[0] != x for r in self.rows) for x in "+-")
            self.done += [f"@@ -{self.at[0]},{old} +{self.at[1]},{new} @@", *self.rows]
        self.rows = []


def line_diff(old: str, new: str, path: str = "file", ahead: int = 10, context: int = 3) -> str:
    """A unified diff of two texts, '' if they are equal. At a difference the old line is looked for among the next
    ``ahead`` new ones, then the new line among the old; what lies before a find is added or removed, and
    without one both lines are replaced. It is no shortest diff. A hunk ends after three equal lines that follow
    each other in it; those are not repeated before the next."""
    a, b, i, j, out = old.split("\n"), new.split("\n"), 0, 0, _Hunks(context)
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.equal(a[i])
            i, j = i + 1, j + 1
            continue
        if i >= len(a):
            out.change(i, j, ["+" + b[j]])
            j += 1
            continue
        if (k := next((k for k in range(j, min(j + ahead, len(b))) if b[k] == a[i]), None)) is not None:
            out.change(i, j, ["+" + r for r in b[j:k]])
            j = k
        elif j < len(b) and (k := next((k for k in range(i, min(i + ahead, len(a))) if a[k] == b[j]), None)) is not None:
            out.change(i, j, ["-" + r for r in a[i:k]])
            i = k
        else:
            out.change(i, j, ["-" + a[i], *(["+" + b[j]] if j < len(b) else [])])
            i, j = i + 1, min(j + 1, len(b))
    out.close()
    return "\n".join([f"--- a/{path}", f"+++ b/{path}", *out.done]) if out.done else ""
