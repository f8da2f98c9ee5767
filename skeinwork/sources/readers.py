"""Sources: files of a folder, commit logs, notebooks, script blocks, search output, code statistics, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.paths import is_indexable
from skeinwork.runtime import numbered, stored

# Bytes of a file that is indexed, commits read, matches kept, characters of a match.
MOST_BYTES, MOST_COMMITS, MOST_MATCHES, MATCH_CHARS = 500_000, 300, 100, 2000
# Folders that a walk goes down, and files that a plain listing gives.
DEEPEST, MOST_LISTED = 10, 5000


def source_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, mtime_ms, size, content`` of the indexable files under a folder. Only the contents of files that stay are read."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^\\Q" + base + "\\E/*", "")
    rows = rows.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")
    return walked(rows, most_bytes).withColumn("content", F.expr("make_valid_utf8(cast(content as string))"))


def walked(listing: DataFrame, most_bytes: int = MOST_BYTES, deepest: int = DEEPEST, most: int | None = None) -> DataFrame:
    """Rows of a listing (path, size, ...) that a walk keeps: indexable, smaller than ``most_bytes``, no part of the path hidden, at most
    ``deepest`` folders deep; with ``most``, the first of these by path."""
    deep = F.size(F.split("path", "/")) - 1 <= deepest
    out = listing.where(is_indexable(F.col("path")) & (F.col("size") < most_bytes) & ~F.col("path").rlike(r"(^|/)\.") & deep)
    return out.orderBy("path").limit(most) if most else out


def listed(listing: DataFrame, endings: list[str], most: int = MOST_LISTED) -> DataFrame:
    """The first ``most`` paths of a listing, by path, that end in one of the endings; packed scripts left out."""
    fit = F.lit(False)
    for e in endings:
        fit = fit | F.col("path").endswith(e)
    packed = F.col("path").endswith(".min.js") | F.col("path").endswith(".bundle.js")
    return listing.where(fit & ~packed).orderBy("path").limit(most)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: number of files and their latest change."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.max("mtime_ms").alias("latest"))


def commit_log(spark: SparkSession, path: str, mark: str = "---COMMIT---") -> DataFrame:
    """``commit, value``: the blocks of a log file, each opened by ``mark``, numbered from 1 in its order; read by blocks, not as one text."""
    rows = spark.read.option("lineSep", mark).text(path).withColumn("_at", F.monotonically_increasing_id())
    return numbered(rows.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != ""), ["_at"], "commit").select((F.col("commit") + 1).alias("commit"), "value")


def commit_files(blocks: DataFrame, text: str = "value", most: int | None = MOST_COMMITS) -> DataFrame:
    """``commit, path`` of blocks (commit, and a text with a name a line), of the first ``most`` commits."""
    rows = blocks.select("commit", F.explode(F.split(text, r"\r?\n")).alias("path")).select("commit", F.trim("path").alias("path"))
    rows = rows.where("path <> ''").distinct()
    if most is None:
        return rows
    first = blocks.select("commit").distinct().orderBy("commit").limit(most)
    return rows.join(F.broadcast(first), "commit", "left_semi")


def notebook_cells(notebooks: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """Code cells of notebooks with their place in a virtual text, one empty line between cells: id, cell, start_line, code.
    A blank code cell takes up one line; texts that are no notebook give no row."""
    schema = "cells array<struct<cell_type:string, source:string>>"
    raw = F.from_json(text, schema)
    cells = notebooks.select(F.col(id).alias("id"), F.posexplode(raw["cells"]).alias("cell", "c")).where("c.cell_type = 'code'")
    # a source is a text or a list of texts; lists come as their JSON
    source = F.when(F.col("c.source").startswith("["), F.array_join(F.from_json("c.source", "array<string>"), "")).otherwise(F.col("c.source"))
    from pyspark.sql import Window

    lines = F.when(F.trim("code") == "", 1).otherwise(F.size(F.split("code", "\n")) + 1)
    w = Window.partitionBy("id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.select("id", "cell", F.coalesce(source, F.lit("")).alias("code")).withColumn("start_line", 1 + F.coalesce(F.sum(lines).over(w), F.lit(0)))
    return rows.where("trim(code) <> ''")


def script_blocks(pages: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """Script elements of marked-up texts: id, nth, start_line, lang, module, code."""
    pattern = r"(?is)<script(\b[^>]*)>(.*?)</script>"
    heads = F.split(text, r"(?i)<script\b")
    attrs, codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    rows = pages.select(F.col(id).alias("id"), heads.alias("h"), F.posexplode(F.arrays_zip(attrs.alias("a"), codes.alias("c"))).alias("nth", "s"))
    above = F.aggregate(F.slice("h", F.lit(1), F.col("nth") + 1), F.lit(0), lambda acc, x: acc + F.size(F.split(x, "\n")) - 1)
    ts = F.col("s.a").rlike(r"(?i)lang\s*=\s*[\"']?(ts|typescript)")
    return rows.select("id", "nth", (above + 2).alias("start_line"), F.when(ts, "ts").otherwise("js").alias("lang"), F.col("s.a").rlike(r"(?i)type\s*=\s*[\"']?module").alias("module"), F.col("s.c").alias("code"))


def match_events(lines: DataFrame, text: str = "value", order: str = "nth", most: int = MOST_MATCHES) -> DataFrame:
    """The first ``most`` matches, by ``order``, of search events, one a row: path, line, text; other kinds of event and broken lines left out."""
    e = F.from_json(text, "type string, data struct<path:struct<text:string>, line_number:int, lines:struct<text:string>>")
    rows = lines.select(e.alias("e"), F.col(order).alias("_at")).where("e.type = 'match'").orderBy("_at").limit(most)
    return rows.select(F.col("e.data.path.text").alias("path"), F.col("e.data.line_number").alias("line"), F.rtrim("e.data.lines.text").alias("text"))


def match_lines(text: Column) -> Column:
    """Struct of path, line and text of a ``path|line|text`` row, text cut; null with fewer parts."""
    p = F.split(text, r"\|", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("path"), p[1].try_cast("int").alias("line"), F.substring(p[2], 1, MATCH_CHARS).alias("text")))


def code_stats(rows: DataFrame) -> DataFrame:
    """Lines of code per language (language, files, code, comments, blanks), most code first."""
    g = rows.groupBy("language").agg(*(F.sum(c).alias(c) for c in ("files", "code", "comments", "blanks")))
    return g.orderBy(F.desc("code"), "language")


def extension_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """``extension, files``: after the last dot of the name unless it is the first sign, else ``(none)``."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(F.length(name) - F.length(F.substring_index(name, ".", -1)) > 1, F.lower(F.substring_index(name, ".", -1))).otherwise("(none)")
    return files.select(ext.alias("extension")).groupBy("extension").agg(F.count(F.lit(1)).alias("files"))


def _label(label: str) -> str:
    plain = re.sub(r"[^a-zA-Z0-9._-]+", "-", label.strip()).strip("-")
    if not plain:
        raise ValueError("a label needs letters, digits, dots, dashes or underscores")
    return plain


SNAPSHOT_VERSION = 1


def save_snapshot(df: DataFrame, folder: str, label: str) -> str:
    """Write a snapshot under a label, other signs in it as dashes, and return its path."""
    path = f"{folder.rstrip('/')}/{_label(label)}"
    df.withColumn("_version", F.lit(SNAPSHOT_VERSION)).write.mode("overwrite").parquet(path)
    return path


def load_snapshot(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """A snapshot by its label; an error if it has another version."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{_label(label)}")
    got = [r[0] for r in df.select("_version").distinct().limit(2).collect()] if "_version" in df.columns else [None]
    if any(v != SNAPSHOT_VERSION for v in got):
        raise ValueError(f"a snapshot of version {got[0]}, not {SNAPSHOT_VERSION}")
    return df.drop("_version")


def snapshot_labels(spark: SparkSession, folder: str) -> list[str]:
    """The labels under a folder, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def code_stats_of(reports: DataFrame, text: str = "value") -> DataFrame:
    """``language, files, code, comments, blanks`` of JSON reports: an object of languages with their reports of files and counts, or an
    array of objects with Name, Count, Code, Comment and Blank. Broken texts give no row."""
    by_name = F.from_json(text, "map<string, struct<code:long, comments:long, blanks:long, reports:array<struct<name:string>>>>")
    one = reports.where(F.col(text).startswith("{")).select(F.explode(by_name).alias("language", "r")).where("language <> 'Total' and r is not null")
    one = one.select("language", F.coalesce(F.size("r.reports"), F.lit(0)).cast("long").alias("files"), "r.code", "r.comments", "r.blanks")
    listed_ = F.from_json(text, "array<struct<Name:string, Count:long, Code:long, Comment:long, Blank:long>>")
    two = reports.where(F.col(text).startswith("[")).select(F.explode(listed_).alias("r")).where("r.Name is not null")
    return code_stats(one.unionByName(two.select(F.col("r.Name").alias("language"), F.col("r.Count").alias("files"), F.col("r.Code").alias("code"), F.col("r.Comment").alias("comments"), F.col("r.Blank").alias("blanks"))))


def repositories(registry: DataFrame, selectors: list[str]) -> DataFrame:
    """Registered repositories (name, path, registered_at) that are selected by name, else by path, in order, each once; ``all`` alone selects
    all, by name. A selector that names none is an error."""
    if selectors == ["all"]:
        return registry.select("name", "path").orderBy("name")
    wanted = registry.sparkSession.createDataFrame([(s, k) for k, s in enumerate(dict.fromkeys(selectors))], "sel string, k int")
    hit = registry.join(F.broadcast(wanted), (F.col("name") == F.col("sel")) | (F.col("path") == F.col("sel")))
    hit = stored(hit.select("sel", "k", "name", "path", (F.col("name") == F.col("sel")).alias("by_name")), "selected")
    missed = wanted.join(hit.select("sel").distinct(), "sel", "left_anti").orderBy("k").first()
    if missed is not None:
        raise ValueError(f"no such repository: {missed.sel}")
    best = hit.groupBy("sel", "k").agg(F.max_by(F.struct("name", "path"), "by_name").alias("r")).select("k", "r.*")
    return best.groupBy("name", "path").agg(F.min("k").alias("k")).orderBy("k").select("name", "path")


def stale_caches(folders: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Cache folders (name of 16 hex digits, mtime_ms) older than a number of days."""
    return caches(folders).where(F.col("mtime_ms") < now_ms - days * 86_400_000)


def caches(folders: DataFrame) -> DataFrame:
    """Rows of a listing (name, ...) that are cache folders: 16 hex digits."""
    return folders.where(F.col("name").rlike("^[0-9a-f]{16}$"))
