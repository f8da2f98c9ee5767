"""Chunks of texts and search in them: line chunks, roll-up, cosine, BM25, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import stored

# Lines of a chunk and of its overlap, sizes of the roll-up, and numbers of the ranking.
LINES, OVERLAP, CHARS = 50, 10, 2000
SMALL, LARGE = 50, 400
FUSION, K1, B, OVERFETCH = 60, 1.2, 0.75, 3
#: Query vectors that go to every task at a time.
QUERIES_AT_ONCE = 10_000


def line_chunks(texts: DataFrame, id: str, text: str, lines: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``lines`` lines that overlap: id, start_line, end_line, content. Blank chunks are left out. A window at
    the end is followed by one of the overlap alone, as the next start lies ``overlap`` before the end."""
    rows = texts.select(F.col(id).alias("id"), F.split(F.col(text), "\n").alias("l")).where("l is not null")
    n, step = F.size("l"), lines - overlap if lines > overlap else lines
    # starts 0, step, ...; the last full window ends at n, then one more start at n - overlap where that is ahead
    full = F.ceil((n - lines) / step).cast("int")
    starts = F.when(n <= lines, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), full), lambda k: k * step))
    tail = n - overlap
    last = F.element_at(starts, -1)
    starts = F.when((F.lit(overlap) > 0) & (tail > last), F.concat(starts, F.array(tail))).otherwise(starts)
    cut = rows.select("id", "l", F.explode(starts).alias("a")).select("id", (F.col("a") + 1).alias("start_line"), F.least(F.col("a") + lines, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("a") + 1, lines), "\n").alias("content"))
    return cut.where(F.length(F.trim(F.regexp_replace("content", r"\s+", " "))) > 0)


def symbol_chunks(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks at symbols (file_id, name, line, end_line), and of the lines before, between and after them:
    file_id, start_line, end_line, symbol_name. ``lines`` is file_id, n."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("line", "end_line", "name")
    s = symbols.select("file_id", "name", "line", "end_line").distinct()
    s = s.withColumn("before", F.coalesce(F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = s.select("file_id", F.col("line").alias("start_line"), "end_line", F.col("name").alias("symbol_name"))
    gap = s.where("line > before + 1").select("file_id", (F.col("before") + 1).alias("start_line"), (F.col("line") - 1).alias("end_line"), F.lit(None).cast("string").alias("symbol_name"))
    last = s.groupBy("file_id").agg(F.max("end_line").alias("last"))
    tail = lines.join(last, "file_id", "left").where("n > coalesce(last, 0)").select("file_id", (F.coalesce("last", F.lit(0)) + 1).alias("start_line"), F.col("n").alias("end_line"), F.lit(None).cast("string").alias("symbol_name"))
    return own.unionByName(gap).unionByName(tail)


def split_lines(content: str, first: int, most: int = CHARS) -> list[tuple[int, int, str]]:
    """A content cut greedily into whole lines of at most ``most`` characters, one line at least."""
    lines, out, a = content.split("\n"), [], 0
    if len(content) <= most:
        return [(first, first + len(lines) - 1, content)]
    while a < len(lines):
        b, size = a, 0
        while b < len(lines) and size + len(lines[b]) + 1 <= most:
            size, b = size + len(lines[b]) + 1, b + 1
        b = max(b, a + 1)
        out.append((first + a, first + b - 1, "\n".join(lines[a:b])))
        a = b
    return out


def split_chunks(chunks: DataFrame, most: int = CHARS) -> DataFrame:
    """Chunks (id, start_line, content) no longer than ``most`` characters, by whole lines: id, part, start_line, end_line, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *p) for i, a, c in zip(*(batch.column(n).to_pylist() for n in ("id", "start_line", "content"))) for k, p in enumerate(split_lines(c, a or 1, most))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["id", "part", "start_line", "end_line", "content"])

    kind = dict(chunks.dtypes)["id"]
    return chunks.where("content is not null").select("id", F.col("start_line").cast("int"), "content").mapInArrow(run, f"id {kind}, part int, start_line int, end_line int, content string")


def roll_up(chunks: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Small chunks of a file merged with the one that ends right before them: file_path, start_line, end_line, content,
    symbol_name, symbol_kind. Order-dependent, so a fold per file; a file's chunks are bounded by its size."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(["start_line", "end_line", "content"], na_position="first").to_dict("records"):
            last = out[-1] if out else None
            a = -(-len(last["content"]) // 4) if last else 0
            b = -(-len(r["content"]) // 4)
            if last is None or last["end_line"] + 1 != r["start_line"] or (a >= small and b >= small) or a + b + 1 > large:
                out.append(r)
                continue
            same = last["symbol_name"] is not None and last["symbol_name"] == r["symbol_name"] and last["symbol_kind"] == r["symbol_kind"]
            last |= {"end_line": r["end_line"], "content": last["content"] + "\n" + r["content"]} | ({} if same else {"symbol_name": None, "symbol_kind": None})
        return pd.DataFrame(out, columns=pdf.columns)

    cols = chunks.select("file_path", "start_line", "end_line", "content", "symbol_name", "symbol_kind").where("file_path is not null and content is not null").distinct()
    return cols.groupBy("file_path").applyInPandas(fold, cols.schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where lengths differ or one is all zero."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors (id, vec) of highest cosine for each query (query, qvec): query, id, score, rank; ties go to the lesser id. A
    cosine is 0 where lengths differ or one vector is all zero, or null. A stated set of queries against all vectors: these are read
    once, in blocks that meet the queries as a matrix, and each block keeps its k best, so only those are shuffled. The
    queries, at most 10,000 at a time, go to every task; more are taken in as many passes as they need."""
    from pyspark.sql import Window

    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["query"], dict(vectors.dtypes)["id"]
    out_schema = f"query {kinds[0]}, id {kinds[1]}, score double"
    asked = stored(queries.select("query", F.col("qvec").cast("array<double>").alias("qvec")), "queries")
    total, found = asked.count(), None
    passes = max(1, -(-total // QUERIES_AT_ONCE))
    for n in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == n)
        some = part.toArrow()
        shared = spark.sparkContext.broadcast((some.column("query").combine_chunks(), some.column("qvec").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vecs = shared.value
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_size.setdefault(len(v) if v is not None else 0, []).append(i)
            for batch in batches:
                ids, column = batch.column("id"), batch.column("vec")
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                for size, rows in by_size.items():
                    score = np.zeros((len(rows), batch.num_rows))
                    fit = np.flatnonzero(sizes == size) if size else np.empty(0, int)
                    if len(fit):
                        x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fit), size)
                        q = np.array([vecs[i] for i in rows], float)
                        norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                        score[:, fit] = np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0)
                    if batch.num_rows > k:
                        # all that tie with the k-th stay, as the lesser id decides
                        least = np.partition(score, batch.num_rows - k, axis=1)[:, batch.num_rows - k, None]
                        a, b = np.nonzero(score >= least - 1e-12)
                    else:
                        a, b = np.divmod(np.arange(score.size), max(1, batch.num_rows))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.array(rows, int)[a])), ids.take(pa.array(b)), pa.array(score[a, b])], names=["query", "id", "score"])

        one = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, out_schema)
        found = one if found is None else found.union(one)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def query_words(query: str) -> list[str]:
    """Words of a query, signs of the match syntax stripped, each once."""
    import re

    return list(dict.fromkeys(w for part in query.split() for w in re.split(r"[^a-z0-9_]+", re.sub(r"[\"'()*]", "", part).lower()) if w))


def bm25(texts: DataFrame, query: str, id: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Okapi BM25 of the texts that hold any word of the query: id, score. Only the query's words are counted
    per text, in place; what is shuffled is one row of statistics."""
    words = query_words(query)
    base = texts.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), words_of(F.col(text)).alias("w"))
    count = lambda q: F.size(F.filter("w", lambda x: x == F.lit(q)))
    tf = [count(q).alias(f"t{i}") for i, q in enumerate(words)]
    # stored, as the counts serve the statistics and the scores
    counted = stored(base.select("id", F.size("w").alias("n"), *tf), "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(words))))
    both = counted.where(" or ".join(f"t{i} > 0" for i in range(len(words))) or "false").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return both.select("id", score.alias("score"))


def fuse(lists: dict[str, DataFrame], k: int = FUSION, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): id, score, and each list's rank, null where absent."""
    rows = None
    for name, df in lists.items():
        part = df.select("id", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("list"))
        rows = part if rows is None else rows.union(part)
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    out = rows.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *ranks)
    return out.orderBy(F.desc("score"), "id").limit(top) if top else out


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of ``id, score`` with their rank."""
    from pyspark.sql import Window

    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def search(texts: DataFrame, query: str, vector: list[float], mode: str = "hybrid", k: int = 10) -> DataFrame:
    """Texts (id, text, vec) found by meaning, by words, or by both with three times as many of each fused."""
    spark = texts.sparkSession
    q = spark.createDataFrame([(0, vector)], "query int, qvec array<double>")
    n = k * OVERFETCH if mode == "hybrid" else k
    if mode == "keyword":
        return ranked(bm25(texts, query), k).select("id", "score", "rank")
    near = cosine_top(q, texts.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec")), n).select("id", "score", "rank")
    if mode == "semantic":
        return near
    found = fuse({"semantic": near, "keyword": ranked(bm25(texts, query), n)})
    return ranked(found.select("id", "score"), k)


def replace_chunks(index: DataFrame, new: DataFrame, removed_files: DataFrame | None = None) -> DataFrame:
    """An index with the rows of ``new`` in place of those of equal id, and those of removed files left out."""
    old = index.join(new.select("id"), "id", "left_anti")
    if removed_files is not None:
        old = old.join(removed_files.select("file_path"), "file_path", "left_anti")
    return old.unionByName(new)


def pseudo_vectors(texts: DataFrame, id: str = "id", text: str = "text", dims: int = 64) -> DataFrame:
    """``id, vec``: reproducible stand-in vectors from a 32-bit rolling hash over UTF-16 units, at length one."""

    def vector(s: str) -> list[float]:
        units = np.frombuffer(s.encode("utf-16-le", "surrogatepass"), np.uint16)
        h = 0
        for u in units.tolist():
            h = (h * 31 + u) & 0xFFFFFFFF
        out = np.empty(dims, np.float32)
        for i in range(dims):
            h = (h * 31 + i) & 0xFFFFFFFF
            out[i] = (h & 0xFFFF) / 65536 - 0.5
        norm = float(np.sqrt((out.astype(float) ** 2).sum()))
        return (out.astype(float) / norm).astype(np.float32).tolist() if norm > 0 else out.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if t is None else vector(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))], names=["id", "vec"])

    kind = dict(texts.dtypes)[id]
    return texts.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, vec array<float>")
