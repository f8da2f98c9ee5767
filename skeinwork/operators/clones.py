"""Clones in code: normalised tokens, min-hash signatures, banding, fragments, shapes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from skeinwork.runtime import stored

# Words that stay themselves, the pattern of a token, and the numbers of the signature.
KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch", "finally", "new", "delete", "typeof", "instanceof", "in", "of",
    "class", "extends", "implements", "interface", "enum", "const", "let", "var", "function", "async", "await", "yield", "import", "export", "from", "default", "static", "public",
    "private", "protected", "abstract", "override", "readonly", "void", "null", "undefined", "true", "false", "this", "super", "def", "self", "fn", "pub", "mut", "impl", "struct",
    "trait", "mod", "use", "crate", "match", "loop", "func", "go", "chan", "select", "defer", "range", "type", "package", "raise", "except", "pass", "lambda", "with", "as", "is",
    "not", "and", "or", "None", "True", "False"
]
TOKEN = r"""[a-zA-Z_$][A-Za-z0-9_]*|0[xXbBoO][0-9a-fA-F_]+|[0-9][0-9_.]*(?:[eE][+-]?[0-9]+)?[fFdDlLuU]?|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\sA-Za-z0-9_]"""
HASHES, RUN, BANDS, ROWS, LEAST_TOKENS = 128, 3, 16, 8, 5
WINDOW, LEAST_FRAGMENT = 12, 16


def tokens(text: Column) -> Column:
    """Tokens of a source text: strings as $S, numbers as $N, names as $I unless keywords."""
    # possessive loops match the same here, and long strings do not deepen the matcher's stack
    raw = F.regexp_extract_all(text, F.lit(f"({TOKEN.replace(')*', ')*+')})"), F.lit(1))
    words = F.array(*map(F.lit, KEYWORDS))
    name = lambda t: F.when(F.array_contains(words, t), t).otherwise(F.lit("$I"))
    return F.transform(raw, lambda t: F.when(t.rlike("^[\"'`]"), "$S").when(t.rlike("^[0-9]"), "$N").when(t.rlike("^[a-zA-Z_$]"), name(t)).otherwise(t))


def symbol_tokens(all_tokens: Column, line: Column, end_line: Column, lines: Column) -> Column:
    """The share of a file's tokens that falls on a symbol's lines, in proportion."""
    n = F.size(all_tokens)
    a, b = F.floor((line - 1) * n / lines).cast("int"), F.floor(end_line * n / lines).cast("int")
    return F.slice(all_tokens, a + 1, F.greatest(b - a, F.lit(0)))


#: Runs of which a task holds the hashes at a time.
HELD_RUNS = 20_000


class _Hasher:
    """Signatures of token lists; the hashes of a run are worked out once a task, as long as they are held."""

    def __init__(self, hashes: int):
        self.heads, self.seen = [f"{h}\x01".encode() for h in range(hashes)], {}

    def __call__(self, toks: list[str]) -> list[int] | None:
        if len(toks) < LEAST_TOKENS:
            return None
        if len(self.seen) > HELD_RUNS:
            self.seen.clear()
        sha, seen, rows = hashlib.sha256, self.seen, []
        for run in {"\0".join(toks[k : k + RUN]) for k in range(len(toks) - RUN + 1)}:
            if run not in seen:
                r = run.encode()
                seen[run] = np.fromiter((int.from_bytes(sha(h + r).digest()[:4], "big") for h in self.heads), np.int64, len(self.heads))
            rows.append(seen[run])
        return np.minimum.reduce(rows).tolist()


def signatures(rows: DataFrame, hashes: int = HASHES) -> DataFrame:
    """``rows`` (with an array column tokens) and their min-hash signature; null below five tokens. A hash is the first
    32 bits of SHA-256 over its number and a run of three tokens."""
    names = [f.name for f in rows.schema if f.name != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _Hasher(hashes)
        for batch in batches:
            sigs = [None if t is None else sign(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sigs, pa.list_(pa.int64()))], names=[*names, "minhash"])

    schema = StructType([*(f for f in rows.schema if f.name != "tokens"), StructField("minhash", ArrayType(LongType()))])
    return rows.mapInArrow(run, schema)


def agreement(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def _banded(s: DataFrame, id: str, bands: int, most: int | None) -> DataFrame:
    """Pairs ``a, b`` (a < b) of rows of which some band of the signature is equal; buckets of more than ``most`` rows are left out, by
    their counted size, so that they are never gathered."""
    rows = F.size("minhash") / bands
    keys = s.select(F.col(id).alias("a"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("minhash", (k * rows).cast("int") + 1, rows.cast("int"))))).alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1" + (f" and n <= {most}" if most else ""))
    keys = keys.join(sizes, ["band", "key"]).select("band", "key", "a")
    return keys.join(keys.withColumnRenamed("a", "b"), ["band", "key"]).where("a < b").select("a", "b").distinct()


def _agreeing(pairs: DataFrame, s: DataFrame, id: str, least: float) -> DataFrame:
    x, y = s.select(F.col(id).alias("a"), F.col("minhash").alias("ma")), s.select(F.col(id).alias("b"), F.col("minhash").alias("mb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", agreement(F.col("ma"), F.col("mb")).alias("similarity")).where(F.col("similarity") >= least)


def near_duplicates(sigs: DataFrame, least: float = 0.8, limit: int | None = 50, bands: int = BANDS, most: int | None = 100) -> DataFrame:
    """Pairs of symbols of different files whose signatures (id, file_id, minhash) agree in ``least``: id_a, id_b, similarity, the
    first ``limit`` by similarity. The reference semantics leave out buckets of more than ``most`` members. A pair a row: where
    very many symbols are equal, read ``near_classes``."""
    s = stored(sigs.where("minhash is not null").select("id", "file_id", "minhash"), "signatures")
    files = s.select("id", "file_id")
    pairs = _banded(s, "id", bands, most).join(files.select(F.col("id").alias("a"), F.col("file_id").alias("fa")), "a").join(files.select(F.col("id").alias("b"), F.col("file_id").alias("fb")), "b").where("fa <> fb").select("a", "b")
    out = _agreeing(pairs, s, "id", least).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "similarity")
    return out.orderBy(F.desc("similarity"), "id_a", "id_b").limit(limit) if limit else out


def near_classes(sigs: DataFrame, least: float = 0.8, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(members, links) of symbols by their signatures (id, file_id, minhash), without any bound: equal signatures are one class, named by
    its least id, so that copies never meet as pairs; members are id, file_id, class. Links are pairs of classes that agree in ``least``, not
    both of one and the same file only: class_a, class_b, similarity."""
    s = stored(sigs.where("minhash is not null").select("id", "file_id", "minhash", F.xxhash64("minhash").alias("h")), "signatures")
    one = stored(s.groupBy("h", "minhash").agg(F.min("id").alias("class"), F.min("file_id").alias("low"), F.max("file_id").alias("high")), "classes")
    members = s.join(one, ["h", "minhash"]).select("id", "file_id", "class")
    ends = one.select("class", "low", "high")
    pairs = _banded(one, "class", bands, None).join(ends.select(F.col("class").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha")), "a").join(ends.select(F.col("class").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb")), "b")
    pairs = pairs.where(F.least("la", "lb") != F.greatest("ha", "hb")).select("a", "b")
    return members, _agreeing(pairs, one, "class", least).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")


def fragments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hashes of every window of ``window`` tokens (id, tokens): id, token_offset, hash; none below 16 tokens."""
    fit = rows.where(F.size("tokens") >= window + 4)
    wins = F.transform(F.sequence(F.lit(0), F.size("tokens") - window), lambda k: F.sha2(F.array_join(F.slice("tokens", k + 1, window), "\u0000").cast("binary"), 256))
    return fit.select("id", F.posexplode(wins).alias("token_offset", "hash"))


def exact_duplicates(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Groups of rows of equal text: hash, copies, first (their least id)."""
    h = F.sha2(F.col(text).cast("binary"), 256)
    return rows.where(F.col(text).isNotNull()).groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min(id).alias("first")).where("copies > 1")


def shape(text: Column) -> Column:
    """Hash of a text's bracket skeleton: nesting and statement ends without anything between."""
    return F.sha2(F.regexp_replace(text, r"[^()\[\]{};]", "").cast("binary"), 256)
