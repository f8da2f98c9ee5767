"""Encoding a corpus with a public tokenizer through a table of distinct words.

Texts are split into words (the tokenizer's own pre-tokens) inside Spark, a block of
texts at a time; a block keeps its distinct words once and each text as positions in that
list. The distinct words of all blocks are encoded once each, their ids joined back to
the blocks by position, and each text's ids read off by its positions. A word however
frequent thus occurs at most once a block. Where blocks are very many a common word still is
a hot key of that join, whose partition adaptive execution splits by the blocks it comes from.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import stored

#: Where the vocabulary files lie; a parameter of every operator here.
FOLDER = "/opt/tokenizers"
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level vocabulary of a ``.tiktoken`` file; no string is special."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _blocks(key: str):
    """A block's distinct words, and its texts as positions in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, made = _pattern().findall, TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        ids: list = []
        rows: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal words, ids, rows, held, made
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))
            texts = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), lists], names=["doc", "at"])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), one(pa.array(list(words), pa.string())), one(texts)], names=["block", "words", "texts"])
            made += 1
            words, ids, rows, held = {}, [], [], 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(key).to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if held and held + len(text) > BLOCK_CHARS:
                    yield block()
                found = split(text)
                rows.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                ids.append(doc)
                held += len(text)
        if ids:
            yield block()

    return run


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)._core_bpe.encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "piece"])

    return run


def encode_corpus(documents: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of its text without special tokens.

    A null text and an empty text both give an empty list. What looks like a special token
    is ordinary text. Every row gives a row, repeated ones too; other columns are left
    aside. Texts are encoded whole, whatever their length.
    """
    rows = documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    full = rows.where(F.length("text") > 0)
    blocks = full.mapInArrow(_blocks("doc_id"), "block bigint, words array<string>, texts array<struct<doc:bigint,at:array<int>>>")
    blocks = stored(blocks, "blocks")
    listed = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    pieces = listed.select("word").distinct().mapInArrow(_encoder(f"{folder}/{vocabulary}"), "word string, piece array<int>")
    # one row a block again, its words' ids in the order of their positions
    coded = listed.join(pieces, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("l"))
    coded = coded.select("block", F.col("l.piece").alias("pieces"))
    texts = blocks.select("block", "texts").join(coded, "block")
    out = texts.mapInArrow(_join_back, "doc_id bigint, ids array<int>")
    none = rows.where("text is null or length(text) = 0").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return out.union(none)


def _join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's ids from its positions and the ids at these positions."""
    for batch in batches:
        for r in range(batch.num_rows):
            pieces, texts = batch.column("pieces")[r].values, batch.column("texts")[r].values
            size = pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pieces.flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            at = texts.field("at")
            for lo in range(0, len(texts), 2000):
                part = at.slice(lo, 2000)
                pos = part.flatten().to_numpy(zero_copy_only=False)
                n = size[pos]
                stop = np.cumsum(n)
                where = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - n, n) + np.repeat(begin[pos], n)
                ends = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                cum = np.concatenate([[0], stop])
                lists = pa.ListArray.from_arrays(pa.array(cum[ends].astype(np.int32)), pa.array(flat[where].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([texts.field("doc").slice(lo, 2000), lists], names=["doc_id", "ids"])


def pieces_of(vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> dict[int, bytes]:
    """The bytes of every id, a table whose size the vocabulary fixes."""
    e = byte_bpe(f"{folder}/{vocabulary}")
    return {i: e.decode_single_token_bytes(i) for i in e._mergeable_ranks.values()}


def decode_corpus(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``, by joining ids to their pieces; undecodable bytes become U+FFFD.

    Every row gives a row. A null list counts as empty; ids outside the vocabulary are an error.
    The vocabulary is broadcast: its size is fixed.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, b) for i, b in pieces_of(vocabulary, folder).items()], "id int, piece binary")
    rows = encoded.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    rows = stored(rows, "encoded")
    at = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id", "left")
    at = at.withColumn("piece", F.when(F.col("piece").isNull(), F.raise_error(F.lit("an id is not in the vocabulary")).cast("binary")).otherwise(F.col("piece")))
    text = at.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("l"))
    text = text.select("row", F.expr("unhex(array_join(transform(l, x -> hex(x.piece)), ''))").alias("b"))
    return rows.join(text, "row", "left").select("doc_id", F.coalesce(F.expr("try_validate_utf8(cast(b as string))"), F.expr("make_valid_utf8(cast(b as string))"), F.lit("")).alias("text"))


def token_counts(documents: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``doc_id, tokens`` of every row."""
    return encode_corpus(documents, id, text, vocabulary, folder).select("doc_id", F.size("ids").cast("long").alias("tokens"))
