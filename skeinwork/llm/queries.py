"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.funcdoc import code_description_pairs
from skeinwork.llm.generated import unwritten_files
from skeinwork.llm.mixing import Mixture
from skeinwork.llm.neardup import NearDuplicates, plain_path
from skeinwork.llm.reading import reading_levels, train
from skeinwork.llm.similar import most_similar, similar_pairs
from skeinwork.llm.splitting import split_oversized
from skeinwork.llm.tokenize import encode_corpus
from skeinwork.sources.tables import table

#: Cells that a query with no similarity floor looks into, as a share of all; with it the
#: recall of the ten nearest was 0.94 or more on the test tables (see the README).
FULL_PROBES = 0.65


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks")).select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "chunks"), k=10, min_cosine=0.9)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the query set: ids are texts, so their CRC-32 is what 100 divides."""
    c = table(spark, d, "chunks")
    return most_similar(c, k=10, queries=c.where("pmod(crc32(id), 100) = 0"), tables=1, probes=FULL_PROBES)


def _alike(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(table(spark, d, "chunks"), text="content", place=plain_path(F.col("file_path")), run=3, least=0.7, min_words=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).groups()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_description_pairs(*(table(spark, d, t) for t in ("symbols", "files", "source_texts")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("symbol_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return unwritten_files(*(table(spark, d, t) for t in ("files", "vendor_catalog", "source_texts")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("reason is not null").select("file_id")


def p7_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("reason is null").select("file_id", "path")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading_levels(docs, train(docs, table(spark, d, "reading_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4").select("doc_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_pieces, p2_found, p2_nearest, p4_found, p4_groups, p5_found, p5_pairs, p7_found, p7_handwritten, p8_ids, p9_mixture, p9_shares, p10_found, p10_levels]
    return {f.__name__: f for f in named}
