"""The queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.operators.cooccurrence import cooccurring
from skeinwork.operators.features import session_features
from skeinwork.operators.logparse import parse_log
from skeinwork.plans import data, graph, index, inputs, store, text
from skeinwork.sources.tables import table


def cochange_parts(spark: SparkSession, d: str) -> DataFrame:
    return cooccurring(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    return session_features(table(spark, d, "telemetry_events"))


def p3_long(spark: SparkSession, d: str) -> DataFrame:
    return session_features(table(spark, d, "telemetry_events"), layout="long")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_log(table(spark, d, "forge_log")).select("first_line_id", "last_line_id", "ts_ms", "level", "component")


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    return parse_log(table(spark, d, "forge_log"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [cochange_parts, p3_features, p3_long, p6_found, p6_entries]
    return {f.__name__: f for f in named} | text.QUERIES | graph.QUERIES | data.QUERIES | index.QUERIES | inputs.QUERIES | store.QUERIES
