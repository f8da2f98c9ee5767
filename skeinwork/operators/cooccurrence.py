"""Pairs of items that occur together in groups (files in commits, parts in orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurring(rows: DataFrame, group: str, item: str, least_items: int = 2, most_items: int = 20, least_count: int = 2) -> DataFrame:
    """``item_a, item_b, together`` with item_a < item_b: in how many groups both occur.

    Only groups of ``least_items`` to ``most_items`` distinct items count, as in the
    reference's semantics; this also bounds the pairs of a group. Null groups and items and
    repeated rows add nothing. A group is paired inside one row, without a self-join.
    """
    pairs = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    # a group over the bound is recognised by its count, and never gathered
    size = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least_items, most_items))
    sets = pairs.join(size, "g", "left_semi").groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("s"))
    left = sets.select("s", F.posexplode("s").alias("at", "item_a"))
    both = left.select("item_a", F.explode(F.slice("s", F.col("at") + 2, most_items)).alias("item_b"))
    return both.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least_count)
