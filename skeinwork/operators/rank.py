"""Weighted PageRank with a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import BROADCAST_ROWS, stored

# Damping and rounds.
DAMPING, ROUNDS = 0.85, 20


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, cut_every: int = 5) -> DataFrame:
    """``node, rank`` after exactly ``rounds`` rounds from 1/n each. Rank flows along edges (src, dst,
    weight) by weight; that of nodes without outgoing edges is lost, and nothing is normalised. Edges
    from or to unknown nodes carry nothing in; their weight still counts at their source.

    Edges are divided by their source's weight once and stored; a round is one join and
    one aggregation with map-side combining. Ranks of few nodes, by their count, go to the edges, which then stay where they
    are; those of many meet them by a shuffle. Lineage is cut every few rounds.
    """
    v = stored(nodes.select("node").where("node is not null").distinct(), "nodes")
    n = v.count()
    if n == 0:
        return v.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.when(F.col("out") == 0, 1.0).otherwise(F.col("out"))).alias("share"))
    share = share.where("dst is not null").join(v, share.dst == v.node, "left_semi")
    # every node hands itself nothing, so that those that nothing leads to are in every round too
    share = stored(share.union(v.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0))), "shares")
    base = (1 - damping) / n
    ranks = v.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        near = ranks.hint("broadcast") if n <= BROADCAST_ROWS else ranks
        got = share.join(near, share.src == near.node).select(F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("x"))
        ranks = got.groupBy("node").agg((F.lit(base) + damping * F.sum("x")).alias("rank"))
        if k % cut_every == 0:
            ranks = stored(ranks, "ranks")
    return ranks
