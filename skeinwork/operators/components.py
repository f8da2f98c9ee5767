"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``node, component`` of every node that occurs in ``edges``; the component is its least node.

    Alternates large-star and small-star rounds, which need about the logarithm of the
    number of nodes. A round groups neighbours by minimum only, so a hub is aggregated
    before it is shuffled. Rows with a null end are left out; a loop makes its node
    a component of its own.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.select(a.alias("u"), b.alias("v")).where(a.isNotNull() & b.isNotNull())
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    now = stored(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the least in its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours point to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "stars")
        if not after.exceptAll(now).limit(1).count() and after.count() == now.count():
            break
        now = after
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    root = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
