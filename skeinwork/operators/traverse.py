"""Breadth-first walks, strongly connected components and cycles over an edge list (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.runtime import stored


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, keys: list[str] | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``node, depth`` of what the seeds (node) reach along src -> dst, at the least depth, seeds at 0.

    With ``keys``, columns of ``seeds`` that name separate walks, all walks go on at once and
    the keys are part of the result. A round joins the frontier only, and ends early when it is empty.
    """
    keys = keys or []
    e = stored(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "steps")
    done = seeds.select(*keys, "node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    front, depth = done, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if depth > max_rounds:
            raise RuntimeError("too many rounds")
        step = front.join(e, front.node == e.src).select(*keys, F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))
        # one grouping tells what is new: it has no lesser depth
        done = stored(done.unionByName(step).groupBy(*keys, "node").agg(F.min("depth").alias("depth")), "met")
        front = done.where(F.col("depth") == depth)
        if depth != max_depth and front.limit(1).count() == 0:
            break
    return done


def dependencies_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """How many others each seed reaches: ``node, radius``, following its own dependencies."""
    found = reach(edges, seeds.select(F.col("node").alias("seed"), "node"), keys=["seed"])
    return found.groupBy(F.col("seed").alias("node")).agg((F.count(F.lit(1)) - 1).alias("radius"))


def change_impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """``node, depth`` of what depends on any seed, the seeds themselves left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds, max_depth).where("depth > 0")


def traverse(edges: DataFrame, root: object, labels: DataFrame, direction: str = "out", max_depth: int = 3, max_nodes: int = 500, max_tokens: int | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Nodes met from ``root`` in breadth-first order, cut before the first that would exceed ``max_nodes``
    or ``max_tokens``: node, depth, nth, cost, tokens (running), truncated (whether any was cut).

    ``edges`` is src, dst, confidence; ``labels`` node, name, path, whose lengths are a node's cost.
    Within a depth nodes come in ascending order, so the cut is stable.
    """
    e = edges.where(F.col("confidence") >= min_confidence).select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = {"out": e, "in": back, "both": e.union(back)}[direction]
    seed = labels.where(F.col("node") == F.lit(root)).select("node").distinct()
    met = reach(e, seed, max_depth).where("depth > 0")
    met = met.join(labels.groupBy("node").agg(F.min(F.struct("name", "path")).alias("l")), "node").select("node", "depth", (F.length("l.name") + F.length("l.path")).cast("long").alias("cost"))
    # a walk is bounded by max_nodes, so all but the first of these are left before they are numbered
    rank = Window.orderBy("depth", "node")
    first = met.orderBy("depth", "node").limit(max_nodes + 1)
    first = first.withColumn("nth", F.row_number().over(rank)).withColumn("tokens", F.sum("cost").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("nth") <= max_nodes) & (F.lit(True) if max_tokens is None else F.col("tokens") <= max_tokens)
    cut = F.max((~fits).cast("int")).over(Window.partitionBy()) == 1
    return first.withColumn("truncated", cut).where(fits)


def execution_flows(candidates: DataFrame, edges: DataFrame, max_depth: int = 4, max_flows: int = 25, min_confidence: float = 0.7) -> DataFrame:
    """Steps of the flows that start at the weightiest entry points: entry, kind, weight, node, depth, truncated.

    ``candidates`` is node, name, kind (main, handler, test, export), weight; order is by weight, then kind,
    then name and node. A flow is truncated if it comes to the greatest depth, even at a leaf.
    """
    order = F.expr("CASE kind WHEN 'main' THEN 0 WHEN 'handler' THEN 1 WHEN 'test' THEN 2 ELSE 3 END")
    top = candidates.orderBy(F.desc("weight"), order, "name", "node").limit(max_flows)
    top = stored(top.select(F.col("node").alias("entry"), "kind", "weight"), "entries")
    e = edges.where(F.col("confidence") >= min_confidence)
    steps = reach(e, top.select("entry", F.col("entry").alias("node")), max_depth, ["entry"])
    deep = F.max("depth").over(Window.partitionBy("entry")) >= max_depth
    return steps.withColumn("truncated", deep).join(F.broadcast(top), "entry").select("entry", "kind", "weight", "node", "depth", "truncated")


def entry_kind(name, path_is_test, exported):
    """main, test, handler or export by a function's name, its file and its export; null for none."""
    handler = name.rlike(r"(?i)^(handle[A-Z_]|route|get|post|put|delete|patch)") | name.endswith("Handler")
    return F.when(name.isin("main", "run"), "main").when(path_is_test, "test").when(handler, "handler").when(exported, "export")


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, component`` of all nodes; the component is its greatest node.

    Colours (the greatest node that reaches a node) are spread forward to a fixed point; from
    each colour's own node a walk back inside the colour gives one component; the rest goes on.
    Nodes without way in or out are taken out first, round by round.
    """
    e = stored(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "arcs")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    found = None
    for _ in range(max_rounds):
        size = e.count()
        for _ in range(3):  # trimming; what is left of long chains goes as colours of one node
            kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept = stored(kept.select("src", "dst"), "arcs")
            now = kept.count()
            e, size, before = kept, now, size
            if now == before:
                break
        if size == 0:
            break
        colour = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            spread = e.join(colour, e.src == colour.node).groupBy("dst").agg(F.max("colour").alias("c"))
            after = stored(colour.join(spread, colour.node == spread.dst, "left").select("node", F.greatest("colour", "c").alias("colour")), "colours")
            changed = after.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").limit(1).count()
            colour = after
            if not changed:
                break
        within = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select(F.col("node").alias("component"), "node")
        group = stored(reach(back, roots, keys=["component"]).select("node", "component"), "components")
        found = group if found is None else found.union(group)
        e = stored(e.join(group.select(F.col("node").alias("src")), "src", "left_anti").join(group.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "arcs")
    else:
        raise RuntimeError("too many rounds")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def circular(edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """Components of several nodes, or of one with a loop: component, members, size, largest first."""
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loops", F.lit(True))
    sizes = strong_components(edges).join(own, "node", "left").groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"), F.max("loops").alias("loops"))
    out = sizes.where("size > 1 or loops").select("component", "members", "size")
    return out.orderBy(F.desc("size"), "component").limit(limit) if limit else out
