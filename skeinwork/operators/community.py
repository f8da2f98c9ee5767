"""Communities of a weighted graph, bridges, and edges that surprise.

Label propagation in a fixed order depends on the order of single steps; weak components do not touch each
other, so they are worked on one by one, exactly. A component larger than the stated bound is propagated in
waves over all tasks, with the same result. Bridges are found by parts of the links, whatever their components.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.components import connected_components
from skeinwork.operators.graph_query import nth_value
from skeinwork.runtime import bounded, hinted, stored

#: Edges of one weak component that a task works on at most.
MOST_EDGES = 5_000_000
#: Links that a task looks for bridges in at once; a range of half as many more is still one.
LINKS = 2_000_000
#: Share of the links that a round of merging may leave for another one to follow.
LEFT = 0.7
# Rounds of label propagation, and the share of light edges that surprise.
ROUNDS, SURPRISE = 30, 0.25


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, weight`` with a < b: weights of both directions summed, loops left out."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def _components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, weight) with their weak component, and the components of more than ``MOST_EDGES`` links."""
    e = stored(edges, "undirected")
    comp = connected_components(e, "a", "b").withColumnRenamed("node", "a")
    rows = stored(e.join(comp, "a"), "by-component")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return rows, stored(sizes.where(F.col("n") > MOST_EDGES).select("component"), "large")


def _in_waves(links: DataFrame, rounds: int) -> DataFrame:
    """``node, label`` as ``propagate`` gives them, for links of any number. A node's turn in a round has come when all its lesser
    neighbours have had theirs; nodes whose turn has come are no neighbours, so they take theirs at once. As many steps a
    round as the longest rising path has nodes."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("near"), "weight").union(links.select("b", "a", "weight")), "near")
    state = stored(both.select("node").distinct().select("node", F.col("node").alias("label"), F.lit(-1).alias("turn")), "state")
    for k in range(rounds):
        old = state.select("node", F.col("label").alias("was"))
        while True:
            waits = state.where(F.col("turn") < k).select("node")
            held = both.where("near < node").join(waits.withColumnRenamed("node", "near"), "near", "left_semi").select("node").distinct()
            ready = stored(waits.join(held, "node", "left_anti"), "ready")
            if ready.limit(1).count() == 0:
                break
            votes = both.join(ready, "node").join(state.select(F.col("node").alias("near"), "label"), "near").groupBy("node", "label").agg(F.sum("weight").alias("w"))
            best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("best"))
            state = stored(state.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label"), F.when(F.col("best").isNotNull(), k).otherwise(F.col("turn")).alias("turn")), "state")
        if state.join(old, "node").where("label <> was").limit(1).count() == 0:
            break
    return state.select("node", "label")


def propagate(links: list[tuple], rounds: int = ROUNDS) -> dict:
    """Labels after asynchronous propagation over (a, b, weight), nodes in ascending order, ties to the least label."""
    near: dict = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    label = {n: n for n in near}
    order = sorted(near)
    for _ in range(rounds):
        moved = False
        for n in order:
            score: dict = {}
            for m, w in near[n].items():
                score[label[m]] = score.get(label[m], 0) + w
            best = min(score, key=lambda x: (-score[x], x))
            if best != label[n]:
                label[n], moved = best, True
        if not moved:
            break
    return label


def communities(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, community`` for edges (src, dst, weight): communities numbered from 0 by size, equal sizes by their least node."""
    kind = dict(edges.dtypes)["src"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        label = propagate(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)), rounds)
        return pd.DataFrame({"node": list(label), "label": list(label.values())})

    rows, large = _components(undirected(edges))
    got = rows.join(F.broadcast(large), "component", "left_anti").groupBy("component").applyInPandas(work, f"node {kind}, label {kind}")
    if large.limit(1).count():
        got = got.union(_in_waves(rows.join(F.broadcast(large), "component", "left_semi"), rounds))
    got = stored(got, "labels")
    sizes = got.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    # ranks by size need the number of larger communities, then the place among equals
    per_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = per_size.withColumn("before", before).select("size", "before")
    place = F.row_number().over(Window.partitionBy("size").orderBy("least")) - 1
    ids = sizes.withColumn("k", place).join(offset, "size").select("label", (F.col("before") + F.col("k")).alias("community"))
    return got.join(ids, "label").select("node", "community")


def community_weights(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``community, size, internal, external``: an inner edge counts once, an outer one at both ends."""
    a, b = assignment.select(F.col("node").alias("src"), F.col("community").alias("ca")), assignment.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.where("src <> dst").join(a, "src").join(b, "dst")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("internal"))
    ends = e.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("external"))
    sizes = assignment.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(inner, "community", "left").join(ends, "community", "left").select("community", "size", F.coalesce("internal", F.lit(0.0)).alias("internal"), F.coalesce("external", F.lit(0.0)).alias("external"))


def _ints(x: np.ndarray) -> array:
    """As an array whose items Python reads fast and in little memory."""
    return array("i", x.astype(np.int32, copy=False).tobytes())


def _walk(u: np.ndarray, v: np.ndarray, n: int) -> tuple[array, np.ndarray, array]:
    """Depth-first over links u - v of the nodes 0 to n - 1: nodes as they are met, the link each was met by and the node before
    (both -1 for the first of a component)."""
    ends = np.concatenate([u, v])
    by = np.argsort(ends, kind="stable")
    at = _ints(np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]))
    del ends
    near = _ints(np.concatenate([v, u])[by])
    via = _ints(by % len(u))
    del by
    stop = at[1:]
    came, order = _ints(np.full(n, -2)), array("i")
    for root in range(n):
        if came[root] != -2:
            continue
        came[root] = -1
        order.append(root)
        path = [root]
        while path:
            i, last = at[path[-1]], stop[path[-1]]
            while i < last and came[near[i]] != -2:
                i += 1
            if i == last:
                path.pop()
                continue
            at[path[-1]] = i + 1
            m = near[i]
            came[m] = via[i]
            order.append(m)
            path.append(m)
    by_link = np.frombuffer(came, np.int32)
    return order, by_link, _ints(np.where(by_link < 0, -1, u[by_link] + v[by_link] - np.arange(n, dtype=np.int32)))


def split(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which links u - v are bridges, and each node's group: nodes that no bridge parts, named by one of them. Links may recur;
    then they are no bridges."""
    order, came, up = _walk(u, v, n)
    place = np.empty(n, np.int32)
    place[np.frombuffer(order, np.int32)] = np.arange(n, dtype=np.int32)
    other = np.ones(len(u), bool)
    other[came[came >= 0]] = False
    low = place.copy()
    np.minimum.at(low, u[other], place[v[other]])
    np.minimum.at(low, v[other], place[u[other]])
    least = _ints(low)
    for m in reversed(order):
        if up[m] >= 0 and least[m] < least[up[m]]:
            least[up[m]] = least[m]
    parted = np.frombuffer(least, np.int32) == place
    group, cut = _ints(np.arange(n)), parted.tobytes()
    for m in order:
        if not cut[m]:
            group[m] = group[up[m]]
    bridge = np.zeros(len(u), bool)
    bridge[came[parted & (came >= 0)]] = True
    return bridge, np.frombuffer(group, np.int32)


def _coded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ends u and v of links as places in the list of their nodes."""
    kind = t.schema.field("u").type
    both = pa.chunked_array(t["u"].chunks + t["v"].chunks).cast({pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}.get(kind, kind))
    d = pa.concat_arrays(both.chunks).dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    return codes[: t.num_rows], codes[t.num_rows :], d.dictionary


def _merged(links: DataFrame, most: int) -> DataFrame:
    """Links (u, v, and a, b for what they are called, if it is not u, v) by as many as a task takes at once: those that are bridges among
    these, with a and b; and, without a and b, each node u of a group with the node v that names it."""
    kind = dict(links.dtypes)["u"]

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        u, v, names = _coded(t)
        bridge, group = split(u, v, len(names))
        some = t.filter(pa.array(bridge))
        yield from pa.table([some[c] for c in (("u", "v", "a", "b") if "a" in t.column_names else ("u", "v", "u", "v"))], ["u", "v", "a", "b"]).to_batches(100_000)
        inner = np.flatnonzero(group != np.arange(len(group)))
        of = t.schema.field("u").type
        none = pa.nulls(len(inner), of)
        yield from pa.table([names.take(pa.array(inner)).cast(of), names.take(pa.array(group[inner])).cast(of), none, none], ["u", "v", "a", "b"]).to_batches(100_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > most + most // 2:
                yield from found(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from found(held)

    return links.mapInArrow(work, f"u {kind}, v {kind}, a {kind}, b {kind}")


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (u, v, ...) between the nodes that ``names`` (node, name) gives for theirs, without those that became loops."""
    names = hinted(names)
    for end in ("u", "v"):
        links = links.join(names.select(F.col("node").alias(end), F.col("name").alias("_name")), end, "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    return links.where("u <> v")


def _xor(links: DataFrame) -> DataFrame:
    """``a, b, h, g`` of a forest's links over links (u, v, a, b, h, g), in one task: each has the exclusive or of h and of g of all links
    outside of the forest that go round it."""
    kind = dict(links.dtypes)["a"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        u, v, names = _coded(t)
        order, came, up = _walk(u, v, len(names))
        tree = came >= 0
        other = np.ones(t.num_rows, bool)
        other[came[tree]] = False
        sums = []
        for name in ("h", "g"):
            own, at = t[name].to_numpy(), np.zeros(len(names), np.int64)
            np.bitwise_xor.at(at, u[other], own[other])
            np.bitwise_xor.at(at, v[other], own[other])
            x = array("q", at.tobytes())
            for m in reversed(order):
                if up[m] >= 0:
                    x[up[m]] ^= x[m]
            sums.append(pa.array(np.frombuffer(x, np.int64)[tree]))
        some = t.take(pa.array(came[tree]))
        yield from pa.table([some["a"], some["b"], *sums], ["a", "b", "h", "g"]).to_batches(100_000)

    return links.repartition(1).mapInArrow(work, f"a {kind}, b {kind}, h long, g long")


def _by_sums(links: DataFrame, most: int) -> DataFrame:
    """``a, b`` of the bridges among links (u, v, a, b), for any number of links and nodes.

    Links outside of a spanning forest have 128 random bits, those within it the exclusive or of what goes round them, so that
    over all links at a node, or at nodes merged into one, it is zero. A bridge is a link that nothing goes round: zero (another link is with
    a chance of 2 to the power of -128). Half of the nodes by a coin merge into a neighbour of the other half, until a task can take what is left;
    then each merging, backwards, gives the link by which a node merged the exclusive or of the node's other links.
    """
    now = stored(links.select("u", "v", "a", "b", F.xxhash64(F.lit(1), "a", "b").alias("h"), F.xxhash64(F.lit(2), "b", "a").alias("g")), "summed")
    steps = []
    while not bounded(now, most):
        head = lambda c: F.pmod(F.xxhash64(F.lit(len(steps)), c), F.lit(2)) == 0
        both = now.select(F.col("u").alias("node"), F.col("v").alias("near"), "a", "b", "h", "g").union(now.select("v", "u", "a", "b", "h", "g"))
        picks = both.where(~head("node") & head("near")).groupBy("node").agg(F.min(F.struct("near", "a", "b")).alias("p"))
        picks = stored(picks.select("node", F.col("p.near").alias("name"), F.col("p.a").alias("pa"), F.col("p.b").alias("pb")), "picks")
        rest = both.join(picks, "node").where("a <> pa or b <> pb").select("node", "a", "b", "h", "g")
        steps.append((picks, stored(rest, "rest")))
        now = stored(_renamed(now, picks.select("node", "name")), "summed")
    tree = stored(_xor(now), "forest")
    for picks, rest in reversed(steps):
        known = rest.join(tree.select("a", "b", F.col("h").alias("th"), F.col("g").alias("tg")), ["a", "b"], "left")
        sums = known.groupBy("node").agg(F.bit_xor(F.coalesce("th", "h")).alias("h"), F.bit_xor(F.coalesce("tg", "g")).alias("g"))
        got = picks.join(sums, "node", "left").select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("g", F.lit(0)).alias("g"))
        tree = tree.union(stored(got, "forest"))
    return tree.where("h = 0 and g = 0").select("a", "b")


def find_bridges(links: DataFrame, most: int | None = None) -> DataFrame:
    """``a, b`` of the links (a, b) whose loss parts their component.

    Whatever is no bridge among some links is none among more, and nodes that no bridge parts stay so. So tasks take ranges
    of the links, leave out what is no bridge among these and name the groups; groups that share a node are one, and what is left
    between groups is dealt out anew, until one task takes it all or it no longer shrinks; then ``_by_sums`` decides.
    """
    most = most or LINKS
    now, n = links.select(F.col("a").alias("u"), F.col("b").alias("v")), links.count()
    while n > most:
        out = stored(_merged(now.repartitionByRange(-(-n // most), "u", "v"), most), "merged")
        names = connected_components(out.where("a is null"), "u", "v").select("node", F.col("component").alias("name"))
        left = _renamed(out.where("a is not null"), stored(names, "groups")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "a", "b")
        now, before = stored(left, "left"), n
        n = now.count()
        if n > most and n > LEFT * before:
            return _by_sums(now, most)
    return _merged(now.repartition(1), most).where("a is not null").select("a", "b")


def bridges(edges: DataFrame) -> DataFrame:
    """``a, b, weight`` of the bridges; the weight is the greater of the two directions'."""
    e = edges.where("src is not null and dst is not null and src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    e = stored(e, "undirected")
    return e.join(hinted(stored(find_bridges(e.select("a", "b")), "bridges")), ["a", "b"]).select("a", "b", "weight")


def surprises(edges: DataFrame, assignment: DataFrame, share: float = SURPRISE) -> DataFrame:
    """Edges between communities that are no heavier than the edge at position max(0, floor(n * share) - 1) of all
    weights ascending: src, dst, weight."""
    counts = edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    cut = nth_value(counts, "weight", "n", lambda n: max(0, int(n * share) - 1))
    a, b = assignment.select(F.col("node").alias("src"), F.col("community").alias("ca")), assignment.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    light = edges.where(F.col("weight") <= F.lit(cut))
    return light.join(a, "src").join(b, "dst").where("ca <> cb").select("src", "dst", "weight")


def community_report(edges: DataFrame, share: float = SURPRISE, rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """All three readings of one edge list (src, dst, weight), stored once: ``communities`` with their weights, ``members``,
    ``bridges`` and ``surprises``."""
    e = stored(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    members = stored(communities(e, rounds), "members")
    return {"members": members, "communities": community_weights(e, members), "bridges": bridges(e), "surprises": surprises(e, members, share)}
