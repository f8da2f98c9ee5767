"""The most similar vectors of every vector, by collision counting.

Vectors are scaled to length one, equal ones become one. They are dealt to cells, the
cell being the nearest of some pivots drawn from the vectors themselves; where vectors
are dense, pivots are too. A query looks into the cells of its nearest pivots, of several
independent sets of pivots. Within a cell, every projection on a random line gives a sorted array; a window centred on
the query's own projection is laid over each, and a vector is counted wherever it lies
in the window. From ``threshold`` counts on, its similarity is computed. Windows start
narrow and widen by virtual rehashing (the same arrays, a larger radius) for the queries
that have not yet found k vectors as near as the radius.

Cells come first because a window as wide as the radius of the tenth neighbour covers
most of an array in 64 dimensions: counting over the whole collection would cost more
than comparing with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.runtime import hinted, stored

#: Vectors of a cell that one task compares at once; larger cells are met in blocks.
BLOCK = 4096


def _unit(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors at length one, rounded to 32-bit floats, as bytes."""
    for batch in batches:
        ids, vec = batch.column("id"), batch.column("vec")
        size = vec.value_lengths().to_numpy(zero_copy_only=False) if len(vec) else np.empty(0)
        fit = np.flatnonzero(size == dims)
        if not len(fit):
            continue
        ids = ids.take(pa.array(fit))
        flat = vec.take(pa.array(fit)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        u = (x[good] / norm[good, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array([r.tobytes() for r in u], pa.binary())], names=["id", "u"])


def _array(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _levels(min_cosine: float | None) -> list[float]:
    """Radii of the windows as distances on the sphere, each about 1.5 times the one before."""
    last = np.sqrt(2 - 2 * (min_cosine if min_cosine is not None else 0.0))
    out = [last]
    while out[-1] > 0.25:
        out.append(out[-1] / 1.5)
    return out[::-1]


class _Pivots:
    """Pivots of one set of cells. Beyond ``flat`` of them they are found through groups of about the square root of
    their number: a vector then meets the pivots of its nearest groups only, so that dealing stays near-linear."""

    def __init__(self, p: np.ndarray, flat: int, groups: int = 16):
        self.p, self.groups, self.heads = p, groups, None
        if len(p) > flat:
            heads = p[:: max(1, round(len(p) ** 0.5))]
            own = np.concatenate([(p[at : at + 8192] @ heads.T).argmax(axis=1) for at in range(0, len(p), 8192)])
            by = np.argsort(own, kind="stable")
            self.heads, self.members = heads, np.split(by, np.searchsorted(own[by], np.arange(1, len(heads))))

    def nearest(self, x: np.ndarray, look: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot) of the ``look`` nearest pivots of each row, and the nearest of each."""
        if self.heads is None or look * 16 > len(self.p):
            s = x @ self.p.T
            near = np.argpartition(-s, look - 1, axis=1)[:, :look] if look < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
            return np.repeat(np.arange(len(x)), near.shape[1]), near.ravel(), s.argmax(axis=1)
        s = x @ self.heads.T
        g = min(self.groups, s.shape[1])
        near = np.argpartition(-s, g - 1, axis=1)[:, :g] if g < s.shape[1] else np.tile(np.arange(g), (len(s), 1))
        row, group = np.repeat(np.arange(len(x)), g), near.ravel()
        by = np.argsort(group, kind="stable")
        got = []
        for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            members = self.members[group[part[0]]]
            got.append((np.repeat(row[part], len(members)), np.tile(members, len(part)), (x[row[part]] @ self.p[members].T).ravel()))
        r, c, v = (np.concatenate(a) for a in zip(*got))
        by = np.lexsort((c, -v, r))
        r, c = r[by], c[by]
        first = np.searchsorted(r, np.arange(len(x)))
        nth = np.arange(len(r)) - first[r]
        return r[nth < look], c[nth < look], c[first]


class _Lines:
    def __init__(self, dims: int, lines: int, threshold: int, reach: float, seed: int):
        self.a = np.random.default_rng(seed).standard_normal((dims, lines)).astype(np.float32)
        self.threshold, self.reach = threshold, reach

    def search(self, q: np.ndarray, o: np.ndarray, k: int, floor: float, levels: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, object, cosine) of up to k objects of each query with a cosine of ``floor`` or more."""
        po = o @ self.a
        order = np.argsort(po, axis=0, kind="stable")
        arrays = np.take_along_axis(po, order, axis=0)
        rank = np.empty(po.shape, np.int16)
        np.put_along_axis(rank, order, np.arange(len(o), dtype=np.int16)[:, None], axis=0)
        pq = q @ self.a
        open_, best = np.arange(len(q)), [(np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))]
        for i, radius in enumerate(levels):
            half, found = self.reach * radius, []
            for at in range(0, len(open_), 512):
                rows = open_[at : at + 512]
                counts = np.zeros((len(rows), len(o)), np.uint8)
                for line in range(self.a.shape[1]):
                    left = np.searchsorted(arrays[:, line], pq[rows, line] - half).astype(np.int16)
                    right = np.searchsorted(arrays[:, line], pq[rows, line] + half, "right").astype(np.int16)
                    inside = (rank[:, line][None, :] - left[:, None]).view(np.uint16) < (right - left).view(np.uint16)[:, None]
                    counts += inside.view(np.uint8)
                a, b = np.nonzero(counts >= self.threshold)
                cos = np.einsum("ij,ij->i", q[rows[a]], o[b]) if len(a) < 0.02 * counts.size else (q[rows] @ o.T)[a, b]
                near = cos >= floor
                found.append((rows[a[near]], b[near], cos[near]))
            r, b, c = (np.concatenate(x) for x in zip(*found)) if found else best[0]
            within = c >= 1 - radius * radius / 2
            done = np.bincount(r[within], minlength=len(q)) >= k if i + 1 < len(levels) else np.ones(len(q), bool)
            best.append(tuple(x[done[r]] for x in (r, b, c)))
            open_ = open_[~done[open_]]
            if not len(open_):
                break
        r, b, c = (np.concatenate(x) for x in zip(*best))
        by = np.lexsort((b, -c, r))
        r, b, c = r[by], b[by], c[by]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        return r[keep], b[keep], c[keep]


def most_similar(
    vectors: DataFrame,
    k: int = 10,
    min_cosine: float | None = None,
    queries: DataFrame | None = None,
    id: str = "id",
    vector: str = "embedding",
    dims: int = 64,
    tables: int = 3,
    probes: int | float = 4,
    cell: int = 512,
    max_pivots: int = 262144,
    flat_pivots: int = 16384,
    lines: int = 16,
    threshold: int = 12,
    reach: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """``id, other, cosine, rank``: the k most similar other ids of each id by cosine.

    A vector is usable if it has ``dims`` finite numbers that are not all zero; others,
    and null vectors or ids, neither ask nor answer. Repeated rows count once. Ids with equal
    vectors find each other exactly, ties go to the lesser id. Other columns are left
    aside. With ``min_cosine``, only others that similar are asked for, and windows stop there.
    ``queries`` (a frame with the id column) restricts who asks, never who answers.

    ``probes`` is the number of cells a query looks into or, as a float up to 1.0, the share of all
    cells, in each of ``tables`` sets of them. The pivots of a set are at most ``max_pivots``
    vectors, a hash-ordered sample, so that cells stay small up to ``cell`` times as many vectors; all vectors are
    indexed. More than ``flat_pivots`` pivots are found by way of groups of them. Cells compare in half precision, then the
    best ``k`` and a few more are compared exactly. Defaults suit ``min_cosine`` 0.9.
    """
    rows = vectors.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    unit = rows.mapInArrow(lambda it: _unit(it, dims), "id string, u binary")
    # vectors go by their hash; they are shuffled once, to become one row each
    found = stored(unit.withColumn("h", F.xxhash64("u")), "unit")
    kept = found.select("id", "h").distinct()
    same = kept.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(found.groupBy("h").agg(F.first("u").alias("u")).join(same, "h"), "reps")
    total = reps.count()
    empty = "id string, other string, cosine double, rank int"
    if total == 0:
        return vectors.sparkSession.createDataFrame([], empty)
    wanted = int(min(max_pivots, max(1, -(-total // cell))))
    look = min(wanted, max(1, round(probes * wanted) if isinstance(probes, float) and probes <= 1 else int(probes)))
    pivots = []
    for t in range(tables):
        some = reps.orderBy(F.xxhash64("h", F.lit(t)), "u").limit(wanted).select("u").collect()
        pivots.append(_Pivots(_array(pa.array([bytes(r.u) for r in some], pa.binary()), dims), flat_pivots))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    asks = reps.select("h", "u", F.lit(True).alias("asks"))
    if queries is not None:
        who = queries.select(F.col(id).cast("string").alias("id")).distinct()
        few = kept.join(who, "id", "left_semi").select("h").distinct().withColumn("asks", F.lit(True))
        asks = reps.select("h", "u").join(few, "h", "left").select("h", "u", F.coalesce("asks", F.lit(False)).alias("asks"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per cell that a vector lives in (role 0), asks in (1), or both (2)."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _array(part.column("u"), dims)
                ask = part.column("asks").to_numpy(zero_copy_only=False)
                half = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                for t, p in enumerate(shared.value):
                    r, c, home = p.nearest(x, look)
                    other = (c != home[r]) & ask[r]
                    r, c = r[other], c[other]
                    rows, cells = np.concatenate([np.arange(len(x)), r]), np.concatenate([home, c])
                    role = np.concatenate([np.where(ask, 2, 0), np.ones(len(r))]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array((cells + t * wanted).astype(np.int32)), pa.array(role), part.column("h").take(pa.array(rows)), half.take(pa.array(rows))], names=["cell", "role", "h", "v"])

    dealt = asks.mapInArrow(deal, "cell int, role byte, h bigint, v binary")
    # a crowded cell is met in blocks of objects and of queries; one row a cell, so pivots bound this table
    sizes = dealt.groupBy("cell").agg(F.sum((F.col("role") != 1).cast("int")).alias("objects"), F.sum((F.col("role") != 0).cast("int")).alias("seekers")).where("objects > 0 and seekers > 0")
    sizes = stored(sizes.select("cell", F.ceil(F.col("objects") / BLOCK).cast("int").alias("a"), F.ceil(F.col("seekers") / (8 * BLOCK)).cast("int").alias("b")), "cells")
    if sizes.where("a > 1 or b > 1").limit(1).count():
        placed = dealt.join(F.broadcast(sizes), "cell")
        mine = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        objects = placed.where("role <> 1").select("cell", mine("a").alias("x"), every("b").alias("y"), F.lit(0).cast("byte").alias("role"), "h", "v")
        seekers = placed.where("role <> 0").select("cell", every("a").alias("x"), mine("b").alias("y"), F.lit(1).cast("byte").alias("role"), "h", "v")
        dealt = objects.union(seekers)
    else:
        dealt = dealt.select("cell", F.lit(0).alias("x"), F.lit(0).alias("y"), "role", "h", "v")
    slack = 2e-3  # what half precision can cost a cosine
    floor, levels, count, more = -2.0 if min_cosine is None else min_cosine - slack, _levels(min_cosine), _Lines(dims, lines, threshold, reach, seed), k + 6

    def meet(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        h = group.column("h").to_numpy()
        o, q = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        r, b, c = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]) if not len(o) or not len(q) else ([], [], [])
        if not r:
            x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)
            for at in range(0, len(o), 30_000):
                part = o[at : at + 30_000]
                a_, b_, c_ = count.search(x[q], x[part], more, floor, levels)
                r.append(q[a_]), b.append(part[b_]), c.append(c_.astype(np.float64))
        r, b, c = np.concatenate(r), np.concatenate(b), np.concatenate(c)
        differ = h[r] != h[b]
        return pa.table({"h": pa.array(h[r][differ], pa.int64()), "other": pa.array(h[b][differ], pa.int64()), "about": pa.array(c[differ], pa.float64())})

    near = dealt.groupBy("cell", "x", "y").applyInArrow(meet, "h bigint, other bigint, about double")
    near = near.groupBy("h", "other").agg(F.max("about").alias("about"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("about"), "other"))
    near = stored(near.withColumn("nth", nth).where(F.col("nth") < more).select("h", "other"), "near")
    # the pairs, two numbers each, go to the vectors of either end; what they meet is joined again
    pairs = hinted(near)
    left = pairs.join(reps.select("h", "rep", "u"), "h")
    right = pairs.join(reps.select(F.col("h").alias("other"), F.col("rep").alias("orep"), F.col("u").alias("v")), "other")
    ends = left.join(right.select("h", "other", "orep", "v"), ["h", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = np.einsum("ij,ij->i", _array(batch.column("u"), dims).astype(np.float64), _array(batch.column("v"), dims).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("orep"), pa.array(exact)], names=["rep", "orep", "cosine"])

    near = ends.select("rep", "orep", "u", "v").mapInArrow(compare, "rep string, orep string, cosine double")
    if min_cosine is not None:
        near = near.where(F.col("cosine") >= min_cosine)
    # from representatives to ids; of equal vectors the k + 1 least ids answer, picked before the shuffle
    ids = kept.join(reps.select("h", "rep", "copies"), "h").select("rep", "id", "copies")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    answers = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    asking = ids if queries is None else ids.join(who, "id", "left_semi")
    equal = asking.where("copies > 1").select("rep", "id").join(answers.select("rep", F.col("id").alias("other")), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    unlike = asking.select("rep", "id").join(near, "rep").join(answers.select(F.col("rep").alias("orep"), F.col("id").alias("other")), "orep").select("id", "other", "cosine")
    best = equal.union(unlike).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("l"))
    best = best.select("id", F.posexplode(F.slice("l", 1, k)).alias("at", "o"))
    return best.select("id", F.col("o.other").alias("other"), (-F.col("o.far")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, k: int = 10, min_cosine: float = 0.9, **index: object) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b, one among the k most similar of the other, at least ``min_cosine``."""
    near = most_similar(vectors, k, min_cosine, **index)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def brute_force(x: np.ndarray, ids: np.ndarray, ask: np.ndarray, k: int) -> pd.DataFrame:
    """The exact answer for the rows ``ask`` of a small matrix, for tests and recall."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[ask] @ u.T
    s[np.arange(len(ask)), ask] = -2
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"id": np.repeat(ids[ask], top.shape[1]), "other": ids[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()})
