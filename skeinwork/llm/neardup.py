"""Texts that share most of their word runs, found by covering locality-sensitive hashing.

Each text becomes a set of hashed word runs and this set a min-hash sketch in groups of
``2**dims - 1`` coordinates. In a group, coordinate ``i`` has the binary vector of the number
``i``; mask ``v`` keeps the coordinates whose vector has an odd product with ``v``. For any
``dims - 1`` coordinates there is a mask that keeps none of them, so two sketches that
differ in at most that many coordinates of a group agree under some mask: within this
radius no pair is missed. Every mask keeps ``2**(dims - 1)`` coordinates. Several groups
make it improbable that a pair at the threshold is farther apart in all of them. What
collides is compared exactly.

Equal sets form one class from the start, so copies never meet each other as pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.components import connected_components
from skeinwork.runtime import hinted, stored

_WORD = re.compile(r"[a-z0-9_]+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_STEPS = np.arange(1, 33, dtype=np.uint64) * _B
#: Buckets with more classes than this are searched by rare word runs instead of by all pairs.
CROWDED = 200


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct runs of ``run`` words as sorted 64-bit hashes; word hashes are kept between texts."""

    def __init__(self, run: int, min_words: int):
        self.run, self.min_words, self.seen = run, max(min_words, run), {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        words = _WORD.findall(text.lower()) if text else []
        if len(words) < self.min_words:
            return None
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([seen[w] for w in words], np.uint64)
        n = len(h) - self.run + 1
        acc = np.zeros(n, np.uint64)
        for j in range(self.run):
            acc = _mix(acc * _A + h[j : j + n] + _STEPS[j % len(_STEPS)])
        return np.unique(acc)


def covering_masks(dims: int) -> list[list[int]]:
    """The coordinates (from 0) that each mask keeps in a group of ``2**dims - 1``."""
    return [[i - 1 for i in range(1, 2**dims) if (i & v).bit_count() % 2] for v in range(1, 2**dims)]


def _sketcher(run: int, min_words: int, groups: int, dims: int):
    masks = covering_masks(dims)
    size = 2**dims - 1
    rng = np.random.default_rng(20240229)
    mult = (rng.integers(0, 2**63, groups * size, np.uint64) << np.uint64(1)) | np.uint64(1)
    coef = (rng.integers(0, 2**63, (groups, len(masks), size), np.uint64) << np.uint64(1)) | np.uint64(1)

    def keys_of(sets: list[np.ndarray]) -> np.ndarray:
        low = np.empty((len(sets), groups * size), np.uint64)
        for r, s in enumerate(sets):
            x = s[:, None] * mult[None, :] if len(s) < 20_000 else None
            if x is not None:
                low[r] = (x ^ (x >> np.uint64(32))).min(axis=0)
            else:  # very long texts, one coordinate at a time
                for c, m in enumerate(mult):
                    y = s * m
                    low[r, c] = (y ^ (y >> np.uint64(32))).min()
        out = np.empty((len(sets), groups * len(masks)), np.uint64)
        for g in range(groups):
            for v, keep in enumerate(masks):
                acc = np.full(len(sets), g * 1000 + v, np.uint64)
                for i in keep:
                    acc = _mix(acc * _C + low[:, g * size + i] * coef[g, v, i])
                out[:, g * len(masks) + v] = acc
        return out.view(np.int64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(run, min_words)
        for batch in batches:
            ids, places, texts = batch.column("id").to_pylist(), batch.column("place").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 500):
                got = [(k, s) for k in range(at, min(at + 500, len(ids))) if (s := shingles(texts[k].as_py())) is not None]
                if not got:
                    continue
                keys = keys_of([s for _, s in got])
                cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for _, s in got], np.uint64).view(np.int64)
                flat = pa.array(keys.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * keys.shape[1]), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k, _ in got], pa.string()), pa.array([places[k] for k, _ in got], pa.string()), pa.array(cls), pa.array([len(s) for _, s in got], pa.int32()), lists],
                    names=["id", "place", "cls", "n", "keys"],
                )

    return sketch


def _sets(run: int, min_words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(run, min_words)
        for batch in batches:
            a, b, texts = batch.column("cls"), batch.column("n"), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                part = [shingles(t.as_py()) for t in texts[at : at + 500]]
                ends = np.concatenate([[0], np.cumsum([0 if s is None else len(s) for s in part])]).astype(np.int32)
                flat = np.concatenate([s for s in part if s is not None] or [np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([a[at : at + 500], b[at : at + 500], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "n", "runs"])

    return sets


def _fits(least: float, a: Column, b: Column) -> Column:
    """Whether two set sizes allow a similarity of ``least``."""
    return (a >= F.ceil(b * F.lit(least) - 1e-9)) & (b >= F.ceil(a * F.lit(least) - 1e-9))


def _candidates(multi: DataFrame, least: float) -> DataFrame:
    """Pairs of classes of a size that allows ``least``, from buckets with few classes."""
    few = multi.where(F.col("many") <= CROWDED).select("key", "cls", "n")
    other = few.select("key", F.col("cls").alias("cls2"), F.col("n").alias("n2"))
    met = few.join(other, "key").where((F.col("cls") < F.col("cls2")) & _fits(least, F.col("n"), F.col("n2")))
    return met.select("cls", "n", "cls2", "n2").distinct()


def _by_rare_runs(crowd: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs from crowded buckets. Two sets of similarity ``least`` share one of the first
    ``n - ceil(least * n) + 1`` runs of either, whatever the order; with rare runs first,
    few others share these, so nothing is missed and no bucket is paired in full."""
    runs = crowd.join(sets, ["cls", "n"]).select("key", "cls", "n", F.explode("runs").alias("run"))
    often = runs.groupBy("key", "run").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    # runs that only one class of the bucket has come first in every order and meet nobody
    shared = runs.join(often, ["key", "run"])
    lists = shared.groupBy("key", "cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("l"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1 - (F.col("n") - F.size("l"))
    lists = lists.where(prefix > 0).select("key", "cls", "n", F.explode(F.slice("l", F.lit(1), prefix.cast("int"))).alias("r"))
    lists = lists.select("key", F.col("r.run").alias("run"), "cls", "n")
    other = lists.select("key", "run", F.col("cls").alias("cls2"), F.col("n").alias("n2"))
    met = lists.join(other, ["key", "run"]).where((F.col("cls") < F.col("cls2")) & _fits(least, F.col("n"), F.col("n2")))
    return met.select("cls", "n", "cls2", "n2").distinct()


class NearDuplicates:
    """Classes of equal texts and the links between similar ones.

    ``texts`` needs the named columns only; others are left aside, whatever their names.
    Texts that are null, or have fewer than ``min_words`` words, have no class, nor have rows
    without id. A row repeated under its id counts once. ``least`` is the similarity of the sets of distinct
    word runs from which two classes are linked (inclusive).

    ``members``: id, place, cls, n (the class is cls with n, the number of its word runs).
    ``links``: cls, n, cls2, n2, similarity, each link once.
    """

    def __init__(self, texts: DataFrame, id: str = "id", text: str = "text", place: Column | str | None = None, run: int = 5, least: float = 0.8, min_words: int = 5, groups: int = 7, dims: int = 3):
        if not 0 < least <= 1 or run < 1 or groups < 1 or dims < 2:
            raise ValueError("least must be in (0, 1], run and groups positive, dims at least 2")
        self.placed = place is not None
        where = F.lit("") if place is None else F.col(place) if isinstance(place, str) else place
        rows = texts.select(F.col(id).cast("string").alias("id"), where.cast("string").alias("place"), F.col(text).alias("text"))
        rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
        sketches = rows.mapInArrow(_sketcher(run, min_words, groups, dims), "id string, place string, cls bigint, n int, keys array<bigint>")
        sketches = stored(sketches, "sketches")
        self.members = sketches.select("id", "place", "cls", "n").distinct()
        classes = sketches.groupBy("cls", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
        postings = classes.select(F.explode("keys").alias("key"), "cls", "n")
        # counted with map-side combining, then joined: no bucket is gathered in one task
        many = postings.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
        multi = stored(postings.join(many, "key"), "buckets")
        pairs = _candidates(multi, least)
        crowd = multi.where(F.col("many") > CROWDED)
        if crowd.limit(1).count():
            wanted = crowd.select("cls", "n").distinct()
            sets = stored(self._runs_of(rows, sketches, wanted, run, min_words), "crowd")
            pairs = pairs.union(_by_rare_runs(crowd.select("key", "cls", "n"), sets, least)).distinct()
        pairs = stored(pairs, "pairs")
        wanted = pairs.select("cls", "n").union(pairs.select(F.col("cls2"), F.col("n2"))).distinct()
        sets = self._runs_of(rows, sketches, wanted, run, min_words)
        left = pairs.join(sets, ["cls", "n"])
        right = sets.select(F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("runs").alias("runs2"))
        both = left.join(right, ["cls2", "n2"]).withColumn("common", F.size(F.array_intersect("runs", "runs2")))
        share = F.col("common") / (F.col("n") + F.col("n2") - F.col("common"))
        links = both.select("cls", "n", "cls2", "n2", share.alias("similarity"))
        self.links = stored(links.where(F.col("similarity") >= least), "links")

    @staticmethod
    def _runs_of(rows: DataFrame, sketches: DataFrame, wanted: DataFrame, run: int, min_words: int) -> DataFrame:
        """The word runs of the wanted classes, read again from one text of each."""
        ids = sketches.select("id", "cls", "n").join(wanted, ["cls", "n"], "left_semi").groupBy("cls", "n").agg(F.min("id").alias("id"))
        ids = stored(ids, "wanted")
        texts = rows.select("id", "text").join(hinted(ids), "id")
        return texts.mapInArrow(_sets(run, min_words), "cls bigint, n int, runs array<bigint>").dropDuplicates(["cls", "n"])

    def groups(self) -> DataFrame:
        """One row per id: id, place, class (the least id of an equal set of word runs), group (the least id of all
        classes linked with it, directly or through others), links of its class. Classes all of whose members
        lie in one and the same place are not linked."""
        at = F.coalesce("place", F.lit("\0"))
        names = stored(self.members.groupBy("cls", "n").agg(F.min("id").alias("class"), F.min(at).alias("low"), F.max(at).alias("high")), "names")
        one, two = (names.select(*(F.col(c).alias(c + k) for c in ("cls", "n", "class", "low", "high"))) for k in "12")
        both = self.links.select(F.col("cls").alias("cls1"), F.col("n").alias("n1"), "cls2", "n2").join(one, ["cls1", "n1"]).join(two, ["cls2", "n2"])
        both = both.where((F.least("low1", "low2") != F.greatest("high1", "high2")) | (F.lit(not self.placed)))
        edges = stored(both.select(F.col("class1").alias("src"), F.col("class2").alias("dst")), "edges")
        ends = edges.select("src").union(edges.select("dst")).groupBy(F.col("src").alias("class")).agg(F.count(F.lit(1)).alias("links"))
        found = connected_components(edges).withColumnRenamed("node", "class")
        out = self.members.join(names.select("cls", "n", "class"), ["cls", "n"]).join(found, "class", "left").join(ends, "class", "left")
        return out.select("id", "place", "class", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self, other_places: bool = True) -> DataFrame:
        """All pairs of ids, id_a < id_b, of equal or linked classes; with ``other_places``,
        only those in different places. As many rows as there are such pairs: where a text
        has very many copies, read ``groups`` instead."""
        one = self.members.select("cls", "n", F.col("id").alias("id1"), F.col("place").alias("p1"))
        two = self.members.select(F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("id").alias("id2"), F.col("place").alias("p2"))
        same = one.join(two, (F.col("cls") == F.col("cls2")) & (F.col("n") == F.col("n2")) & (F.col("id1") < F.col("id2")))
        near = self.links.drop("similarity").join(one, ["cls", "n"]).join(two, ["cls2", "n2"])
        cols = ["id1", "id2", "p1", "p2"]
        out = same.select(cols).union(near.select(cols)).where(F.col("id1") != F.col("id2"))
        if other_places:
            out = out.where(~F.col("p1").eqNullSafe(F.col("p2")))
        return out.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b")).distinct()


def plain_path(path: Column) -> Column:
    """One spelling of a path: forward slashes, no doubled ones, no ``.`` steps."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(?<=/)(\./)+", "")
    return F.regexp_replace(p, r"^(\./)+", "")
