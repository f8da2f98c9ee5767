import random
import re

import pytest
from pyspark.sql import functions as F

import skeinwork.llm.neardup as nd
from skeinwork.llm.neardup import NearDuplicates, covering_masks, plain_path

SCHEMA = "id string, file_path string, text string"


def corpus(seed=1, families=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    rows = []
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        rows.append((f"f{f:03d}-0", f"src/{f}a.py", " ".join(base)))
        for k in range(1, r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((f"f{f:03d}-{k}", f"src/{f}{'abcde'[k]}.py", " ".join(w)))
    return rows


def brute(rows, run, least, min_words):
    sets = {}
    for i, p, t in rows:
        w = re.findall("[a-z0-9_]+", (t or "").lower())
        if len(w) >= max(min_words, run):
            sets[i] = (p, {tuple(w[k : k + run]) for k in range(len(w) - run + 1)})
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= least * len(sets[a][1] | sets[b][1])}


def test_masks_cover():
    for dims in (2, 3, 4):
        masks, size = covering_masks(dims), 2**dims - 1
        assert len(masks) == size and all(len(m) == 2 ** (dims - 1) for m in masks)
        from itertools import combinations

        for differ in combinations(range(size), dims - 1):
            assert any(not set(m) & set(differ) for m in masks)


@pytest.mark.parametrize("run,least,words", [(3, 0.7, 20), (5, 0.8, 5)])
def test_against_brute_force(spark, frame, run, least, words):
    rows = corpus()
    got = NearDuplicates(frame(rows, SCHEMA), place="file_path", run=run, least=least, min_words=words).pairs()
    assert {(r.id_a, r.id_b) for r in got.collect()} == brute(rows, run, least, words)


def test_crowded_buckets_lose_nothing(spark, frame, monkeypatch):
    monkeypatch.setattr(nd, "CROWDED", 3)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = corpus(2, 20)
    for k in range(40):
        w = list(base)
        for _ in range(4):
            w[r.randrange(60)] = f"x{r.randrange(9999)}"
        rows.append((f"h{k}", f"h/{k}.py", " ".join(w)))
    got = NearDuplicates(frame(rows, SCHEMA), place="file_path", run=3, least=0.7, min_words=20).pairs()
    assert {(x.id_a, x.id_b) for x in got.collect()} == brute(rows, 3, 0.7, 20)


def test_edges_and_groups(spark, frame):
    t = " ".join(f"word{k}" for k in range(40))
    rows = [("a", "x.py", t), ("a", "x.py", t), ("b", "y.py", t.upper()), ("c", "x.py", t), ("n", "z.py", None), ("e", "z.py", ""), ("s", "z.py", "too short"), (None, "q.py", t), ("p", None, t + " more"), ("j", "k.py", "日本語 " * 50)]
    d = NearDuplicates(frame(rows, SCHEMA), place="file_path", run=3, least=0.7, min_words=20)
    assert {(r.id_a, r.id_b) for r in d.pairs().collect()} == {("a", "b"), ("b", "c"), ("a", "p"), ("b", "p"), ("c", "p")}
    g = {r.id: r for r in d.groups().collect()}
    assert set(g) == {"a", "b", "c", "p"} and len({r.group for r in g.values()}) == 1
    assert g["p"]["class"] == "p" and {g[k]["class"] for k in "abc"} == {"a"} and {r.group for r in g.values()} == {"a"} and g["a"].links == 1
    same = NearDuplicates(frame([("a", "x.py", t), ("p", "x.py", t + " more")], SCHEMA), place="file_path", run=3, least=0.7)
    assert {(r.id, r.group, r.links) for r in same.groups().collect()} == {("a", "a", 0), ("p", "p", 0)}
    empty = NearDuplicates(frame([], SCHEMA), place="file_path")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_long_text(spark, frame):
    t = " ".join(f"w{k}" for k in range(30_000))
    d = NearDuplicates(frame([("a", "x", t), ("b", "y", t + " end")], SCHEMA), place="file_path")
    assert d.pairs().count() == 1


def test_paths(spark):
    df = spark.createDataFrame([("./a//b\\c/./d.ts",)], "p string")
    assert df.select(plain_path(F.col("p"))).first()[0] == "a/b/c/d.ts"
