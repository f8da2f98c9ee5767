import numpy as np

from skeinwork.llm.similar import brute_force, most_similar, similar_pairs


def data(n=600, dims=64, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)).astype(np.float32)
    for k in range(0, 120, 4):  # planted neighbours from 0.90 up
        c = r.uniform(0.91, 0.999)
        a, b = x[k] / np.linalg.norm(x[k]), r.standard_normal(dims)
        b -= a * (a @ b)
        x[k + 1] = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
    x[200] = x[201] * 3
    return x


def rows(x):
    return [(f"v{k:04d}", [float(v) for v in r]) for k, r in enumerate(x)]


def test_pairs_above_a_floor_are_all_found(spark, frame):
    x = data()
    df = frame(rows(x), "id string, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"v{a:04d}", f"v{b:04d}") for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= 0.9}
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, cell=64).collect()}
    assert got == want and len(want) >= 31


def recall(frame, x, **index):
    got = {(r.id, r.other) for r in most_similar(frame(rows(x), "id string, embedding array<float>"), cell=64, tables=1, **index).collect()}
    b = brute_force(x.astype(float), np.array([f"v{k:04d}" for k in range(len(x))]), np.arange(len(x)), 10)
    want = set(zip(b.id, b.other))
    assert len(got) == len(want)
    return len(got & want) / len(want)


def test_recall_without_floor(spark, frame):
    # directions without any structure are the worst case: there cells tell nothing, and all have to be met
    assert recall(frame, data(), probes=1.0) >= 0.999
    # vectors near a space of fewer dimensions, as embeddings are
    r = np.random.default_rng(4)
    x = (r.standard_normal((900, 16)) @ r.standard_normal((16, 64)) + 0.7 * r.standard_normal((900, 64))).astype(np.float32)
    assert recall(frame, x, probes=0.65) >= 0.9


def test_pivots_by_way_of_groups(spark, frame):
    x = data(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"v{a:04d}", f"v{b:04d}") for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= 0.9}
    got = {(r.id_a, r.id_b) for r in similar_pairs(frame(rows(x), "id string, embedding array<float>"), cell=8, flat_pivots=64).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_edges(spark, frame):
    e = [1.0] + [0.0] * 63
    f = [0.0, 1.0] + [0.0] * 62
    bad = [("n", None), ("z", [0.0] * 64), ("s", [1.0] * 48), (None, e), ("q", [float("nan")] * 64)]
    df = frame([(f"a{k:02d}", e) for k in range(30)] + [("a00", e), ("b", f)] + bad, "id string, embedding array<float>")
    got = most_similar(df, k=10, min_cosine=0.9).collect()
    assert {r.id for r in got} == {f"a{k:02d}" for k in range(30)}
    assert all(sum(r.id == i for r in got) == 10 for i in {r.id for r in got})
    assert all(r.cosine > 0.9999 and r.id != r.other for r in got)
    few = most_similar(df, k=3, queries=spark.createDataFrame([("b",)], "id string"), tables=1, probes=1.0).collect()
    assert [r.id for r in few] == ["b"] * 3
    assert most_similar(df.limit(0)).count() == 0
    assert most_similar(frame(bad, "id string, embedding array<float>")).count() == 0


def test_crowded_cell_is_met_in_blocks(spark, frame, monkeypatch):
    import skeinwork.llm.similar as s

    monkeypatch.setattr(s, "BLOCK", 40)
    x = data(300)
    got = {(r.id_a, r.id_b) for r in similar_pairs(frame(rows(x), "id string, embedding array<float>"), cell=10_000).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    assert got == {(f"v{a:04d}", f"v{b:04d}") for a in range(300) for b in range(a + 1, 300) if c[a, b] >= 0.9}
