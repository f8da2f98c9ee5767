import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import community as K
from skeinwork.operators import graph_build as B
from skeinwork.operators import graph_query as Q
from skeinwork.operators.components import connected_components
from skeinwork.operators.cooccurrence import cooccurring
from skeinwork.operators.rank import pagerank
from skeinwork.operators.traverse import change_impact, circular, execution_flows, reach, strong_components, traverse

E = "src string, dst string, weight double"


def triangles(spark, inner, cross):
    rows = [(a + str(i), a + str(j), float(inner)) for a in "ab" for i, j in ((1, 2), (2, 3), (3, 1))] + [("a1", "b1", float(cross))]
    return spark.createDataFrame(rows, E)


def test_two_triangles(spark):
    e = triangles(spark, 5, 1)
    c = K.communities(e)
    w = {r.community: (r.size, r.internal, r.external) for r in K.community_weights(e, c).collect()}
    assert w == {0: (3, 15.0, 1.0), 1: (3, 15.0, 1.0)}
    assert {r.node: r.community for r in c.collect()}["a1"] == 0


def test_bridges(spark):
    assert [tuple(r) for r in K.bridges(triangles(spark, 1, 3)).collect()] == [("a1", "b1", 3.0)]
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("b", "a", 2.0)], E)
    assert sorted(map(tuple, K.bridges(path).collect())) == [("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 1.0)]
    assert K.bridges(spark.createDataFrame([], E)).count() == 0


def links_kept_apart(links):
    """Links without which their ends do not reach each other, by leaving out one at a time."""
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for a, b in links:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = {y for y in near[x] if {x, y} != {a, b}} - seen
            seen |= new
            todo += new
        if b not in seen:
            out.add((a, b))
    return out


@pytest.mark.parametrize("graph", ["dense", "sparse", "path"])
def test_bridges_of_more_links_than_a_task_takes(spark, monkeypatch, graph):
    r = random.Random(graph)
    if graph == "dense":  # two crowds, a link between them, and what hangs on them
        e = [tuple(r.sample(range(k, k + 40), 2)) for k in (0, 100) for _ in range(300)] + [(7, 120)] + [(r.randrange(40), 200 + k) for k in range(30)] + [(200, 300), (300, 301)]
    elif graph == "sparse":
        e = [(r.randrange(200), r.randrange(200)) for _ in range(230)]
    else:
        e = [(k, k + 1) for k in range(250)]
    e = [(f"n{a}", f"n{b}") for a, b in e]
    links = {(min(x), max(x)) for x in e if x[0] != x[1]}
    monkeypatch.setattr(K, "MOST_EDGES", 40)
    monkeypatch.setattr(K, "LINKS", 40, raising=False)
    df = spark.createDataFrame([(a, b, 2.0) for a, b in e] + [(b, a, 3.0) for a, b in e[::2]], E)
    weight: dict = {}
    for k, (a, b) in enumerate(e):
        weight[min(a, b), max(a, b)] = max(weight.get((min(a, b), max(a, b)), 2.0), 3.0 if k % 2 == 0 else 2.0)
    want = links_kept_apart(links)
    assert len(want) > (249 if graph == "path" else 30)
    assert {(a, b): w for a, b, w in K.bridges(df).collect()} == {x: weight[x] for x in want}


def test_surprise(spark):
    e = triangles(spark, 10, 1)
    assert [tuple(r) for r in K.surprises(e, K.communities(e)).collect()] == [("a1", "b1", 1.0)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {x: find(x) for x in up}
    low = {}
    for x, c in want.items():
        low[c] = min(low.get(c, x), x)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "src long, dst long")).collect()}
    assert got == {x: low[c] for x, c in want.items()}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank(spark):
    nodes = spark.createDataFrame([(k,) for k in range(4)], "node long")
    e = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, None, 5.0)], "src long, dst long, weight double")
    rank, links = [0.25] * 4, [(0, 1, 2 / 3), (0, 2, 1 / 3), (1, 2, 1.0), (2, 0, 1 / 6)]
    for _ in range(20):
        rank = [0.0375 + 0.85 * sum(rank[s] * w for s, d, w in links if d == k) for k in range(4)]
    got = {r.node: r["rank"] for r in pagerank(nodes, e).collect()}
    assert all(abs(got[k] - rank[k]) < 1e-12 for k in range(4))
    assert pagerank(nodes.limit(0), e).count() == 0


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), (None, "a")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in reach(e, seed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.depth for r in change_impact(e, seed, 1).collect()} == {"c": 1}
    assert {r.node: r.component for r in strong_components(e).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d"}
    assert {tuple(r.members) for r in circular(e).collect()} == {("a", "b", "c"), ("d",)}


def test_strong_components_at_random(spark):
    r = random.Random(3)
    for n, m in ((30, 40), (60, 70), (20, 60)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        far = {v: {v} for v in range(n)}
        for _ in range(n):
            for a, b in edges:
                far[a] = far[a] | far[b]
        nodes = {v for e in edges for v in e}
        want = {v: max(u for u in far[v] if v in far[u]) for v in nodes}
        got = {x.node: x.component for x in strong_components(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
        assert got == want


def test_traverse_budget(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.7), (1, 4, 0.4)], "src long, dst long, confidence double")
    names = spark.createDataFrame([(k, "n" * k, "p") for k in range(1, 5)], "node long, name string, path string")
    assert {r.node: r.depth for r in traverse(e, 1, names).collect()} == {2: 1, 4: 1, 3: 2}
    assert {r.node for r in traverse(e, 1, names, min_confidence=0.7).collect()} == {2, 3}
    cut = traverse(e, 1, names, max_tokens=8).collect()
    assert [(r.node, r.truncated) for r in cut] == [(2, True), (4, True)]
    assert {r.node for r in traverse(e, 3, names, "in").collect()} == {2, 1}


def test_flows(spark):
    c = spark.createDataFrame([(1, "main", "main", 0.5), (2, "handleX", "handler", 0.5), (3, "z", "export", 0.9)], "node long, name string, kind string, weight double")
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 0.4), (3, 4, 0.7)], "src long, dst long, confidence double")
    got = execution_flows(c, e, 1, 2).collect()
    assert {(r.entry, r.node, r.truncated) for r in got} == {(3, 3, True), (3, 4, True), (1, 1, True), (1, 2, True)}


FILES = "id long, path string, line_count int, symbol_count int, is_barrel boolean, pagerank double"
SYMS = "id long, file_id long, name string, kind string, line int, end_line int, is_exported boolean"
REFS = "id long, file_id long, name string, import_source string, source_file_id long"


@pytest.fixture
def repo(spark):
    files = spark.createDataFrame([(1, "src/a.ts", 10, 2, False, 0.5), (2, "src/b.ts", 20, 1, False, 0.3), (3, "src/a.test.ts", 5, 1, False, 0.1), (4, "lib/index.ts", 3, 0, True, 0.1), (5, "src/c.ts", 9, 1, False, 0.9), (6, "alone/d.ts", 9, 0, False, 0.0)], FILES)
    symbols = spark.createDataFrame([(10, 1, "load", "function", 2, 4, True), (11, 1, "save", "function", 6, 9, True), (12, 2, "run", "function", 1, 9, False), (13, 5, "load", "function", 1, 3, True)], SYMS)
    refs = spark.createDataFrame([(1, 2, "load", "./a", None), (2, 2, "save", "src/a.ts", None), (3, 2, "gone", "pkg", None), (4, 3, "load", "../lib", 4)], REFS)
    return files, symbols, refs


def test_building(spark, repo):
    files, symbols, refs = repo
    imp = {(r.file_id, r.import_source): r.target_file_id for r in B.resolve_imports(refs, files).collect()}
    assert imp == {(2, "./a"): 1, (3, "../lib"): 4}
    found = {r.id: r.source_file_id for r in B.resolve_refs(refs, symbols, files).collect()}
    assert found == {1: 1, 2: 1, 3: None, 4: 4}
    e = B.weighted_edges(B.resolve_refs(refs, symbols, files))
    assert {(r.source_file_id, r.target_file_id): round(r.weight, 6) for r in e.collect()} == {(2, 1): 1.386294, (3, 4): 0.693147}
    tests = B.test_edges(files)
    assert [(r.source_file_id, r.target_file_id) for r in tests.collect()] == [(3, 1)]
    lines = spark.createDataFrame([(2, 3, "x = load(1)"), (2, 5, "load(load2)"), (2, 6, "y.save()"), (2, 12, "save")], "file_id long, line int, text string")
    calls = B.call_graph(symbols, B.resolve_refs(refs, symbols, files), lines)
    assert {(r.caller_symbol_id, r.callee_name, r.callee_symbol_id, r.line, r.tier) for r in calls.collect()} == {(12, "load", 10, 3, "EXTRACTED"), (12, "save", 11, 6, "EXTRACTED")}
    pairs = spark.createDataFrame([(2, 1, 3), (5, 2, 4)], "file_id_a long, file_id_b long, count long")
    saved = B.rescue_edges(files, B.replace_edges(e, tests), pairs)
    assert {(r.source_file_id, r.target_file_id, r.weight) for r in saved.collect()} == {(1, 2, 0.5), (1, 3, 0.3), (1, 5, 0.3)}
    changed, same = B.indexed(files.withColumn("mtime_ms", F.col("id")), spark.createDataFrame([("src/a.ts", 1), ("src/b.ts", 9)], "path string, mtime_ms long"))
    assert {r.id for r in same.collect()} == {1} and 2 in {r.id for r in changed.collect()}
    left = B.apply_changes(symbols, symbols.where("file_id = 1").withColumn("name", F.lit("new")), spark.createDataFrame([(5,)], "file_id long"))
    assert sorted((r.id, r.name) for r in left.collect()) == [(10, "new"), (11, "new"), (12, "run")]


def test_whole_build(spark, repo):
    files, symbols, refs = repo
    lines = spark.createDataFrame([(2, 3, "load(1)")], "file_id long, line int, text string")
    commits = spark.createDataFrame([(k, f) for k in range(3) for f in (1, 2)], "commit long, file_id long")
    g = B.CodeGraph(files, symbols, refs, lines, commits)
    assert g.edges.count() == 6 and g.calls.count() == 1 and g.ranks.count() == 6 and g.cochanges.first()["count"] == 3


def test_reads(spark, repo):
    files, symbols, refs = repo
    calls = spark.createDataFrame([(12, "load", 10, 1, 3, 1.0, "EXTRACTED"), (12, "load", None, None, 5, 0.7, "INFERRED"), (13, "save", 11, 1, 2, 0.4, "AMBIGUOUS")], "caller_symbol_id long, callee_name string, callee_symbol_id long, callee_file_id long, line int, confidence double, tier string")
    target = symbols.where("id = 10").select("id", "file_id", "name")
    assert Q.callers(calls, symbols, target).count() == 2 and Q.callers(calls, symbols, target, 0.9).count() == 1
    assert {r.line for r in Q.callees(calls, symbols).collect()} == {2, 5, 6}
    gaps = Q.knowledge_gaps(symbols, files, calls, 0.5).collect()
    assert [(r.id, r.callers) for r in gaps] == [(13, 0), (10, 1), (11, 0)]
    assert {r.id for r in Q.unused_exports(symbols, refs.withColumn("source_file_id", F.lit(1))).collect()} == set()
    edges = B.weighted_edges(B.resolve_refs(refs, symbols, files))
    assert {r.id for r in Q.orphan_files(files, edges).collect()} == {2, 5, 6}
    assert [r.path for r in Q.neighbours(edges, files, 1, True).collect()] == ["src/b.ts"]
    assert Q.symbol_references(refs, calls, symbols, files, "load").count() == 4
    assert Q.changed_with(spark.createDataFrame([(1, 2, 5), (3, 1, 7)], "file_id_a long, file_id_b long, count long"), files, 1).first().path == "src/a.test.ts"
    assert Q.file_symbols(symbols, 1).count() == 2
    shapes = spark.createDataFrame([("h", 1, "a", 1, 9), ("h", 2, "b", 2, 9), ("g", 1, "c", 3, 7), (None, 1, "d", 4, 0)], "shape_hash string, file_id long, name string, line int, node_count int")
    assert sorted((r.shape_hash, r.copies, r.file_id, r.node_count) for r in Q.duplicate_shapes(shapes).collect()) == [("h", 2, 1, 9), ("h", 2, 2, 9)]
    q = spark.createDataFrame([("flow", 1, "t1", 0.9, "p"), ("flow", 2, "t1", 0.5, "p"), ("gap", 1, "t4", 0.9, "o")], "kind string, nth int, text string, score double, path string")
    assert [(r.text, r.score) for r in Q.suggested_questions(q).collect()] == [("t4", 0.9), ("t1", 0.9)]
    edge = lambda *r: spark.createDataFrame(list(r), "nth int, src string, dst string, weight double")
    c = Q.question_candidates(edge((1, "x/a.ts", "y/b.ts", 0.0), (2, "c", "d", 1.0), (3, "e", "f", 1.0)), edge((1, "q\\z.ts", "w", 1.0)), spark.createDataFrame([(1, "load", "a/m.ts", 2.0)], "nth int, name string, path string, pagerank double"), spark.createDataFrame([(1, "main", "main", "m.ts", 0.5, 2, "x", "x.ts"), (2, "run", "main", "r.ts", 0.5, 3, "y", "y.ts")], "nth int, entry_name string, entry_kind string, entry_path string, weight double, steps int, last_name string, last_path string"))
    got = {r.text: r.score for r in c.collect()}
    assert got["Why does `a.ts` call `b.ts`? It looks like an out-of-module dependency."] == 1.0 and len(got) == 5
    assert "`z.ts` is a bridge between modules — what blast radius would breaking it cause?" in got and got["`load` in `m.ts` is a high-PageRank symbol with no tests — should we add coverage?"] == 1.0
    assert got["Walk me through the `run` main flow (ends in `y`)."] == 0.5
    assert not Q.health(spark.createDataFrame([(60, 600, 0, 0)], "files long, symbols long, edges long, calls long")).first().healthy


def test_nth_value(spark):
    df = spark.createDataFrame([(float(k), 1 + k % 3) for k in range(50_000)], "v double, n long")
    flat = [float(k) for k in range(50_000) for _ in range(1 + k % 3)]
    for p in (0, 10, 49_999, 77_777, len(flat) - 1):
        assert Q.nth_value(df, "v", "n", lambda n: p) == flat[p]
    assert Q.nth_value(df.limit(0), "v", "n", lambda n: 0) is None


def test_cooccurrence(spark):
    rows = [(1, k) for k in range(25)] + [(2, 1), (2, 2), (2, 2), (3, 2), (3, 1), (4, 9), (None, 1), (5, None)]
    got = cooccurring(spark.createDataFrame(rows, "g long, i long"), "g", "i").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2)]


def test_call_cycles_against_brute_force(spark):
    import random

    r = random.Random(3)
    for seed in range(3):
        n = 14
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(18)}
        symbols = spark.createDataFrame([(k, k % 3, f"s{k}") for k in range(n)], "id long, file_id long, name string")
        calls = spark.createDataFrame([(a, f"s{b}", b % 3) for a, b in pairs] + [(None, "s1", 1), (1, "s2", None), (2, "s4", 0)], "caller_symbol_id long, callee_name string, callee_file_id long")
        got: dict = {}
        for x in Q.call_cycles(calls, symbols, None).collect():
            got.setdefault(x.cycle, []).append((x.nth, x.id, x.length))
        near: dict = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)

        def dist(a):
            seen, front, d = {}, {a}, 0
            while front:
                d += 1
                front = {y for x in front for y in near.get(x, ())} - set(seen)
                seen |= {y: d for y in front}
            return seen

        far = {a: dist(a) for a in range(n)}
        groups = {frozenset(b for b in range(n) if b == a or (b in far[a] and a in far[b])) for a in range(n)}
        rings = {min(g): g for g in groups if len(g) > 1 or (min(g), min(g)) in pairs}
        # of a group the least member; its shortest ring, or its call of itself
        assert set(got) == set(rings)
        for root, steps in got.items():
            steps = [i for _, i, _ in sorted(steps)]
            assert steps[0] == steps[-1] == root and len(steps) == far[root][root] + 1 if (root, root) not in pairs else True
            assert all((a, b) in pairs for a, b in zip(steps, steps[1:]))
    assert Q.call_cycles(calls.limit(0), symbols).count() == 0


def test_symbol_search_and_radius(spark):
    files = spark.createDataFrame([(1, "src/queue/a.ts"), (2, "lib/b.ts")], "id long, path string")
    symbols = spark.createDataFrame([(1, 1, "loadUser", "function"), (2, 2, "load_user", "method"), (3, 2, "other", "function")], "id long, file_id long, name string, kind string")
    ids = lambda q: {r.id for r in Q.search_symbols(symbols, files, q).collect()}
    assert ids("load user") == {2} and ids("queue") == {1} and ids("load*") == {1, 2} and ids("function ts") == {1, 3} and ids('"load') == set() and ids(" *") == set()
    calls = spark.createDataFrame([(2, "loadUser"), (3, "load_user"), (1, "other"), (3, "none")], "caller_symbol_id long, callee_name string")
    assert {(r.id, r.depth) for r in Q.symbol_radius(calls, symbols, "loadUser").collect()} == {(2, 1), (3, 2)} and Q.symbol_radius(calls, symbols, "missing").count() == 0
    assert {(r.id, r.depth) for r in Q.symbol_radius(calls, symbols, "loadUser", 1).collect()} == {(2, 1)}


def test_communities_in_waves_are_those_in_order(spark, monkeypatch):
    import random

    from skeinwork.operators import community as K

    r = random.Random(8)
    links = {(min(a, b), max(a, b)): float(r.randrange(1, 4)) for a, b in ((r.randrange(24), r.randrange(24)) for _ in range(45)) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()] + [(100, 101, 1.0)], "src long, dst long, weight double")
    want = K.propagate([(a, b, w) for (a, b), w in links.items()] + [(100, 101, 1.0)])
    monkeypatch.setattr(K, "MOST_EDGES", 5)
    rows, large = K._components(K.undirected(df))
    assert large.count() >= 1
    got = {x.node: x.label for x in K._in_waves(K.undirected(df), K.ROUNDS).collect()}
    assert got == want
    groups: dict = {}
    for x in K.communities(df).collect():
        groups.setdefault(x.community, set()).add(x.node)
    same: dict = {}
    for n, lab in want.items():
        same.setdefault(lab, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))
