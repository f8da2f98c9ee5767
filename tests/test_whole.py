"""Registered queries see all of their input."""

import random

import __spark_entry__ as entry


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]


def parts(spark, folder, seed):
    """Orders over parts that all have their own brand; gives the edges with their counts."""
    r, lines, n = random.Random(seed), [], {}
    for order in range(26):
        row = [r.randrange(1, 31) for _ in range(r.randrange(1, 5))]
        lines += [(order, k, p, 1) for k, p in enumerate(row)]
        for e in zip(row, row[1:]):
            n[e] = n.get(e, 0) + 1
    put(spark, folder, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    put(spark, folder, "part", [(p, f"part {p}", f"b{p}", p * 7 % 50, float(p * 13 % 31)) for p in range(1, 31)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")
    return n


def reached(edges, start):
    out, front, depth = {start: 0}, [start], 0
    while front:
        depth += 1
        front = sorted({b for a, b in edges if a in front} - set(out))
        out |= dict.fromkeys(front, depth)
    return out


def test_queries_of_the_whole_flow(spark, tmp_path):
    n = parts(spark, tmp_path, 15)
    far = {v: reached(n, v) for e in n for v in e}
    groups: dict = {}
    for v in far:
        groups.setdefault(max(u for u in far[v] if v in far[u]), []).append(v)
    assert max(map(len, groups.values())) > 1
    sizes: dict = {}
    for g in groups.values():
        sizes[len(g)] = sizes.get(len(g), 0) + 1
    assert dict(run(spark, tmp_path, "part_cycles_all")) == sizes
    assert sorted(run(spark, tmp_path, "circular_parts_all")) == sorted((c, len(g), ",".join(map(str, sorted(g)))) for c, g in groups.items() if len(g) > 1 or (c, c) in n)
    dear = sorted(range(1, 31), key=lambda p: (-(p * 13 % 31), p))
    assert dict(run(spark, tmp_path, "blast_radius_all")) == {p: len(reached(n, p)) - 1 for p in dear[:10]}
    flows = {(e, v): d for e, _, _, v, d, _ in run(spark, tmp_path, "flows_of_parts_all")}
    assert flows == {(p, v): d for p in dear[:25] for v, d in reached(n, p).items() if d <= 4}
    both = {(min(e), max(e)) for e in n if e[0] != e[1]}
    near = lambda out, a: reached({x for e in both - {out} for x in (e, e[::-1])}, a)
    assert {(a, b) for a, b, _ in run(spark, tmp_path, "part_bridges")} == {e for e in both if e[1] not in near(e, e[0])}
    cut = sorted(n.values())[max(0, len(n) // 4 - 1)]
    assert sorted(run(spark, tmp_path, "part_surprises_all")) == sorted((a, b, float(k)) for (a, b), k in n.items() if k <= cut and a % 3 != b % 3)
    # the chart line too
    assert sum(r[0] == "mermaid" for r in run(spark, tmp_path, "graph_texts_all")) == 1 + 30 + len(n)


def test_repeated_calls_of_whole_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    kinds = {1: ["view", "click", "view", "click", "view", "click"], 2: ["error", "view", "view", "click"], 3: ["click"] * 70}
    at = datetime(2026, 1, 1)
    rows = [(1000 * k + u, u, kind, at + timedelta(hours=k), 1.0) for u, row in kinds.items() for k, kind in enumerate(row)]
    put(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, ts timestamp, value double")
    assert dict(run(spark, tmp_path, "repeated_calls")) == {"1": 3, "3": 64}
