from skeinwork.operators.features import last_full_week, session_features

S = "id long, type string, session_id string, project_id string, timestamp long, data string, salt int, ts long, n long, payload long"
T0 = 1_770_000_000_000


def row(id, type, session, project, at, data):
    return (id, type, session, project, at, data, 0, 0, 0, 0)


ROWS = [
    row(1, "undo", "a", "p", T0, '{"tokens":10}'), row(1, "undo", "a", "p", T0, '{"tokens":10}'), row(2, " UNDO ", "a", None, T0 + 5000, '{"detail":{"tokens":5}}'), row(3, "loop-outcome", "a", "p", (T0 + 9000) // 1000, '{"tokens":"7","x":1'),
    row(4, None, "a", "p", T0, '{"tokens":54'), row(5, "  ", "a", "p", None, None), row(6, "undo", None, "p", T0, '{"tokens":99}'), row(7, "undo", "b", None, T0 + 400 * 86_400_000, "{}"), row(None, "undo", "b", "q", T0 + 1, ""), row(8, "Loop Outcome", "b", "q", T0, "x" * 100_000),
]


def test_counts_recency_totals(spark):
    df = spark.createDataFrame(ROWS, S)
    got = {r.session_id: r for r in session_features(df, as_of=T0 + 10_000).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.project_id, a.undo__n, a.undo__since_ms, a.undo__tokens) == ("p", 2, 5000, 15)
    assert (a.loop_outcome__n, a.loop_outcome__since_ms, a.loop_outcome__tokens) == (1, 1000, 7)
    assert (a.unknown__n, a.unknown__since_ms, a.unknown__tokens) == (2, 10_000, 0)
    # a clock running ahead counts and is no last event
    assert (b.project_id, b.undo__n, b.undo__since_ms, b.unknown__n, b.unknown__since_ms) == ("q", 2, 9999, 0, None)
    long = {(r.session_id, r.type): (r.n, r.tokens) for r in session_features(df, as_of=T0 + 10_000, layout="long").collect()}
    assert long[("a", "undo")] == (2, 15) and ("b", "unknown") not in long


def test_salts_change_nothing(spark):
    rows = [row(k, ["x", "y"][k % 2], "hot" if k % 3 else f"s{k}", "p", T0 + k, f'{{"tokens":{k}}}') for k in range(600)]
    df = spark.createDataFrame(rows + rows[:50], S)
    one, many = (sorted(map(tuple, session_features(df, salts=n).collect()), key=repr) for n in (1, 64))
    assert one == many
    hot = next(r for r in one if r[0] == "hot")
    assert hot[2] + hot[5] == 400 and hot[4] + hot[7] == sum(k for k in range(600) if k % 3)


def test_latest_week_leaves_out_strays(spark):
    rows = [row(k, "x", "s", "p", T0 + k * 60_000, None) for k in range(5000)] + [row(9999, "x", "s", "p", T0 + 90 * 86_400_000, None)]
    assert last_full_week(spark.createDataFrame(rows, S)) == T0 + 4999 * 60_000


def test_long_numbers_and_null_ids(spark):
    rows = [row(None, "x", "s", "p", T0 + k, f'{{"tokens":{10**17}}}') for k in range(20)] + [row(None, "x", "s", "p", T0, f'{{"tokens":{10**17}}}'), row(1, "x", "s", "p", T0, f'{{"tokens":{10**30}}}')]
    (r,) = session_features(spark.createDataFrame(rows, S)).collect()
    assert (r.x__n, r.x__tokens) == (21, 20 * 10**17)


def test_empty(spark):
    assert session_features(spark.createDataFrame([], S)).count() == 0
