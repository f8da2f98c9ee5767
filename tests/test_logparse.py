from skeinwork.operators.logparse import Layout, parse_log

S = "line_id long, log_name string, line_no long, message string, rule string, block int, start long, carried long"
HEADS = [
    ("1773501327.588 D/telemetry(34740): a", 1773501327588, "DEBUG", "telemetry"), ("13/Feb/2026:08:24:41 +0100 session - b", 1770967481000, "", "session"), ("[2026-02-13 14:48:43,429] [ERR] review: c", 1770994123429, "ERROR", "review"),
    ("2026-03-14T15:55:45.1599Z INFO [budget] d", 1773503745159, "INFO", "budget"), ("2026-03-14T13:31:43.596-0300 notice archive | e", 1773505903596, "INFO", "archive"), ("W0314 16:10:50.677214  22390 graph.cc:491] f", 1773504650677, "WARN", "graph"),
    ('ts=2026-03-14T16:12:31.861Z msg="component=x level=y" level=trace pid=3 component=tui', 1773504751861, "DEBUG", "tui"), ("2026-03-14 16:48:24,623 - prog.region_map - FATAL - g", 1773506904623, "ERROR", "region_map"), ("Mar  4 16:54:06 host-11 prog-watcher[27469]: <critical> h", 1772643246000, "ERROR", "watcher"),
    ('{"time": 1773501640767, "level": 40, "component": "router", "msg": "i"}\r', 1773501640767, "WARN", "router"), ('{"message":"j","logger":"prog.loop","ts":"2026-03-05T05:04:28.449Z","level":"dbg"}', 1772687068449, "DEBUG", "loop"), ("\x1b[2m2026-03-14 15:47:00.756\x1b[0m \x1b[31mWarn\x1b[0m \x1b[1msandbox\x1b[0m k\r", 1773503220756, "WARN", "sandbox"),
]
OTHERS = ["    at f (a.ts:1:2)", "\t" + HEADS[3][0], "quoted: " + HEADS[2][0], "> " + HEADS[0][0], "    | " + HEADS[4][0], "2026-04-14: no component here", '{"count": 40, "of": "agent"}', "{", "", None, "   ", "Traceback (most recent call last):", "x" * 50_000, "2026-13-45T99:99:99.000Z INFO [x] no such time"]


def lines(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], S)


def test_every_layout(spark):
    rows = [(k, "l", k, m) for k, (m, *_) in enumerate(HEADS)]
    got = {r.first_line_id: (r.ts_ms, r.level, r.component) for r in parse_log(lines(spark, rows)).collect()}
    assert got == {k: (t, lv, c) for k, (_, t, lv, c) in enumerate(HEADS)}


def test_continuations_over_blocks(spark):
    rows, n, want = [(0, "l", 0, "Error: from before"), (1, "l", 1, "    at x")], 2, []
    for k, (m, *_) in enumerate(HEADS):
        rows.append((n, "l", n, m))
        first = n
        n += 1
        for o in OTHERS[: k + 3]:
            rows.append((n, "l", n, o))
            n += 1
        want.append((first, n - 1))
    rows += rows[5:9] + [(10_000 + k, "m", k, OTHERS[0]) for k in range(5)] + [(20_000, None, 1, HEADS[0][0]), (20_001, None, 2, "more"), (20_002, None, None, "no number")]
    for size in (1, 7, 20_000):
        got = parse_log(lines(spark, rows), block_lines=size).collect()
        assert sorted((r.first_line_id, r.last_line_id) for r in got if r.log_name == "l") == want
        assert not [r for r in got if r.log_name == "m"]
        (none,) = [r for r in got if r.log_name is None]
        assert (none.first_line_id, none.last_line_id, none.message) == (20_000, 20_001, "a\nmore")
    first = next(r for r in got if r.first_line_id == want[0][0])
    assert first.message.split("\n")[0] == "a" and first.message.split("\n")[1] == OTHERS[0]


def test_very_long_lines(spark):
    long = "x\\n" * 100_000
    rows = [(1, "l", 1, f'{{"time": 1773501640767, "level": 40, "component": "router", "msg": "{long}"}}'), (2, "l", 2, f'ts=2026-03-14T16:12:31.861Z level=info component=tui msg="{long}"'), (3, "l", 3, '{"' + "a" * 300_000)]
    got = {r.first_line_id: (r.last_line_id, r.component, len(r.message)) for r in parse_log(lines(spark, rows)).collect()}
    assert got == {1: (1, "router", len(long)), 2: (3, "tui", len(long) + 300_003)}


def test_headers_of_any_length(spark):
    deep, host, pid = ".".join(["part"] * 60), "-".join(["runner"] * 40) + "-7", "9" * 200
    rows = [(1, "l", 1, f"2026-03-14 16:48:24,623 - {deep}.last - INFO - a"), (2, "l", 2, f"Mar  4 16:54:06 {host} prog-watcher[{pid}]: <info> b"), (3, "l", 3, f"I0314 16:10:50.677214{' ' * 90}{pid} graph.cc:491] c")]
    got = {r.first_line_id: (r.component, r.message) for r in parse_log(lines(spark, rows)).collect()}
    assert got == {1: ("last", "a"), 2: ("watcher", "b"), 3: ("graph", "c")}


def test_no_numbers_and_own_layouts(spark):
    rows = [(k, "l", None, HEADS[0][0] if k % 10 == 0 else "more") for k in range(100)] + [(1000, "l", 0, "tail of the last")]
    for size in (7, 20_000):
        got = sorted((r.first_line_id, r.last_line_id) for r in parse_log(lines(spark, rows), block_lines=size).collect())
        assert got == [(k, k + 9 if k < 90 else 1000) for k in range(0, 100, 10)]
    mine = [Layout("mine", r"^9 a> ", r"^(\d+) (\w+)> (.*)$", "$1", "$2", "", "$3")]
    (r,) = parse_log(lines(spark, [(1, "l", 1, "1773501327588 Core> x"), (2, "l", 2, HEADS[0][0])]), layouts=mine).collect()
    assert (r.ts_ms, r.component, r.level, r.message) == (1773501327588, "core", "", "x\n" + HEADS[0][0])


def test_empty(spark):
    assert parse_log(lines(spark, [])).count() == 0
    assert parse_log(lines(spark, [(1, "l", 1, None)])).count() == 0
