from pyspark.sql import functions as F

from skeinwork.operators import context as C


def test_skills(spark):
    s = "name string, scope string, agents array<string>, globs array<string>, body string"
    df = spark.createDataFrame([("a", "global", [], None, "1"), ("a", "project", ["x"], ["src/**/*.ts"], "2"), ("b", "user", ["y"], [], "3"), ("c", "user", None, ["*.md"], "4")], s)
    assert {(r.name, r.body) for r in C.select_skills(df, "x").collect()} == {("a", "2"), ("c", "4")}
    assert {r.name for r in C.select_skills(df, "x", ["src/p/q.ts"]).collect()} == {"a"}
    assert {r.name for r in C.select_skills(df, "z", ["r.md"]).collect()} == {"c"}


def test_packing(spark):
    long = "x" * 300
    assert C.pack([("a", "one"), ("b", "one"), ("c", " "), ("d", long), ("e", "two")], 250) == [("a", "one"), ("d", "x" * 247 + C.MORE)]
    assert C.pack([("README.md", "r" * 5000)])[0][1].startswith("r" * 4000 + "\n")
    rows = [("s", k, f"f{k}", c) for k, c in enumerate(["one", "one", None, long, ""])] + [("t", 0, "g", "z")]
    got = C.pack_contexts(spark.createDataFrame(rows, "session_id string, pos int, source string, content string"), 250).collect()
    assert sorted((r.session_id, r.nth, r.source) for r in got) == [("s", 0, "f0"), ("s", 1, "f3"), ("t", 0, "g")]


def test_patches(spark):
    import hashlib

    h = hashlib.sha256(b"b").hexdigest()[:8]
    p = spark.createDataFrame([("f", 2, h.upper()), ("f", 1, h), ("g", 1, h)], "file string, line int, hash string")
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "file string, line int, text string")
    assert {(r.file, r.line): r.holds for r in C.anchors_hold(p, lines).collect()} == {("f", 2): True, ("f", 1): False, ("g", 1): False}
    df = spark.createDataFrame([("a\nb\nc\n", 2, 3, "x\ny"), ("a\nb", 1, 1, "")], "t string, i int, j int, n string")
    assert [r.o for r in df.select(C.replace_lines(F.col("t"), F.col("i"), F.col("j"), F.col("n")).alias("o")).collect()] == ["a\nx\ny\n", "b"]


def test_doc_lines():
    assert C.doc_line(["/**", " * Reads the file.", " * @param x", " */", "function f() {}"], 4) == "Reads the file."
    assert C.doc_line(["def f():", '    """Says it', "    twice.", '    """'], 0) == "Says it twice."
    assert C.doc_line(["// one two", "// three", "x"], 2) == "one two three"
    assert C.doc_line(["x", "y"], 1) is None and C.doc_line(["# abc", "y"], 1) is None
    assert len(C.doc_line(["# " + "w" * 100, "y"], 1)) == 80


def test_names_and_matches(spark):
    t = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert C.unique_name(t("b"), "a") == "a" and C.unique_name(t("a", "a-1", "a-3"), "a") == "a-2" and C.unique_name(t("x" * 25), "x" * 30) == "x" * 25 + "-1"
    df = spark.createDataFrame([(1, "Alpha", None), (2, "alphabet", "x"), (3, "beta", "ALPHA")], "id int, a string, b string")
    assert [(r.id, r.match) for r in C.best_match(df, "alpha", ["a", "b"], "id").collect()] == [(1, True)]
    assert [(r.id, r.match) for r in C.best_match(df, "bet", ["a"], "id").orderBy("id").collect()] == [(2, False), (3, False)]
    assert [(r.id, r.match) for r in C.best_match(df, "beta", ["a"], "id").collect()] == [(3, True)]


def test_reads(spark):
    r = [("s", 1, "f", 1, "a\nb"), ("s", 2, "f", 1, "a\nb"), ("s", 3, "f", 2, "a\nc"), ("s", 4, "f", 3, "q" * 4000), ("t", 1, "f", 1, "a")]
    got = C.read_answers(spark.createDataFrame(r, "session_id string, seq int, path string, mtime long, content string")).orderBy("session_id", "seq").collect()
    assert [x.answer for x in got] == ["full", "unchanged", "delta", "full", "full"] and "+c" in got[2].delta


def test_small(spark):
    got = {r.t: r.h for r in spark.createDataFrame([("",), ("abc",), ("hello world, a longer text",), (None,), ("\U0001f600x",)], "t string").select("t", C.rolling_hash(F.col("t")).alias("h")).collect()}

    def plain(t):
        h = 0
        for k in range(0, len(u := t.encode("utf-16-be")), 2):
            h = (h * 31 + u[k] * 256 + u[k + 1]) & 0xFFFFFFFF
        h -= (h & 0x80000000) << 1
        n, s = abs(h), ""
        while n:
            n, d = divmod(n, 36)
            s = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + s
        return ("-" if h < 0 else "") + (s or "0")

    assert got.pop(None) is None and all(plain(t) == h for t, h in got.items()) and got["abc"] == "22ci"
    df = spark.createDataFrame([("user", [("text", "hi"), ("tool", "ls"), ("reasoning", "x"), ("text", " ")])], "role string, parts array<struct<kind:string,text:string>>")
    assert df.select(C.message_text(F.col("role"), F.col("parts")).alias("t")).first().t == "user: hi\n[ls]"
    kv = spark.createDataFrame([("loop:a", '{"loopName":"n","sessionId":"s","active":true,"iteration":2,"startedAt":"2026-01-01T00:00:00Z"}', 10), ("loop:b", "broken", 10), ("x", "{}", 10), ("loop:c", '{"loopName":"m","sessionId":"s"}', 1), ("loop:d", '{"loopName":"o"}', 10)], "key string, data string, expires_at long")
    got = {r.key: (r.name, r.active, r.iteration) for r in C.loop_states(kv, 5).collect()}
    assert got == {"loop:a": ("n", True, 2)}
    kv = spark.createDataFrame([("budget:a", '{"agent":"x","sessionId":"s","updatedAt":1000000,"state":{"turns":2,"tokensUsed":5}}', 2_000_000, "p"), ("budget:b", '{"agent":"x","sessionId":"s","updatedAt":1}', 2_000_000, "p"), ("budget:c", '{"agent":"x","updatedAt":1000000}', 2_000_000, "p")], "key string, data string, expires_at long, project_id string")
    assert [(r.key, r.turns, r.tokens) for r in C.fresh_budgets(kv, 1_000_000, "p").collect()] == [("budget:a", 2, 5)] and C.fresh_budgets(kv, 1_000_000, "q").count() == 0 and C.fresh_budgets(kv, 1_000_000, "p", "t").count() == 0


def test_symbol_docs_slop_and_names(spark):
    t = spark.createDataFrame([(1, "// Reads the file at once.\nfunction f() {}\n// This function just returns the value\n// note that it is so\nlet x\n"), (2, None)], "file_id long, content string")
    s = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (2, 1, 5), (3, 1, 99), (4, 2, 1), (None, 1, 1)], "id long, file_id long, line int")
    assert {r.id: r.doc for r in C.symbol_docs(s, t).collect()} == {1: "Reads the file at once.", 2: "This function just returns the value note that it is so", 3: None}
    got = {(r.category, r.line, r.warned) for r in C.comment_slop(t, "file_id", "content").collect()}
    assert got == {("narration", "// This function just returns the value", True), ("filler", "// note that it is so", True)} or {g[2] for g in got} == {True}
    names = C.unique_names(spark.createDataFrame([("a",), ("b",), ("x" * 30,), (None,)], "base string"), spark.createDataFrame([("a",), ("a-1",), ("a-3",), ("b-1",), ("x" * 25,)], "name string"))
    assert {r.base: r.name for r in names.collect()} == {"a": "a-2", "b": "b", "x" * 30: "x" * 25 + "-1"}


def test_skills_of_many_globs(spark):
    rows = spark.range(12_000).selectExpr("concat('s', id) AS name", "'user' AS scope", "cast(array() AS array<string>) AS agents", "array(concat('src/', id, '/*.ts')) AS globs", "'b' AS body")
    last = C.select_skills(rows, "x", [f"src/{k}/q.ts" for k in (0, 5_000, 10_500, 11_999)])
    assert {r.name for r in last.collect()} == {"s0", "s5000", "s10500", "s11999"} and last.columns == ["name", "scope", "agents", "globs", "body"]
    assert C.select_skills(rows, "x", ["src/%d/q.ts" % k for k in range(0, 12_000, 1_000)]).count() == 12
