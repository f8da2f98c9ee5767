import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import paths as P
from skeinwork.functions import text as T
from skeinwork.operators import clones as C
from skeinwork.operators import export as X
from skeinwork.operators import kv as V
from skeinwork.operators import retrieval as R
from skeinwork.operators import sessions as S
from skeinwork.operators import telemetry as L
from skeinwork.operators import versioning as H


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    r = df.select(column.alias("x")).first().x
    return r.asDict() if hasattr(r, "asDict") else r


def test_truncation(spark):
    t = "\n".join(["l"] * 3 + ["x" * 20] + ["m"] * 6)
    assert one(spark, T.truncate_shell(F.col("t"), 2, 2, 10), t=t) == "l\nl\n...[6 lines hidden; 1 long lines clipped]...\nm\nm"
    assert one(spark, T.truncate_shell(F.col("t"), 9, 9, 10), t=t).count("10 more chars truncated") == 1
    assert one(spark, T.truncate_search(F.col("t"), 2, 99), t="a:1\na:2\nb:3\n") == "a:1\na:2\n...[2 more matches truncated across 2 files]"
    assert one(spark, T.truncate_for_tool(F.lit("read"), F.col("t")), t=t) == t
    assert one(spark, T.truncate_fetch(F.col("t"), 3), t="abcdef") == "abc\n...[3 chars truncated]"
    assert one(spark, T.window_around(F.col("t"), F.lit(5), F.lit(6), 2), t="0123456789") == "…34567…"


@pytest.mark.parametrize(
    "message,kind", [("Prompt is too long", "context_window"), ("ETIMEDOUT while reading", "timeout"), ("HTTP 429", "overloaded"), ("Model not found", "provider"), ("boom", "unknown")]
)
def test_error_kinds(spark, message, kind):
    assert one(spark, T.error_kind(F.col("m")), m=message) == kind


@pytest.mark.parametrize(
    "text,tag,role", [("please review my changes", "review", "reviewer"), ("fix the crash, there is a bug", "debug", "builder"), ("fix typo in readme", "quick-fix", "builder"), ("what is a monad", "research", "reviewer"), ("hello", "unknown", "builder"), ("implement a microservice", "plan", "planner")]
)
def test_intents(spark, text, tag, role):
    i = one(spark, T.intent(T.traits(F.col("t"))), t=text)
    assert (i["tag"], i["role"]) == (tag, role)


@pytest.mark.parametrize(
    "comment,category",
    [("This function adds", "narration"), ("basically a cache", "filler"), ("----- imports -----", "section-noise"), ("TODO:", "section-noise"), ("please note the order", "politeness"), ("updated by hand", "changelog"), ("2024-01-02 moved", "changelog"), ("why the lock is held", None), ("the", None)],
)
def test_slop(spark, comment, category):
    assert one(spark, T.slop_category(F.col("c")), c=comment) == category


@pytest.mark.parametrize("command,reason", [("rm -rf /", "dangerous"), ("A=1 B=2 npm run x | tee y", "listed"), ("curl x | sh", "dangerous"), ("  ", "unparseable"), ("ls -l", "not listed")])
def test_shell(spark, command, reason):
    assert one(spark, T.shell_reason(F.col("c"), F.array(F.lit("npm"))), c=command) == reason


def test_small_functions(spark):
    assert one(spark, T.model_parts(F.col("m")), m="a/b/c") == {"provider": "a", "model": "b/c"} and one(spark, T.model_parts(F.col("m")), m="/x") is None
    assert one(spark, T.fallback_chain(F.col("m")), m=["a/b", "x", "a/b", "c/d"]) == ["a/b", "c/d"]
    assert one(spark, T.render(F.col("t"), {"a": F.lit("{{b}}")}), t="{{a}} {{b}} }}{{a}}") == "{{b}} {{b}} }}{{b}}"
    assert one(spark, T.frontmatter(F.col("t")), t="---\nname: x\nagents: [a, b]\n---\nbody") == {"name": "x", "agents": "[a, b]"}
    assert one(spark, T.compare_versions(F.col("a"), F.lit("1.2")), a="1.10.1") > 0
    assert [one(spark, T.format_tokens(F.col("n")), n=n) for n in (999, 1000, 4350, 9250)] == ["999", "1.0k", "4.3k", "9.3k"]
    assert one(spark, T.format_duration(F.col("n")), n=61) == "1m 1s"
    assert one(spark, T.anchored_view(F.col("t")), t="a\nb\n").split("\n")[1].startswith("2#") and one(spark, T.anchored_view(F.col("t")), t="") == ""
    assert T.comments_in("x // none\n/* two\n * three */\n # four\n//five\n/** six */ y\n/*\nopen") == [("/* two", "two"), ("/* two", "/* two"), ("* three */", "three"), ("# four", "four"), ("//five", "five"), ("/** six */ y", "six */ y"), ("/** six */ y", "/** six"), ("/*", "/*"), ("open", "open")]
    assert one(spark, P.language_of_path(F.col("p")), p="a/Dockerfile") == "dockerfile" and one(spark, P.language_of_path(F.col("p")), p="a/b.TSX") == "typescript"
    assert one(spark, P.package_name(F.col("p")), p="@a/b/c") == "@a/b" and one(spark, P.package_name(F.col("p")), p="x/y") == "x"
    assert P.glob_pattern("src/**/*.ts") == r"^src/.*/[^/]*\.ts$"
    assert one(spark, P.tested_path(F.col("p")), p="a.test.b.test.ts") == "a.b.test.ts"
    assert one(spark, P.signature_of(F.array(F.lit("function f("), F.lit("  a,"), F.lit("): x {")), F.lit(1), F.lit("function")), z=1) == "function f( a, ): x"
    public = lambda n, line, lang: one(spark, P.is_public(F.col("n"), F.lit(line), F.lit(lang)), n=n)
    assert public("Open", "", "go") and not public("open", "", "go") and public("f", "  pub fn f", "rust") and not public("f", "fn f", "zig") and not public("_f", "def _f", "python")
    assert not public("f", "private int f()", "java") and public("f", "protected int f()", "java") and not public("f", "protected function f", "php") and not public("f", "  defp f", "elixir") and public("f", "x", "typescript")
    assert one(spark, T.front_list(F.col("t")), t="[a, \"b c\" ,]") == ["a", "b c"] and one(spark, T.front_list(F.col("t")), t="'x'") == ["x"] and one(spark, T.front_list(F.col("t")), t="") == []
    assert one(spark, T.frontmatter(F.col("t")), t="no front") == {} and one(spark, T.front_body(F.col("t")), t="---\na: 1\na: 2\n---\nbody") == "body" and one(spark, T.frontmatter(F.col("t")), t="---\na: 1\n#b: 3\na: 2\n---\nx") == {"a": "2"}
    assert [one(spark, T.number_text(F.col("n")), n=n) for n in (3.0, 0.5, -2.0)] == ["3", "0.5", "-2"]


def test_kv(spark):
    log = spark.createDataFrame([("p", "a%1", "x", 100, 1), ("p", "a%1", "y", 200, 5), ("p", "ab1", "z", 50, 2), ("q", "a%1", "q", 10, 3), ("p", "d", "1", 99, 1), ("p", "d", None, 99, 4)], "project_id string, key string, data string, expires_at long, updated_at long")
    rows = V.latest(log)
    assert {(r.key, r.data, r.created_at, r.updated_at) for r in V.visible(rows, 20).collect()} == {("a%1", "y", 1, 5), ("ab1", "z", 2, 2)}
    assert V.visible(rows, 200).count() == 0 and V.purge(rows, 200).count() == 1
    assert [r.key for r in V.list_keys(rows, "p", 0, "a%").collect()] == ["a%1"] and V.get(rows, "p", "ab1", 50).count() == 0
    f = spark.createDataFrame([("review-finding:src/a.ts:12", '{"severity":"bug"}'), ("review-finding:src/b.ts:3", "{}"), ("x", "{}")], "key string, data string")
    assert [(r.file, r.line) for r in V.findings(f, "src/a.ts").collect()] == [("src/a.ts", 12)] and V.findings(f, pattern="bug").count() == 1
    assert one(spark, V.plan_edit(F.col("t"), "a", "b"), t="cac") == "cbc" and one(spark, V.plan_edit(F.col("t"), "a", "b"), t="aa") is None and one(spark, V.plan_edit(F.col("t"), "a", "b", 2), t="aXa") == "aXb"
    t = spark.createDataFrame([(1, "m", "running", 1), (2, "m", "pending", 2), (3, "m", "pending", 3), (4, "n", "pending", 4), (5, "n", "pending", 5)], "id long, model string, status string, created_at long")
    assert [r.id for r in V.admitted(t, 3, 2).collect()] == [2, 4]
    u = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "file string, taken_at long, data string")
    assert V.undo(u).first().data == "b" and V.undo(u, 2).first().data == "a"


def test_telemetry(spark):
    e = spark.createDataFrame([(1, "loop_outcome", "s", 10, '{"status":"completed"}'), (2, "loop_outcome", "s", 20, '{"status":"failed"}'), (3, "fallback", "t", 30, "{broken"), (4, None, "t", 40, None)], "id long, type string, session_id string, timestamp long, data string")
    assert {r.type: r.events for r in L.event_stats(e).collect()} == {"loop_outcome": 2, "fallback": 1, None: 4}
    assert [r.id for r in L.query_events(e, session_id="s", since=0).collect()] == [2, 1] and [r.id for r in L.query_events(e, 1, since=15, until=30).collect()] == [3]
    o = L.outcome_report(e).first()
    assert (o.successes, o.failures, o.rate, o.fallbacks) == (1, 1, 0.5, 1)


@pytest.mark.parametrize("ring,times", [(list("aaa"), 3), (list("abc") * 3, 3), (list("abcd"), None), (list("aa"), None), (list("xabab"), None), (list("xababab"), 3), (list("a" * 64), 64)])
def test_repetitions(spark, ring, times):
    from skeinwork.streaming.live import tail_repeats

    assert one(spark, S.repetitions(F.col("r")), r=ring) == times == tail_repeats(ring)


def test_quality_of_a_fresh_session(spark):
    z = F.lit(0)
    assert one(spark, S.quality(z, z, z, z, z, z, z, z, z, z), x=1) == {"score": 91, "grade": "S"}
    assert one(spark, S.quality(z, z, z, z, z, F.lit(3), z, z, z, F.lit(3)), x=1)["score"] < 91
    c = spark.createDataFrame([("s", 0, 50, False), ("s", 1000, 40, False), ("s", 400_000, 40, True), ("s", 800_000, 40, False), ("t", 5, 90, False), ("t", 6, None, None)], "session_id string, at long, score int, compacted boolean")
    assert {(r.session_id, r["at"]): r.nudge for r in S.nudges(c).collect()} == {("s", 0): True, ("s", 1000): False, ("s", 400_000): False, ("s", 800_000): True, ("t", 5): False, ("t", 6): False}
    many = spark.createDataFrame([("s", k * 300_000, 1, False) for k in range(20)], "session_id string, at long, score int, compacted boolean")
    assert S.nudges(many).where("nudge").count() == 10


def test_sessions(spark):
    m = spark.createDataFrame(
        [("s", 1, "system", 0, None, None, "x"), ("s", 2, "user", 0, None, None, "u1"), ("s", 2, "user", 1, None, None, "u2"), ("s", 3, "user", 0, None, None, "u3"), ("s", 4, "assistant", 0, "file", "/w/a.ts", "r"), ("s", 4, "assistant", 1, "shell", "ls", "r"), ("s", 4, "assistant", 2, "file", "/w/a.ts", "r"), ("s", 5, "assistant", 0, "todo", None, "t"), ("s", 6, "user", 0, None, None, "u4")],
        "session_id string, seq long, role string, pos int, kind string, resource string, text string",
    )
    assert [(r.seq, r.pos, r.resource) for r in S.summary(m, "/w").orderBy("seq", "pos").collect()] == [(2, 0, None), (4, 1, "ls"), (6, 0, None)]
    b = spark.createDataFrame([("s", 1, 5.0, 90.0), ("s", 2, 35.0, 45.0), ("s", 3, 5.0, 90.0)], "session_id string, seq long, messages double, quality double")
    assert S.best_checkpoint(b).first().seq == 1
    t = spark.createDataFrame([("s", 1, [("pending", "a"), ("done", "b")]), ("s", 2, [("pending", "a")]), ("s", 3, [("done", "a")]), ("s", 4, [("in_progress", "a")])], "session_id string, seq long, todos array<struct<status:string,content:string>>")
    assert [r.seq for r in S.pending_changes(t).orderBy("seq").collect()] == [1, 4]
    g = spark.createDataFrame([(2, "b", "1", "y"), (1, "a", "2", "x"), (3, "a", "9", "z")], "pos int, path string, line string, text string")
    assert [(r.path, r.text) for r in S.grouped_matches(g).orderBy("first").collect()] == [("a", "2: x\n9: z"), ("b", "1: y")]


def test_versions(spark):
    f = lambda rows: H.folder_hashes(spark.createDataFrame(rows, "path string, hash string"))
    a = {r.path: r.hash for r in f([("x/a", "1"), ("x/y/b", "2"), ("z", "3")]).collect()}
    b = {r.path: r.hash for r in f([("z", "3"), ("x/y/b", "9"), ("x/a", "1")]).collect()}
    assert set(a) == {"", "x", "x/y"} and a["x/y"] != b["x/y"] and a[""] != b[""]
    assert {r.path for r in f([]).collect()} == {""}
    d = H.diff_hashes(spark.createDataFrame([("a", "1"), ("b", None), ("c", "1")], "path string, hash string"), spark.createDataFrame([("a", "2"), ("b", None), ("d", "1")], "path string, hash string"))
    assert {r.path: r.change for r in d.collect()} == {"a": "changed", "b": "unchanged", "c": "removed", "d": "added"}
    s = H.skippable(spark.createDataFrame([("a/b/c",), ("d",)], "path string"), spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in s.collect()] == ["a/b/c"]
    assert H.line_diff("a\nb\nc", "a\nx\nc", "p") == "--- a/p\n+++ b/p\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c" and H.line_diff("a", "a") == ""
    old = [f"l{k}" for k in range(12)]
    new = [*old[:1], "new", *old[1:5], *old[6:], "end"]
    assert H.line_diff("\n".join(old), "\n".join(new), "f").split("\n")[2:] == ["@@ -1,4 +1,5 @@", " l0", "+new", " l1", " l2", " l3", "@@ -5,5 +6,4 @@", " l4", "-l5", " l6", " l7", " l8", "@@ -10,3 +10,4 @@", " l9", " l10", " l11", "+end"]
    assert H.line_diff("a\nb", "a").endswith("\n a\n-b") and H.line_diff("a", "a\nb\nc").endswith("\n a\n+b\n+c")


def test_clones(spark):
    src = 'const total = compute(1.5e3, "x", other) + 0xFF;'
    toks = one(spark, C.tokens(F.col("t")), t=src)
    assert toks == ["const", "$I", "=", "$I", "(", "$N", ",", "$S", ",", "$I", ")", "+", "$N", ";"]
    rows = spark.createDataFrame([(1, 1, toks), (2, 2, list(toks)), (3, 2, toks[:4]), (4, 3, toks[::-1])], "id long, file_id long, tokens array<string>")
    sig = C.signatures(rows)
    got = {r.id: r.minhash for r in sig.collect()}
    assert got[3] is None and got[1] == got[2] and len(got[1]) == 128
    import hashlib

    runs = ["\0".join(toks[k : k + 3]) for k in range(len(toks) - 2)]
    assert got[1][7] == min(int(hashlib.sha256(f"7\x01{r}".encode()).hexdigest()[:8], 16) for r in runs)
    assert [(r.id_a, r.id_b, r.similarity) for r in C.near_duplicates(sig).collect()] == [(1, 2, 1.0)]
    members, links = C.near_classes(C.signatures(spark.createDataFrame([(k, k % 3, toks) for k in range(1, 40)] + [(50, 9, [*toks, ";"]), (51, 9, ["a", "b"])], "id long, file_id long, tokens array<string>")), 0.5)
    assert {(r.id, r["class"]) for r in members.collect()} == {(k, 1) for k in range(1, 40)} | {(50, 50)} and [(r.class_a, r.class_b) for r in links.collect()] == [(1, 50)]
    assert C.fragments(rows).count() == 0
    for t in ('"' + "x" * 200_000 + '"', "'" + "\\n" * 100_000, "`" + "y\n" * 100_000 + "`"):
        assert one(spark, F.size(C.tokens(F.col("t"))), t=t) > 0
    assert one(spark, T.base_command(F.col("t")), t="A=1 " * 50_000 + "ls") == "ls"
    long = spark.createDataFrame([(1, [str(k % 5) for k in range(20)])], "id long, tokens array<string>")
    assert C.fragments(long).count() == 9


def test_retrieval(spark):
    t = spark.createDataFrame([(1, "\n".join(f"l{k}" for k in range(12))), (2, ""), (3, None)], "id long, text string")
    assert sorted((r.start_line, r.end_line) for r in R.line_chunks(t, "id", "text", 5, 1).collect()) == [(1, 5), (5, 9), (9, 12), (12, 12)]
    assert R.split_lines("aa\nbb\ncc", 5, 5) == [(5, 5, "aa"), (6, 6, "bb"), (7, 7, "cc")] and R.split_lines("aaaa", 1, 2) == [(1, 1, "aaaa")]
    c = "file_path string, start_line int, end_line int, content string, symbol_name string, symbol_kind string"
    rolled = R.roll_up(spark.createDataFrame([("f", 1, 2, "a", "s", "k"), ("f", 3, 4, "b", "s", "k"), ("f", 6, 7, "c", None, None), ("f", 8, 9, "d" * 1596, "x", "k"), ("g", 1, 2, "e", None, None)], c))
    assert sorted((r.file_path, r.start_line, r.end_line, r.symbol_name) for r in rolled.collect()) == [("f", 1, 4, "s"), ("f", 6, 7, None), ("f", 8, 9, "x"), ("g", 1, 2, None)]
    d = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0, 0.0]), (2, "beta gamma gamma", [0.0, 1.0, 0.0]), (3, "delta", [0.9, 0.1, 0.0]), (4, None, None)], "id long, text string, vec array<double>")
    assert [r.id for r in R.search(d, "gamma", [1.0, 0.0, 0.0], "semantic", 2).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in R.search(d, '"gamma"', [1.0, 0.0, 0.0], "keyword").collect()] == [2]
    assert {r.id for r in R.search(d, "gamma", [1.0, 0.0, 0.0], "hybrid", 2).collect()} == {1, 2}
    assert one(spark, R.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), x=1) == 0 and one(spark, R.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), x=1) == 0
    f = R.fuse({"a": spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int"), "b": spark.createDataFrame([(2, 1)], "id long, rank int")})
    assert {r.id: round(r.score, 6) for r in f.collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6)}
    v = {r.id: r.vec for r in R.pseudo_vectors(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string"), dims=8).collect()}
    assert v[2] is None and abs(np.linalg.norm(v[1]) - 1) < 1e-6
    s = R.symbol_chunks(spark.createDataFrame([(1, "a", 3, 5), (1, "b", 8, 9)], "file_id long, name string, line int, end_line int"), spark.createDataFrame([(1, 12), (2, 4)], "file_id long, n int"))
    assert sorted((r.file_id, r.start_line, r.end_line, r.symbol_name) for r in s.collect()) == [(1, 1, 2, None), (1, 3, 5, "a"), (1, 6, 7, None), (1, 8, 9, "b"), (1, 10, 12, None), (2, 1, 4, None)]


def _text(df):
    return "\n".join(r.line for r in df.orderBy("part", "nth").collect())


def test_export(spark):
    n = spark.createDataFrame([("src/a.ts", "A", "ts", 120, True), ("src/b.ts", None, "ts", None, None), ("src/weird name.ts", "Weird & Co", None, 7, False)], "id string, label string, lang string, size int, hot boolean")
    e = spark.createDataFrame([("src/a.ts", "src/b.ts", 3.0, "x'"), ("src/a.ts", "src/weird name.ts", 1.0, None)], "src string, dst string, weight double, kind string")
    g = _text(X.graphml(n, e))
    assert g.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns=') and g.endswith("  </graph>\n</graphml>") and 'edgedefault="directed"' in g
    assert '  <key id="n_lang" for="node" attr.name="lang" attr.type="string" />\n  <key id="n_size" for="node" attr.name="size" attr.type="double" />\n  <key id="n_hot" for="node" attr.name="hot" attr.type="boolean" />\n  <key id="n_label" for="node" attr.name="label" attr.type="string" />' in g
    assert '    <node id="src/a.ts">\n      <data key="n_label">A</data>\n      <data key="n_lang">ts</data>\n      <data key="n_size">120</data>\n      <data key="n_hot">true</data>\n    </node>' in g and "Weird &amp; Co" in g and "Weird & Co" not in g
    assert '    <edge id="e0" source="src/a.ts" target="src/b.ts">\n      <data key="e_weight">3</data>\n      <data key="e_kind">x&apos;</data>\n    </edge>' in g and '    <node id="src/b.ts">\n      <data key="n_label">src/b.ts</data>\n      <data key="n_lang">ts</data>\n    </node>' in g
    m = _text(X.mermaid(n, e))
    assert m == 'flowchart LR\n  src_a_ts["A"]\n  src_b_ts["src/b.ts"]\n  src_weird_name_ts["Weird & Co"]\n  src_a_ts -->|3| src_b_ts\n  src_a_ts --> src_weird_name_ts'
    assert _text(X.mermaid(n, e, "TD")).startswith("flowchart TD\n")
    c = _text(X.cypher(n, e)).split("\n")
    assert c[0] == "MERGE (:File { path: 'src/a.ts', label: 'A', lang: 'ts', size: 120, hot: true });" and c[1] == "MERGE (:File { path: 'src/b.ts', lang: 'ts' });"
    assert c[3] == "MATCH (a:File { path: 'src/a.ts' }), (b:File { path: 'src/b.ts' }) MERGE (a)-[:IMPORTS { weight: 3, kind: 'x\\'' }]->(b);"
    assert "MERGE (:Module {" in _text(X.cypher(n, e, "Module", "CALLS")) and "-[:CALLS {" in _text(X.cypher(n, e, "Module", "CALLS"))
    none = (n.limit(0), e.limit(0))
    assert "<graph " in _text(X.graphml(*none)) and _text(X.mermaid(*none)) == "flowchart LR" and _text(X.cypher(*none)) == ""


def test_names_in_charts(spark):
    ids = ["a.b", "a/b", "a_b_1", "a-b", "a b", "1x", "n_1x", "", "a_b_1_1", "z", "a_b_2", "a~b"]
    used, want = set(), {}
    for i in ids:  # one by one
        base = "".join(c if c.isalnum() or c == "_" else "_" for c in i)
        base = f"n_{base}" if not base or base[0].isdigit() else base
        name, k = base, 1
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        want[i] = name
    got = X.chart_ids(spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, _nth long"))
    assert {r.id: r.cid for r in got.collect()} == want


def test_json_edge():
    assert json.loads("{}") == {}
