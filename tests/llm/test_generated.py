from skeinwork.llm.generated import fingerprints, recurring, unwritten_files

FILES = "id long, path string, language string, line_count int, symbol_count int"
CAT = "lib string, version string, file_name string, language string, line_count int"


def test_reasons(spark, frame):
    rows = [
        (1, "a/b/src/main.ts", "typescript", 100, 8), (2, "a/b/src/x.pb.go", "go", 500, 40), (3, "a/b/static/y.js", "javascript", 2, 900), (4, "a/b/vendor/l/z.py", "python", 10, 1), (5, "a/b/src/lib.js", "javascript", 777, 60),
        (6, "a/b/src/lib.js", "javascript", 778, 60), (7, "a/b/src/table.rs", "rust", 90000, 1), (8, "a/b/src/vendors/w.ts", "typescript", 50, 4), (9, "a/b/src/generators/g.ts", "typescript", 50, 4), (10, None, None, None, None),
        (11, "a/b/src/lib.js", "unknown", 777, 60), (12, "a/b/src/head.py", "python", 20, 2), (13, "a/b/migrations/0001_auto_2024_1.py", "python", 20, 2), (14, "a/b/data.json", "json", 90000, 0), (15, ".\\c\\d\\Third_Party\\q.go", "go", 9, 1), (1, "a/b/src/main.ts", "typescript", 100, 8), (None, "v/vendor/x.ts", "typescript", 1, 1),
    ]
    texts = [(12, "# Code generated by a tool. DO NOT EDIT.\nx = 1\n"), (1, "export const x = 1; // DO NOT EDIT this by accident\n" * 3), (9, None), (99, "x")]
    got = unwritten_files(frame(rows, FILES), frame([("lib", "1", "lib.js", "javascript", 777), ("lib", "2", None, None, None)], CAT), frame(texts, "file_id long, content string")).collect()
    why = {r.file_id: r.reason for r in got}
    assert len(got) == 15
    assert why == {1: None, 2: "generated", 3: "minified", 4: "third-party", 5: "third-party", 6: None, 7: "data", 8: None, 9: None, 10: None, 11: "third-party", 12: "generated", 13: "generated", 14: None, 15: "third-party"}


def test_recurring_texts(spark, frame):
    body = "\n".join(f"function part{k}(a, b) {{ return a.x{k} + b.y{k} * {k}; }}" for k in range(60))
    own = lambda n: "\n".join(f"const own{n}_{k} = call{n}(other{k}.z{n}, {k});" for k in range(60))
    assert set(fingerprints(body, "javascript")) == set(fingerprints(body.replace("60", "61") + "\n// a comment", "javascript"))
    prints = lambda t: [int(x) for x in fingerprints(t, "javascript").view("int64")]
    rows = [(k, f"libs/r{k}", prints(body + own(k)[:200]), False) for k in range(4)] + [(9, "libs/r9", prints(own(9)), False)]
    schema = "file_id long, repository string, prints array<long>, known boolean"
    assert {r.file_id for r in recurring(spark.createDataFrame(rows, schema)).collect()} == {0, 1, 2, 3}
    # two repositories are too few, unless one of the two bodies is known to be another's
    assert recurring(spark.createDataFrame(rows[:2], schema)).count() == 0
    assert {r.file_id for r in recurring(spark.createDataFrame([rows[0], (7, "libs/r0", prints(body), True)], schema)).collect()} == {0}
    # short texts recur as a whole only
    short = [(k, f"libs/r{k}", prints("a = b(1)" if k < 4 else "a = c(1)"), False) for k in range(5)]
    assert [len(r[2]) for r in short] == [1] * 5 and {r.file_id for r in recurring(spark.createDataFrame(short, schema)).collect()} == {0, 1, 2, 3}


def test_a_copy_under_a_plain_path_is_found_by_winnowing_alone(spark, frame):
    body = "\n".join(f"export function part{k}(a, b) {{ return a.x{k} + b.y{k} * f{k}(a); }}" for k in range(60))
    own = "\n".join(f"const own{k} = call(other{k}.z, {k});" for k in range(60))
    rows = [(1, "apps/one/vendor/lib/core.js", "javascript", 60, 60), (2, "packages/two/src/helpers/tools.js", "javascript", 62, 60), (3, "packages/two/src/own.js", "javascript", 60, 0), (4, "crates/x/src/listed.js", "javascript", 61, 9), (5, "crates/y/src/other.js", "javascript", 9, 9)]
    listed = "\n".join(f"var listed{k} = [{k}, g{k}(h{k}.i, j{k})];" for k in range(80))
    texts = [(1, body), (2, "// our own, really\n" + body.replace("60", "61") + "\nexport default 1;\n"), (3, own), (4, listed), (5, listed + "\n")]
    args = (frame(rows, FILES), frame([("lib", "1", "listed.js", "javascript", 61)], CAT), frame(texts, "file_id long, content string"))
    got = {r.file_id: (r.reason, r.evidence) for r in unwritten_files(*args).collect()}
    assert got == {1: ("third-party", ["folder"]), 2: ("third-party", ["winnowing"]), 3: (None, []), 4: ("third-party", ["catalogue"]), 5: ("third-party", ["winnowing"])}
    assert {r.file_id for r in unwritten_files(*args, winnowed=False).where("reason is not null").collect()} == {1, 4}


def test_empty(spark, frame):
    assert unwritten_files(frame([], FILES), frame([], CAT), frame([], "file_id long, content string")).count() == 0


def test_header_after_a_long_licence(spark, frame):
    licence = [f"// Line {k} of the licence, which goes on for long enough." + " And on." * 60 for k in range(20)]
    block = ["/*", *(r[3:] for r in licence), "Code generated by a tool. DO NOT EDIT.", "*/", "package b"]
    texts = [
        (1, "\n".join([*licence, "", "// Code generated by protoc-gen-go. DO NOT EDIT.", "package b"])), (2, "\n".join(block)),
        (3, "\n".join([*licence, "package b", *["var a = 1"] * 5, "// Code generated by hand here. DO NOT EDIT."])), (4, "package b\n// Code generated by a tool. DO NOT EDIT.\n"), (5, "\n".join([*licence, "package b"])),
    ]
    rows = [(k, f"a/b/src/f{k}.go", "go", 30, 2) for k in range(1, 6)]
    got = unwritten_files(frame(rows, FILES), frame([], CAT), frame(texts, "file_id long, content string")).collect()
    assert {r.file_id: r.reason for r in got} == {1: "generated", 2: "generated", 3: None, 4: "generated", 5: None}
