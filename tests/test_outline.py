from skeinwork.functions.lexing import declared_functions, language_of
from skeinwork.operators.outline import outline_of, outlines, references


def kinds(text, language):
    got: dict = {}
    for kind, name, source, line, end, exported, *_ in outline_of(text, language):
        got.setdefault(kind, set()).add((name, source) if kind == "import" else (name, line, end, exported))
    return got


def test_javascript():
    src = """import a, { b as c, type D } from './x'
import * as ns from "pkg"
import 'side'
export { q } from './y'
const { m, n: o } = require('z')
// import { no } from './no'
const s = "import { no } from './no'"
export const LIMIT = 5
export class K {
  read(x) {
    return `${x}`
  }
}
function f(a) {
  return 1
}
export { f }
"""
    got = kinds(src, "javascript")
    assert got["import"] == {("default", "./x"), ("b", "./x"), ("D", "./x"), ("*", "pkg"), ("*", "side"), ("q", "./y"), ("m", "z"), ("n", "z")}
    assert got["function"] == {("read", 10, 12, False), ("f", 14, 16, True)} and ("K", 9, 13, True) in got["type"] and ("LIMIT", 8, 8, True) in got["constant"]


def test_other_languages():
    py = kinds("from .a import (b,\n  c as d)\nimport os, sys as s\nX = 1\nclass A(B):\n    def m(self):\n        pass\n\ndef _p():\n    pass\n", "python")
    assert py["import"] == {("b", ".a"), ("c", ".a"), ("*", "os"), ("*", "sys")} and py["function"] == {("m", 6, 7, True), ("_p", 9, 10, False)} and {n for n, *_ in py["type"]} == {"A"}
    go = kinds('package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "c/d"\nfunc (s *T) Open() {\n}\nfunc low() {\n}\ntype T struct {\n}\n', "go")
    assert go["import"] == {("fmt", "fmt"), ("x", "a/b"), ("d", "c/d")} and {(n, e) for n, _, _, e in go["function"]} == {("Open", True), ("low", False)}
    rs = kinds("use a::{b, c::{d, e as f}};\nuse crate::x::y;\npub fn g() {\n}\nfn h() {\n}\n", "rust")
    assert rs["import"] == {("b", "a"), ("d", "a::c"), ("e", "a::c"), ("y", "crate::x")} and {(n, e) for n, _, _, e in rs["function"]} == {("g", True), ("h", False)}


def test_shapes_see_structure_not_names(spark):
    one = "function f(a, b) {\n  if (a > 1) {\n    return g(b, 'x')\n  }\n  return 2\n}\n"
    same = "function other(q, r) {\n  // a comment\n  if (q > 77) { return h(r, \"yy\") }\n  return 3\n}\n"
    else_ = one.replace("if (a > 1)", "while (a > 1)")
    files = spark.createDataFrame([(k, f"f{k}.js", "javascript") for k in range(1, 5)], "id long, path string, language string")
    texts = spark.createDataFrame([(1, one), (2, same), (3, else_), (4, "function f() {}\n"), (4, "function f() {}\n"), (9, one), (1, None)], "file_id long, content string")
    got = {r.file_id: (r["shape"], r.parts) for r in outlines(files, texts).where("kind = 'function'").collect()}
    assert got[1] == got[2] != got[3] and got[4] == (None, None) and 9 not in got and got[1][1] > 10
    assert outlines(files.limit(0), texts.limit(0)).count() == 0


def test_references(spark):
    files = spark.createDataFrame([(1, "a.ts", None)], "id long, path string, language string")
    texts = spark.createDataFrame([(1, "import { b } from './c'\nimport { b } from './c'\n")], "file_id long, content string")
    (r,) = references(outlines(files, texts)).collect()
    assert (r.file_id, r.name, r.import_source, r.source_file_id) == (1, "b", "./c", None)


def test_odd_texts():
    for t in ["", "import", "import {", "from x import", "use ;", "import (", "export {", "class", "`${", "{" * 3000, "require('", "const"]:
        for lang in ("javascript", "python", "go", "rust", "clike", "php"):
            list(outline_of(t, lang))
    assert language_of("Rust", None) == "rust" and [f.documentation for f in declared_functions("// One two.\nfunction f() {}\n", "javascript")] == [["One two."]]
