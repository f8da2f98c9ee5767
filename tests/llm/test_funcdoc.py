import pytest

from skeinwork.functions.lexing import language_of
from skeinwork.llm.funcdoc import code_description_pairs, described, functions_in, words_in


def one(text, language, name):
    return next(f for f in functions_in(text, language) if f.name == name)


def test_comment_right_above():
    src = '// Adds two numbers and returns their sum.\nfunction add(a, b) {\n  return "}" + a + b; // }\n}\n\n// Not of this one at all here.\n\nfunction sub() {}\n'
    f = one(src, "javascript", "add")
    assert f.documentation == "Adds two numbers and returns their sum." and (f.line, f.end_line) == (2, 4) and f.code.endswith("}")
    assert one(src, "javascript", "sub").documentation == ""


def test_methods_arrows_and_strings():
    src = 'class A {\n\t/** Reads the whole file into memory at once. */\n\t@dec({a: 1})\n\tasync read(x: Map<string, number>): Promise<void> {\n\t\tif (x) { y(`function fake() {`); }\n\t}\n}\n/* Waits for the last of all writers. */\nexport const wait = async (\n\ta, b,\n): Promise<string[]> => {\n};\nconst s = "function ghost() {}";\n'
    assert one(src, "javascript", "read").documentation == "Reads the whole file into memory at once."
    w = one(src, "javascript", "wait")
    assert w.documentation == "Waits for the last of all writers." and w.end_line == 12
    assert {f.name for f in functions_in(src, "javascript")} == {"read", "wait"}


def test_python_docstrings_and_decorators():
    src = "# Turns the list around in place, twice.\n@retry(\n    times=3,\n)\nasync def turn(\n    a: dict[str, int],\n) -> dict[str, list[int]]:\n    x = '''\ndef fake(): pass\n'''\n    return x\n\ndef other(a):\r\n    \"\"\"Says what it does in a docstring.\n\n    :returns: a thing\n    \"\"\"\n    return 1\nz = 2\n"
    t = one(src, "python", "turn")
    assert t.documentation == "Turns the list around in place, twice." and t.code.endswith("return x")
    o = one(src, "python", "other")
    assert o.documentation == "Says what it does in a docstring." and o.code.endswith("return 1")


def test_go_and_rust():
    go = "// Opens the store and waits for it.\nfunc (s *Set) Open(a string) ([]string, error) {\n\tx := `}`\n\treturn nil\n}\n"
    assert one(go, "go", "Open").end_line == 5
    rust = "/// Clears every slot that is still held.\n#[inline]\npub async fn clear<'a>(x: &'a str) -> Result<()> {\n\tlet c = '{';\n\tlet r = r#\"}\"#;\n}\n"
    f = one(rust, "rust", "clear")
    assert f.documentation.startswith("Clears every slot") and f.end_line == 6


@pytest.mark.parametrize(
    "line,kept",
    [
        ("TODO: describe this once the work is finished", False), ("TODO-list helper. Merges two lists in order.", True), ("@param x the value to use for it", False), (":returns: a list of all of them", False),
        ("eslint-disable-next-line no-unused-vars, max-params, complexity", False), ("if (a.b > 79) call(x);", False), ("x = [a.b for c in d if c.e]", False), ("with f(x) as y: y.z(9)", False), ("=====================", False),
        ("The load user table function.", False), ("Load user table.", False), ("Callers must hold the lock; it is rewritten in place.", True), ("noqa: E501, C901, D103, ANN201", False), ("Der Bericht prüft den Fehler zuerst.", True),
    ],
)
def test_lines_that_describe(line, kept):
    assert bool(described([line], "loadUserTable")) is kept


def test_operator(spark, frame):
    files = frame([(1, "a/x.ts", "typescript"), (1, "a/x.ts", "typescript"), (2, "a/y.css", "css"), (3, "a/z.py", "unknown"), (None, "q.ts", None)], "id long, path string, language string")
    texts = frame([(1, "// Says hello to everyone in the room.\r\nfunction hello() {\r\n}\r\n// Too few.\r\nfunction low() {}\r\n"), (2, "a{}"), (3, None), (9, "function x(){}")], "file_id long, content string")
    s = "id long, file_id long, name string, kind string, signature string, line int, end_line int"
    symbols = frame([(10, 1, "hello", "Function", None, 7, 9), (10, 1, "hello", "Function", None, 7, 9), (11, 1, "low", "function", None, 5, 5), (12, 1, "hello", "class", None, 1, 1), (13, 2, "a", "function", None, 1, 1), (14, None, None, None, None, None, None), (None, 1, "hello", "method", None, 2, 2)], s)
    got = code_description_pairs(symbols, files, texts).collect()
    assert [(r.symbol_id, r.kind, r.line, r.end_line) for r in got] == [(10, "function", 2, 3)]
    assert code_description_pairs(symbols.limit(0), files.limit(0), texts.limit(0)).count() == 0


def test_odd_texts():
    for t in ["", "function", "def f(", "/* open", '"""', "func (", "fn x", "function a( {", "class A { b(", "{" * 5000, "\r\n" * 100]:
        for lang in ("javascript", "python", "go", "rust"):
            list(functions_in(t, lang))
    assert language_of(None, None) is None and language_of("TypeScript", "x") == "javascript" and words_in("a - b c") == 3


def test_dedented_string_in_a_large_file():
    method = 'class A:\n    def load(self):\n        x = """\nselect 1\n"""\n        return x\n\n    def next(self):\n        pass\n'
    many = "".join(f"s{k} = 'v{k}'\n" for k in range(300))
    for src, line in ((method, 2), (many + method, 302), (method + many, 2)):
        f = one(src, "python", "load")
        assert (f.line, f.end_line) == (line, line + 4) and f.code.endswith("return x")


def test_nested_templates_and_comments():
    src = "// Writes the label of one row as text.\nfunction label(x) {\n  const a = `p ${x ? `in } ner ${{k: `}`}.k}` : \"}\"} q`;\n  return a;\n}\nfunction next() {\n  return 1;\n}\n"
    f = one(src, "javascript", "label")
    assert (f.line, f.end_line) == (2, 5) and f.documentation == "Writes the label of one row as text." and one(src, "javascript", "next").end_line == 8
    rust = "/* outer /* inner */ fn ghost() { } */\n/// Gives back the number of slots held.\nfn held() -> u8 {\n    /* } /* } */ } */\n    1\n}\n"
    assert [(f.name, f.end_line) for f in functions_in(rust, "rust")] == [("held", 6)]
    for t in ("`", "`${", "`${`", "`${{", "/*/*", "`\\"):
        assert list(functions_in(t, "javascript")) == [] and list(functions_in(t, "rust")) == []


def test_other_braced_languages():
    java = "class A {\n  /** Reads the next record of the open file. */\n  @Override\n  public List<String> read(int n) throws IOException, B {\n    if (n > 0) { return f(\"}\"); }\n    return new C(n) { };\n  }\n}\n"
    assert [(f.name, f.line, f.end_line, bool(f.documentation)) for f in functions_in(java, "clike")] == [("read", 4, 7, True)]
    cpp = "// Moves the cursor to the first free cell.\nstatic std::vector<int>* Grid::move(const A& a) const {\n  char c = '{';\n  return 0;\n}\nint main() {\n}\n"
    assert [(f.name, f.end_line) for f in functions_in(cpp.replace("Grid::", ""), "clike")] == [("move", 5), ("main", 7)]
    assert [f.name for f in functions_in("// Opens all of the doors at once.\nfun <T> Door.open(a: T): Int {\n}\n", "clike")] == ["open"]
    assert [f.name for f in functions_in("<?php\n# Counts what is left in the list.\npublic static function left($a) {\n  return '}';\n}\n", "php")] == ["left"]
    assert language_of("Java", None) == "clike" and language_of(None, "a/b.php") == "php"
