"""Outlines of source texts: what they import, declare and export, and the shapes of their functions.

Texts are lexed, not parsed: strings and comments are known, declarations and imports are found in what is left of
Python, JavaScript, TypeScript, Go and Rust texts; functions also in C, C++, C#, Java, Kotlin, Swift and PHP.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.lexing import Source, declared_functions, language_of

# Lines of a function from which on it has a shape, and how deep a shape goes.
SHAPE_LINES, SHAPE_DEPTH = 5, 40
_TYPES = {
    "python": re.compile(r"^[ \t]*class[ \t]+(?P<name>\w+)", re.M), "go": re.compile(r"^type\s+(?P<name>\w+)", re.M), "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+(?P<name>\w+)", re.M),
    "javascript": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+(?P<name>[\w$]+)", re.M),
    "clike": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|open|data|sealed)\s+)*(?:class|interface|enum|struct|object|protocol)\s+(?P<name>\w+)", re.M),
    "php": re.compile(r"^[ \t]*(?:(?:abstract|final)\s+)?(?:class|interface|trait|enum)\s+(?P<name>\w+)", re.M),
}
_CONSTANTS = {
    "python": re.compile(r"^(?P<name>[A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=(?!=)", re.M), "go": re.compile(r"^const\s+(?P<name>\w+)", re.M), "rust": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:", re.M),
    "javascript": re.compile(r"^(?:export\s+)?const\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=(?!\s*(?:async\s+)?(?:function\b|\(|<|[\w$]+\s*=>))", re.M),
}
_JS_IMPORT = re.compile(r"(?<![\w$.])(?P<word>import|export)\b(?P<names>[^;'\"()=]*?)(?:\bfrom\b)?\s*(?=[\"'])")
_JS_REQUIRE = re.compile(r"(?:(?:const|let|var)\s+(?P<names>[\w$]+|\{[^}]*\})\s*=\s*)?(?<![\w$.])(?:require|import)\s*\(\s*(?=[\"'])")
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(?P<source>[.\w]+)[ \t]+import[ \t]*(?:\((?P<more>[^)]*)\)|(?P<names>[^\n;]+))", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?P<names>[\w., \t]+)", re.M)
_GO_IMPORT, _GO_ONE = re.compile(r"^import\s+(?:\((?P<many>[^)]*)\)|(?P<alias>[\w.]+\s+)?(?=[\"`]))", re.M), re.compile(r"(?:(?P<alias>[\w.]+)[ \t]+)?(?P<quote>[\"`])")
_RUST_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<tree>[^;]+);", re.M)
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|[0-9][\w.]*|\"|[()\[\]{}]|[^\s\w]")
_KEPT = frozenset("if else for while do switch match case break continue return throw raise try catch except finally new await yield async loop defer go select function def fn func class let const var lambda with in of is not and or".split())


def _string_at(src: Source, at: int) -> str | None:
    """The content of the string that opens at or after blanks from ``at``."""
    while at < len(src.text) and src.text[at].isspace():
        at += 1
    return src.text[at + 1 : src.texts[at] - 1] if at in src.texts else None


def _js_names(names: str) -> list[str]:
    """The names that an import clause takes from its source: * for all of it, ``default`` for a default."""
    out = []
    for part in re.findall(r"\{[^}]*\}|[^,{}]+", names):
        if part.startswith("{"):
            out += [re.sub(r"^type\s+", "", p.strip()).split(" as ")[0].strip() for p in part[1:-1].split(",") if p.strip()]
        elif (p := re.sub(r"^type\s+", "", part.strip())) and p != "type":
            out.append("*" if p.startswith("*") else "default")
    return out


def _rust_tree(tree: str, base: str = "") -> Iterator[tuple[str, str]]:
    """(source, name) of a use tree."""
    tree = tree.strip()
    if "{" in tree:
        head, rest = tree.split("{", 1)
        rest, depth, part = rest.rsplit("}", 1)[0], 0, ""
        for ch in rest + ",":
            depth += (ch == "{") - (ch == "}")
            if ch == "," and depth == 0:
                if part.strip():
                    yield from _rust_tree(part, base + head.strip())
                part = ""
            else:
                part += ch
        return
    path = (base + re.split(r"\s+as\s+", tree)[0]).strip()
    source, _, name = path.rpartition("::")
    yield source, name


def imports_in(src: Source) -> Iterator[tuple[str, str, int]]:
    """(name, source, line) of every imported name; * for a whole module, a line for an import without names too."""
    bare, line = src.bare, lambda at: src.line(at) + 1
    if src.language == "javascript":
        for m in _JS_IMPORT.finditer(bare):
            if (source := _string_at(src, m.end())) is None or (m["word"] == "export" and not m["names"].strip().startswith(("{", "*"))):
                continue
            for n in _js_names(m["names"]) or ["*"]:
                yield n, source, line(m.start())
        for m in _JS_REQUIRE.finditer(bare):
            if (source := _string_at(src, m.end())) is not None:
                names = m["names"] or ""
                for n in [p.split(":")[0].strip() for p in names[1:-1].split(",") if p.strip()] if names.startswith("{") else ["*"]:
                    yield n, source, line(m.start() + len(m[0]) - len(m[0].lstrip()))
    elif src.language == "python":
        for m in _PY_FROM.finditer(bare):
            for n in (m["more"] or m["names"]).split(","):
                if n := n.strip().split(" as ")[0].strip():
                    yield n, m["source"], line(m.start("source"))
        for m in _PY_IMPORT.finditer(bare):
            for n in m["names"].split(","):
                if n := n.strip().split(" as ")[0].strip():
                    yield "*", n, line(m.start("names"))
    elif src.language == "go":
        for m in _GO_IMPORT.finditer(bare):
            spots = [(n["alias"], m.start("many") + n.start("quote")) for n in _GO_ONE.finditer(m["many"])] if m["many"] is not None else [((m["alias"] or "").strip() or None, m.end())]
            for alias, at in spots:
                if source := _string_at(src, at):
                    yield alias or source.rsplit("/", 1)[-1], source, line(at)
    elif src.language == "rust":
        for m in _RUST_USE.finditer(bare):
            for source, name in _rust_tree(m["tree"]):
                yield name, source, line(m.start("tree"))


def _exported(src: Source, name: str, at: int, listed: set[str]) -> bool:
    row = src.text[src.starts[src.line(at)] :].split("\n", 1)[0].lstrip()
    if src.language == "javascript":
        return row.startswith("export") or name in listed
    if src.language == "go":
        return name[:1].isupper()
    if src.language == "rust":
        return row.startswith("pub")
    return not name.startswith("_") if src.language == "python" else not re.search(r"\b(?:private|protected)\b", row)


def shape_of(src: Source, start: int, end: int) -> tuple[str, int]:
    """(hash, parts) of a function's code with names, numbers and strings alike; what lies deeper than 40 brackets has none."""
    out, depth = [], 0
    for t in _SHAPE.findall(src.bare[start:end]):
        depth -= t in ")]}"
        if depth <= SHAPE_DEPTH:
            out.append(t if t in _KEPT or not (t[0].isalnum() or t[0] in '_$"') else "n" if t[0].isdigit() else "s" if t[0] == '"' else "i")
        depth += t in "([{"
    return hashlib.sha256("\0".join(out).encode()).hexdigest(), len(out)


def outline_of(text: str, language: str) -> Iterator[tuple]:
    """(kind, name, source, line, end_line, exported, shape, parts) of a text's imports, functions, types and constants."""
    src = Source(text, language)
    for name, source, line in imports_in(src):
        yield "import", name, source, line, line, False, None, None
    listed = {n.strip().split(" as ")[0].strip() for m in re.finditer(r"(?<![\w$.])export\s*\{([^}]*)\}(?!\s*from)", src.bare) for n in m[1].split(",")} if language == "javascript" else set()
    for f in declared_functions(text, language):
        shape, parts = shape_of(src, f.start, f.end) if f.end_line - f.line + 1 >= SHAPE_LINES else (None, None)
        yield "function", f.name, None, f.line, f.end_line, _exported(src, f.name, f.start, listed), shape, parts
    for kind, patterns in (("type", _TYPES), ("constant", _CONSTANTS)):
        for m in patterns[language].finditer(src.bare) if language in patterns else ():
            at = m.start("name")
            end = src.body(m.end()) if kind == "type" and language != "python" else src.python_body(m.end(), len(m[0]) - len(m[0].lstrip(" \t")))[0] if kind == "type" else None
            yield kind, m["name"], None, src.line(at) + 1, src.line(max(at, (end or at + 1) - 1)) + 1, _exported(src, m["name"], at, listed), None, None


_OUT = "file_id bigint, kind string, name string, source string, line int, end_line int, exported boolean, shape string, parts int"


def outlines(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``file_id, kind, name, source, line, end_line, exported, shape, parts`` of every import, function, type and constant
    of texts (file_id, content) of known languages.

    The kind is import, function, type or constant. An import has a row per name, * for a whole module, and its
    source; a function of five lines or more has the hash of its shape and the number of its parts. Languages go by the file's path,
    else its language; null and empty texts, and texts without file, give no row. Repeated rows count once.
    """
    kinds = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max("language").alias("language"), F.max("path").alias("path"))
    rows = texts.select("file_id", "content").where("length(content) > 0").join(kinds, "file_id")
    rows = rows.groupBy("file_id", F.xxhash64("content").alias("h")).agg(F.first("content").alias("content"), F.max("language").alias("language"), F.max("path").alias("path")).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "kind", "name", "source", "line", "end_line", "exported", "shape", "parts"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for fid, text, language, path in zip(*(batch.column(c).to_pylist() for c in ("file_id", "content", "language", "path"))):
                if (lexer := language_of(language, path)) is not None:
                    for row in outline_of(text, lexer):
                        for col, v in zip(cols, (fid, *row)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(run, _OUT)


def references(outline: DataFrame) -> DataFrame:
    """``id, file_id, name, import_source, source_file_id`` of an outline's imports, the last still open; each once."""
    rows = outline.where("kind = 'import'").select("file_id", "name", F.col("source").alias("import_source")).distinct()
    return rows.select(F.xxhash64("file_id", "name", "import_source").alias("id"), "file_id", "name", "import_source", F.lit(None).cast("long").alias("source_file_id"))
