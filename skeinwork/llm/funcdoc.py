"""Functions and methods of source files paired with their own documentation.

The core's lexer, aware of strings and comments, blanks both out of a text; declarations are found
in what is left, braces (or the indentation of Python) delimit their bodies, and the
comment that ends right above a declaration, or the docstring that opens its body, is
attached. Lines that describe nothing are taken out of the documentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.lexing import declared_functions, language_of

# What in a comment describes nothing.
_TAG = re.compile(r"^(?:[@\\]\w|:\w[^:]*:|(?:args|arguments|returns?|raises|parameters|params|yields|throws|examples?)\s*:\s*$)", re.I)
_DIRECTIVE = re.compile(r"^(?:eslint|prettier|istanbul|tslint|jshint|jscs|biome|deno-|c8\b|v8\b|ts-(?:ignore|expect|nocheck)|noqa\b|type:\s*ignore|pylint\b|flake8|mypy\b|pyright\b|ruff\b|isort\b|fmt:|yapf|pragma\b|nolint\b|go:\w|\+build\b|line\s+\S+:\d|rustfmt|clippy|noinspection|nosec\b|nosonar\b|coverage:|webpackChunkName|sourceMappingURL|#?(?:end)?region\b|vim:|-\*-)", re.I)
_WORK = re.compile(r"^(?:TODO|FIXME|XXX|HACK|TBD|WIP)(?![-\w])|^(?i:todo|fixme|tbd)\s*(?:[:(.]|$)")
_CODE = re.compile(
    r"[;{}]\s*$|[\w\])]\s*(?::=|[-+*/|&]=|=>|===?|!==?)\s*\S|^[\w.$\[\], &]+(?::[^=]+)?\s=\s\S|^[\w.$:]+!?\([^()]*(?:\([^()]*\)[^()]*)*\)\??[;,]?$"
    r"|^(?:if|for|while|elif|with|else|match)\b.*(?:[\w)\]]\s*:\s*(?:\S*[(.=\[].*)?$|\{)|^(?:return|raise|assert|throw|defer|await|yield|import|from|export|let|const|var|func|fn|def|class)\b.*(?:[\w$]\(|\w\.\w|\w_\w|\w\[)"
)
_TRIVIAL = {"constructor", "helper", "helper function", "utility", "utility function", "function", "method", "internal", "docs", "documentation", "description", "no description", "see above", "see below", "none", "n a", "deprecated"}
_FILLER = {"the", "a", "an", "this", "that", "is", "of", "to", "for", "and", "function", "method", "func", "fn", "def", "class", "it", "its", "implements", "implementation", "does", "helper", "s"}
_WORDS = re.compile(r"[^\W_][\w'’-]*")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass
class Found:
    name: str
    line: int
    end_line: int
    code: str
    documentation: str


def described(rows: list[str], name: str) -> str:
    """What is left of a documentation without the lines that describe nothing."""
    own = {w.lower() for w in _NAME_PARTS.findall(name)} | {name.lower()}
    kept = []
    for s in rows:
        words = [w.lower() for w in _WORDS.findall(s)]
        if not words or _TAG.search(s) or _DIRECTIVE.search(s) or _WORK.search(s) or _CODE.search(s):
            continue
        if " ".join(words) in _TRIVIAL:
            continue
        if all(w in _FILLER or w in own or all(p.lower() in own for p in _NAME_PARTS.findall(w)) for w in words):
            continue
        kept.append(s)
    return "\n".join(kept)


def words_in(s: str) -> int:
    return sum(bool(_WORDS.search(w)) for w in s.split())


def functions_in(text: str, language: str) -> Iterator[Found]:
    """Every function and method with a body and what its documentation says."""
    for f in declared_functions(text, language):
        yield Found(f.name, f.line, f.end_line, f.code, described(f.documentation, f.name))


_OUT = "file_id bigint, found_name string, found_line int, found_end int, code string, documentation string"


def documented_functions(files: DataFrame, texts: DataFrame, least_words: int = 5) -> DataFrame:
    """Every function of ``texts`` (file_id, content) whose documentation has ``least_words`` words
    or more: file_id, found_name, found_line, found_end, code, documentation.

    The language is taken from the file's path, or its language (Python, JavaScript, TypeScript, Go, Rust, Java, C,
    C++, C#, Kotlin, Swift, PHP); texts of other languages, without
    file, null or empty give no row. Repeated rows of files and texts count once.
    """
    kinds = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max("language").alias("language"), F.max("path").alias("path"))
    rows = texts.select("file_id", "content").where("length(content) > 0").join(kinds, "file_id")
    rows = rows.groupBy("file_id", F.xxhash64("content").alias("h")).agg(F.first("content").alias("content"), F.max("language").alias("language"), F.max("path").alias("path")).drop("h")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "found_name", "found_line", "found_end", "code", "documentation"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for fid, text, language, path in zip(*(batch.column(c).to_pylist() for c in ("file_id", "content", "language", "path"))):
                if (lexer := language_of(language, path)) is None:
                    continue
                for f in functions_in(text, lexer):
                    if words_in(f.documentation) >= least_words:
                        for col, v in zip(cols, (fid, f.name, f.line, f.end_line, f.code, f.documentation)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(extract, _OUT)


def code_description_pairs(symbols: DataFrame, files: DataFrame, texts: DataFrame, least_words: int = 5) -> DataFrame:
    """``symbol_id, file_id, name, kind, signature, line, end_line, code, documentation`` of every
    symbol of kind function or method whose documentation describes it in ``least_words`` words.

    The declaration is found by name, as recorded lines may be stale; of several of one name
    the nearest to the recorded line counts, the first if none is recorded. line and end_line are
    those found. A null signature stays null. Repeated rows of a symbol count once; symbols
    without text, name or id give none. Other columns are left aside.
    """
    found = documented_functions(files, texts, least_words)
    want = symbols.where(F.lower(F.trim("kind")).isin("function", "method") & F.col("id").isNotNull())
    want = want.groupBy(F.col("id").alias("symbol_id")).agg(*(F.max(c).alias(c) for c in ("file_id", "name", "signature", "line")), F.lower(F.max(F.trim("kind"))).alias("kind"))
    both = want.join(found.withColumnRenamed("found_name", "name"), ["file_id", "name"])
    near = F.struct(F.abs(F.col("found_line") - F.coalesce("line", F.lit(0))), "found_line")
    both = both.groupBy("symbol_id").agg(*(F.min_by(c, near).alias(c) for c in ("file_id", "name", "kind", "signature", "found_line", "found_end", "code", "documentation")))
    return both.select("symbol_id", "file_id", "name", "kind", "signature", F.col("found_line").alias("line"), F.col("found_end").alias("end_line"), "code", "documentation")
