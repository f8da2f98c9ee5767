"""Files that nobody wrote by hand: generated, minified, third-party copies, data saved as source.

Texts are fingerprinted by winnowing their normalized tokens, and a file most of whose
fingerprints recur in several unrelated repositories, or in the body of a known third-party
file, is a vendored copy. Most files of an index have no text: for these there is their path, the
catalogue and their counts, which are evidence of their own and are named apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.lexing import LEXERS, language_of, lex
from skeinwork.llm.neardup import plain_path
from skeinwork.runtime import hinted, stored

# Names by which tools mark what they write, and folders for others' code.
GENERATED_FOLDERS = r"(^|/)(__generated__|generated|autogen|auto-generated|autogenerated|codegen-out|gen-out)/"
GENERATED_NAMES = r"(_pb2(_grpc)?\.pyi?|\.pb(\.gw)?\.(go|cc|h|rb|swift|dart|ts|js)|\.(g|gen|generated|designer|freezed)\.[a-z]+|[._-]gen\.[a-z]+|[._-]generated\.[a-z]+)$|(^|/)zz_generated\.[^/]*$|/migrations/\d+_auto_\d[^/]*$"
GENERATED_CASED = r"(^|/)Generated[A-Z_][^/]*\.[a-z]+$"
VENDOR_FOLDERS = r"(^|/)(vendor|vendored|third[_-]?party|3rd[_-]?party|external|externals|node_modules|bower_components|deps|godeps|jspm_packages|site-packages|pods|carthage)/"
MINIFIED_NAMES = r"([._-]min\.(m?js|cjs|css)|\.bundle\.(m?js|cjs|css)|\.[0-9a-f]{8,20}\.(m?js|css))$|(^|/)dist/chunk-[0-9a-f]{6,20}\.m?js$"
SCRIPTS = r"\.(m?js|cjs|css)$"
PROGRAMS = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs|rb|java|kt|c|cc|cpp|h|hpp|cs|php|swift|scala)$"
_BY_TOOL = re.compile(r"code generated by|do not edit|@generated\b|auto-?generated|automatically generated|generated (?:file|code|from|by)\b|(?:produced|created|written) by a tool|edits (?:are|will be) lost", re.I)
_COMMENT = re.compile(r"\s*(//|/\*|\*|#|--|;|<!--|\"\"\"|''')")
_CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+|[^\s\w]")


def repository_of(path: Column) -> Column:
    """The first two folders of a path."""
    return F.substring_index(path, "/", 2)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The distinct least hashes of all windows."""
    if len(hashes) <= window:
        return np.array([hashes.min()]) if len(hashes) else hashes
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1))


def fingerprints(text: str, language: str | None, gram: int = 20, window: int = 12, least: int = 12) -> np.ndarray:
    """Winnowed hashes of runs of ``gram`` tokens: case kept, comments left out, numbers and strings alike. A text that
    has fewer than ``least`` of them has one, of all its tokens, and so recurs as a whole only; none without tokens."""
    if language in LEXERS:
        parts, at = [], 0
        for kind, a, b in lex(text, language):
            parts += [text[at:a], '""' if kind == "text" else " "]
            at = b
        text = "".join([*parts, text[at:]])
    tokens = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(text)]
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) >= gram:
        known: dict[str, int] = {}
        for t in set(tokens):
            known[t] = xxhash.xxh3_64_intdigest(t)
        h = np.array([known[t] for t in tokens], np.uint64)
        acc = np.zeros(len(h) - gram + 1, np.uint64)
        for j in range(gram):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(acc)]
        acc ^= acc >> np.uint64(29)
        found = winnow(acc * np.uint64(0xBF58476D1CE4E5B9), window)
        if len(found) >= least:
            return found
    return np.array([xxhash.xxh3_64_intdigest("\0".join(tokens))], np.uint64)


def heading(rows: list[str]) -> Iterator[str]:
    """The comment lines before the first line of code, and those among the first five lines that are not blank."""
    closes, code, n = None, False, 0
    for r in rows:
        if not r.strip():
            continue
        n += 1
        if closes:
            at = r.find(closes)
            yield r if at < 0 else r[:at]
            if at < 0:
                continue
            rest = r[at + len(closes) :].strip()
            closes, code = None, code or bool(rest) and not _COMMENT.match(rest)
            continue
        if code and n > 5:
            return
        m = _COMMENT.match(r)
        if not m:
            code = code or not r.startswith("<?")
            continue
        yield r
        if (end := _CLOSING.get(m[1])) is not None:
            at = r.find(end, m.end())
            closes = end if at < 0 and not code else None
            rest = r[at + len(end) :].strip() if at >= 0 else ""
            code = code or bool(rest) and not _COMMENT.match(rest)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tool, packed, prints = [], [], [], []
        for fid, text, language, path in zip(*(batch.column(c).to_pylist() for c in ("file_id", "content", "language", "path"))):
            rows = text.splitlines() or [""]
            ids.append(fid)
            tool.append(any(map(_BY_TOOL.search, heading(rows))))
            packed.append(bool(re.search(SCRIPTS, (path or "").lower())) and max(map(len, rows)) >= 1000 and len(text) / len(rows) >= 200)
            prints.append(fingerprints(text, language_of(language, path)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tool, pa.bool_()), pa.array(packed, pa.bool_()), pa.array(prints, pa.list_(pa.int64()))], names=["file_id", "tool", "packed", "prints"])


def recurring(prints: DataFrame, least_repositories: int = 3, least_share: float = 0.6) -> DataFrame:
    """``file_id, share`` of the files of which at least ``least_share`` of the fingerprints occur in
    ``least_repositories`` repositories or more, or in a known third-party file. ``prints`` has file_id, repository,
    prints and known (whether the file is known to be another's); known files answer and are not asked."""
    rows = prints.select("file_id", "repository", "known", F.size("prints").alias("n"), F.explode("prints").alias("print"))
    often = rows.groupBy("print", "repository").agg(F.max("known").alias("known")).groupBy("print").agg(F.count(F.lit(1)).alias("r"), F.max("known").alias("known"))
    often = often.where((F.col("r") >= least_repositories) | F.col("known")).select("print")
    share = F.count(F.lit(1)) / F.max("n")
    return rows.where("not known").join(often, "print").groupBy("file_id").agg(share.alias("share")).where(F.col("share") >= least_share)


def unwritten_files(files: DataFrame, catalog: DataFrame, texts: DataFrame, winnowed: bool = True) -> DataFrame:
    """One row per file: file_id, path, reason, evidence. The reason is ``generated``, ``minified``,
    ``third-party``, ``data`` or null for files written by hand; evidence lists all that speaks for it: ``winnowing``,
    ``folder``, ``catalogue``, ``made by name``, ``made by header``, ``minified by name``, ``minified by counts``,
    ``minified by text``, ``data by counts``.

    A file is third-party as a text whose fingerprints recur, in a folder for such, or by name, language and line
    count in the catalogue (a language ``unknown`` matches by the name alone); generated by its name, its folder or a
    tool's header in the comments before its code; minified by its name, or as a script with 50 symbols or more and 16
    or more a line, or by the lines of its text; data as a program of 5,000 lines or more with at most 3 symbols. Texts
    of files in such folders or in the catalogue are the known bodies in which others' fingerprints are looked up.
    Rows repeated count once; null paths and counts give no evidence; null ids no row. Other columns are left aside.
    """
    rows = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(*(F.max(c).alias(c) for c in ("path", "language", "line_count", "symbol_count")))
    path = plain_path(F.col("path"))
    rows = rows.withColumn("plain", path).withColumn("low", F.lower("plain")).withColumn("file_name", F.substring_index("plain", "/", -1))
    known = catalog.select("file_name", F.col("language").alias("clang"), F.col("line_count").alias("clines")).where("file_name is not null").distinct()
    hit = rows.join(hinted(known), "file_name").where((F.col("line_count") == F.col("clines")) & (F.col("language").isin("unknown", "") | F.col("language").isNull() | (F.lower("language") == F.lower("clang"))))
    hit = hit.select("file_id").distinct().withColumn("listed", F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    read = texts.where("length(content) > 0").select("file_id", "content").join(rows.select("file_id", "path", "language"), "file_id").mapInArrow(_read, "file_id bigint, tool boolean, packed boolean, prints array<bigint>")
    read = stored(read.dropDuplicates(["file_id"]), "prints")
    rows = rows.join(hit, "file_id", "left").join(read.drop("prints"), "file_id", "left")
    if winnowed:
        where = rows.select("file_id", repository_of(F.col("plain")).alias("repository"), (yes(F.col("low").rlike(VENDOR_FOLDERS)) | yes(F.col("listed"))).alias("known"))
        copies = recurring(read.where("not tool and not packed").join(where, "file_id")).select("file_id").withColumn("copied", F.lit(True))
        rows = rows.join(copies, "file_id", "left")
    else:
        rows = rows.withColumn("copied", F.lit(False))
    low = F.col("low")
    dense = low.rlike(SCRIPTS) & (F.col("symbol_count") >= 50) & (F.col("symbol_count") >= 16 * F.col("line_count"))
    signs = {
        "winnowing": ("third-party", F.col("copied")), "folder": ("third-party", low.rlike(VENDOR_FOLDERS)), "catalogue": ("third-party", F.col("listed")),
        "made by name": ("generated", low.rlike(GENERATED_FOLDERS) | low.rlike(GENERATED_NAMES) | F.col("plain").rlike(GENERATED_CASED)), "made by header": ("generated", F.col("tool")),
        "minified by name": ("minified", low.rlike(MINIFIED_NAMES)), "minified by counts": ("minified", dense), "minified by text": ("minified", F.col("packed")),
        "data by counts": ("data", low.rlike(PROGRAMS) & (F.col("line_count") >= 5000) & (F.col("symbol_count") <= 3)),
    }
    rows = rows.select("file_id", "path", F.filter(F.array(*(F.when(yes(c), F.struct(F.lit(kind).alias("reason"), F.lit(sign).alias("sign"))) for sign, (kind, c) in signs.items())), lambda x: x.isNotNull()).alias("s"))
    return rows.select("file_id", "path", F.get(F.col("s.reason"), F.lit(0)).alias("reason"), F.col("s.sign").alias("evidence"))
