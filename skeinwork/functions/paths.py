"""Column functions over file paths and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language, names of barrel files, folders and endings that are not indexed.
LANGUAGE_EXTENSIONS = {
    "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyw"], "go": ["go"], "rust": ["rs"], "java": ["java"], "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "csharp": ["cs"], "ruby": ["rb", "erb"], "php": ["php"], "swift": ["swift"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "lua": ["lua"],
    "elixir": ["ex", "exs"], "dart": ["dart"], "zig": ["zig"], "bash": ["sh", "bash", "zsh"], "ocaml": ["ml", "mli"], "objc": ["m"], "css": ["css", "scss", "less"], "html": ["html", "htm"],
    "json": ["json", "jsonc"], "toml": ["toml"], "yaml": ["yaml", "yml"], "dockerfile": ["dockerfile"], "vue": ["vue"], "rescript": ["res", "resi"], "solidity": ["sol"], "tlaplus": ["tla"], "elisp": ["el"],
}
BARREL_FILES = ["index.ts", "index.tsx", "index.js", "mod.rs", "index.py", "__init__.py"]
IGNORED_FOLDERS = ["node_modules", ".git", "dist", "build", "coverage", ".next", "nuxt", "vendor", "venv", "__pycache__", ".cache", "target", "out", ".idea", ".vscode"]
IGNORED_ENDINGS = [".min.js", ".bundle.js", ".d.ts", ".map", ".lock", ".yarn"]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of_path(path: Column) -> Column:
    """The language by the part after the last dot, in any case; ``Dockerfile`` and ``Dockerfile.x``
    (the latter only if the dot of x is the path's only one and x is no extension, as any path with a dot goes by it)."""
    name, dot = file_name(path), F.instr(path, ".") > 0
    ext = F.lower(F.substring_index(path, ".", -1))
    known = F.create_map(*(F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)))
    bare = F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile").otherwise("unknown")
    return F.when(path.isNull(), None).when(dot, F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))).otherwise(bare)


def is_barrel(path: Column) -> Column:
    return F.lower(file_name(path)).isin(BARREL_FILES)


def package_name(specifier: Column) -> Column:
    """``@scope/name`` of a scoped import, else its first part."""
    parts = F.split(specifier, "/")
    scoped = specifier.startswith("@") & (F.size(parts) >= 2)
    return F.when(scoped, F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1)))).otherwise(parts[0])


def is_indexable(path: Column) -> Column:
    """Not in an ignored folder, without an ignored ending, of a known language."""
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))
    ending = F.lit(False)
    for e in IGNORED_ENDINGS:
        ending = ending | path.endswith(e)
    return ~folders & ~ending & (language_of_path(path) != "unknown")


def is_test_like(path: Column) -> Column:
    """The SQL form: LIKE in any case, in which ``_`` stands for any character."""
    return path.ilike("%.test.%") | path.ilike("%_test.%") | path.ilike("%.spec.%")


def is_test_path(path: Column) -> Column:
    """The pattern form: in this case and literally."""
    return path.rlike(r"\.test\.|_test\.|\.spec\.")


def tested_path(path: Column) -> Column:
    """The path without its first ``.test``, ``_test`` and ``.spec`` mark each."""
    out = path
    for mark in (r"\.test\.", r"_test\.", r"\.spec\."):
        out = F.regexp_replace(out, rf"^((?s:.*?)){mark}", "$1.")
    return out


def folder_group(path: Column) -> Column:
    """The first two folders of three parts or more, the first of two, else null."""
    n = F.size(F.split(path, "/"))
    return F.when(n >= 3, F.substring_index(path, "/", 2)).when(n == 2, F.substring_index(path, "/", 1))


def relative_path(path: Column, base: str) -> Column:
    plain, base = F.translate(path, "\\", "/"), base.replace("\\", "/")
    return F.when(plain.startswith(base), F.regexp_replace(F.substring(plain, len(base) + 1, 1 << 30), "^/+", "")).otherwise(plain)


def kind_tag(kind: Column) -> Column:
    tags = {"f:": ["function", "method"], "c:": ["class"], "i:": ["interface"], "t:": ["type"], "v:": ["variable", "constant"], "e:": ["enum"]}
    out = F.lit("")
    for tag, kinds in tags.items():
        out = F.when(kind.isin(kinds), tag).otherwise(out)
    return out


def identifier_words(name: Column) -> Column:
    """Lower-case words of a snake or camel case name."""
    snake = F.filter(F.split(name, "_"), lambda w: w != "")
    camel = F.split(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), " ")
    return F.transform(F.when(F.instr(name, "_") > 0, snake).otherwise(camel), F.lower)


def symbol_summary(name: Column, kind: Column, path: Column) -> Column:
    """``[folder] kind: words of the name``, at most 80 characters."""
    folder = F.when(F.instr(path, "/") > 0, F.element_at(F.split(path, "/"), -2)).otherwise("")
    s = F.concat(F.when(folder != "", F.concat(F.lit("["), folder, F.lit("] "))).otherwise(""), kind, F.lit(": "), F.array_join(identifier_words(name), " "))
    return F.when(F.length(s) > 80, F.concat(F.substring(s, 1, 77), F.lit("..."))).otherwise(s)


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ``**`` crosses folders, ``*`` does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".+?^${}()|[]\\" else glob[i]), i + 1
    return f"^{out}$"


def is_public(name: Column, source_line: Column, language: Column) -> Column:
    """Whether a symbol counts as public by the rule of its language: by the capital of its name, by ``pub``, by an
    underscore, by words of privacy on its line; always where a language has no rule."""
    line = F.ltrim(F.coalesce(source_line, F.lit("")))
    private = line.rlike(r"(?<![A-Za-z0-9_])private(?![A-Za-z0-9_])")
    return (
        F.when(language == "go", name.rlike("^[A-Z]")).when(language.isin("rust", "zig"), line.startswith("pub "))
        .when(language.isin("python", "dart"), ~name.startswith("_")).when(language.isin("java", "kotlin", "scala", "swift", "csharp"), ~private)
        .when(language == "php", ~(private | line.rlike(r"(?<![A-Za-z0-9_])protected(?![A-Za-z0-9_])"))).when(language == "elixir", ~line.startswith("defp "))
        .when(language == "elisp", ~name.startswith("--")).otherwise(True)
    )


def signature_of(lines: Column, line: Column, kind: Column) -> Column:
    """The declaration at 1-based ``line`` of an array of lines: up to two lines joined while its
    brackets stay open, cut at the brace, at most 120 characters; null where there is none."""
    at = lambda k: F.get(lines, line - 1 + k)
    first = F.ltrim(at(0))
    open_ = kind.isin("function", "method") & ~first.rlike(r"[){]|=>")
    one = F.when(open_ & at(1).isNotNull(), F.concat(first, F.lit(" "), F.trim(at(1)))).otherwise(first)
    two = F.when(open_ & at(1).isNotNull() & ~at(1).rlike("[){]") & at(2).isNotNull(), F.concat(one, F.lit(" "), F.trim(at(2)))).otherwise(one)
    brace = F.instr(two, "{")
    cut = F.when(brace > 1, F.rtrim(F.substring(two, F.lit(1), brace - 1))).otherwise(two)
    cut = F.rtrim(F.regexp_replace(cut, r"\s*[{:]\s*$", ""))
    cut = F.when(F.length(cut) > 120, F.concat(F.substring(cut, 1, 117), F.lit("..."))).otherwise(cut)
    return F.when(F.length(cut) > 0, cut)
