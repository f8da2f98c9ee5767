"""Lexing of source texts: strings and comments, brackets, and the functions between them.

A lexer aware of strings and comments blanks both out of a text; declarations are found in
what is left, and braces (or the indentation of Python) delimit their bodies.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

# How each language writes strings and comments; one alternative per kind of token.
_LINE = r"(?P<line>//[^\r\n]*)"
_BLOCK = r"(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
_DQ = r'"(?:\\[\s\S]|[^"\\\r\n])*"?'
_SQ = r"'(?:\\[\s\S]|[^'\\\r\n])*'?"
LEXERS = {
    "python": re.compile(r"(?P<line>#[^\r\n]*)|(?P<text>[rRbBuUfF]{0,2}(?:\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|" + _DQ + "|" + _SQ + "))"),
    "javascript": re.compile(_LINE + "|" + _BLOCK + "|(?P<text>" + _DQ + "|" + _SQ + r")|(?P<tick>`)|(?P<regex>(?<=[=(,:\[!&|?{};+\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[a-z]*)"),
    "go": re.compile(_LINE + "|" + _BLOCK + "|(?P<text>" + _DQ + r"|`[^`]*`?|'(?:\\.|[^'\\\r\n])+')"),
    "rust": re.compile(_LINE + r"|(?P<nest>/\*)|(?P<text>b?r(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|b?" + _DQ.replace(r"\r\n", "") + r"|b?'(?:\\[^'\r\n]+|[^'\\\r\n])')"),
    "clike": re.compile(_LINE + "|" + _BLOCK + r'|(?P<text>"""[\s\S]*?(?:"""|\Z)|@"(?:""|[^"])*"?|' + _DQ + r"|'(?:\\[^'\r\n]+|[^'\\\r\n])')"),
    "php": re.compile(r"(?P<line>(?://|#(?!\[))[^\r\n]*)|" + _BLOCK + "|(?P<text>" + _DQ.replace(r"\r\n", "") + "|" + _SQ.replace(r"\r\n", "") + ")"),
}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "new", "await", "typeof", "throw", "case", "in", "of", "delete", "void", "yield", "super", "constructor_"}
_DECLS = {
    "clike": [
        re.compile(r"^[ \t]*(?:[\w@]+[ \t]+)*?(?:fun|func)\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)*(?P<name>\w+)\s*(?:<[^>()]*>\s*)?(?=\()", re.M),
        re.compile(r"^[ \t]*(?:[\w$<>\[\],.?&*:]+[ \t]+[*&]*)+(?P<name>~?[\w$]+)[ \t]*(?P<method>\()", re.M),
    ],
    "php": [re.compile(r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)\s*(?=\()", re.M)],
    "python": [re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)", re.M)],
    "go": [re.compile(r"^func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?=[\[(])", re.M)],
    "rust": [re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)", re.M)],
    "javascript": [
        re.compile(r"(?<![\w$.])(?=[edaf])(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:async\s++)?function\b\s*+\*?\s*+(?P<name>[\w$]+)"),
        re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?=(?:async\s+)?(?:function\b|[\w$]+\s*=>)|(?P<arrow>(?:async\s*)?(?:<[^>]*>\s*)?\())", re.M),
        re.compile(r"^[ \t]++(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s++)*(?:\*\s*+)?(?P<name>[#\w$]++)\s*+(?:<[^>()]*>\s*)?(?P<method>\()", re.M),
    ],
}
_ALIASES = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "java": "clike", "c": "clike", "cpp": "clike", "c++": "clike", "csharp": "clike", "c#": "clike", "kotlin": "clike", "swift": "clike"}
_BY_SUFFIX = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mts": "javascript", "cts": "javascript", "go": "go", "rs": "rust", "php": "php"} | dict.fromkeys("java c h cc cpp cxx hpp hh cs kt kts swift".split(), "clike")
# What may stand between the parameters of a method and its body.
_BODY = {"javascript": re.compile(r"\s*(?::\s*[^;{}=]+?)?\s*\{"), "clike": re.compile(r"\s*(?:(?:const|noexcept|override|final|async|throws|rethrows|where\b[^{;]*)\b[\s\w.,<>]*)*(?:->\s*[^;{}=]+?|:\s*[^;{}]+?)?\s*\{")}
_NO_DECL = re.compile(r"[ \t]*(?:return|else|new|throw|case|goto|delete|await|yield|if|for|while|switch|catch|do)\b")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BRACKET = re.compile(r"[()\[\]{}]")


@dataclass
class Declared:
    """A function: where it is, its code, and the lines of the comment above it and of the docstring in it."""

    name: str
    line: int
    end_line: int
    code: str
    documentation: list[str]
    start: int
    end: int


def language_of(language: str | None, path: str | None) -> str | None:
    """The lexer to use: by the path's suffix, else by the language's name; None if there is none."""
    suffix = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
    known = (language or "").strip().lower()
    known = _ALIASES.get(known, known)
    return _BY_SUFFIX.get(suffix) or (known if known in LEXERS else None)


_QUASI, _DEPTH = re.compile(r"\\[\s\S]|`|\$\{"), re.compile(r"/\*|\*/")


def _template_end(text: str, at: int) -> int:
    """Where a template literal that opened before ``at`` ends; its expressions may hold templates again."""
    open_ = ["`"]  # ` for a template, a number for an expression and the braces open in it
    while open_:
        if open_[-1] == "`":
            m = _QUASI.search(text, at)
            if m is None:
                return len(text)
            at = m.end()
            if m[0] == "`":
                open_.pop()
            elif m[0] == "${":
                open_.append(1)
            continue
        m = _CODE_IN_TEMPLATE.search(text, at)
        if m is None:
            return len(text)
        at = m.end()
        if m[0] == "`":
            open_.append("`")
        elif m[0] in "{}":
            open_[-1] += 1 if m[0] == "{" else -1
            if open_[-1] == 0:
                open_.pop()
    return at


_CODE_IN_TEMPLATE = re.compile(LEXERS["javascript"].pattern + r"|[{}]")


def lex(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """The comments, strings and patterns of a text in order: kind (comment, text or regex), start, end."""
    at, find = 0, LEXERS[language].search
    while m := find(text, at):
        a, b = m.span()
        kind = m.lastgroup
        if kind == "tick":
            b, kind = _template_end(text, b), "text"
        elif kind == "nest":  # block comments that nest
            depth = 1
            while depth and (n := _DEPTH.search(text, b)):
                b, depth = n.end(), depth + (1 if n[0] == "/*" else -1)
            b, kind = len(text) if depth else b, "comment"
        elif kind in ("line", "block"):
            kind = "comment"
        elif kind != "regex":
            kind = "text"
        yield kind, a, b
        at = b if b > a else b + 1


def _blank(s: str) -> str:
    return re.sub(r"[^\r\n]", " ", s)


class Source:
    """A text with its comments and strings blanked out, and where these were."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        parts, at, self.comments, self.texts = [], 0, [], {}
        for kind, a, b in lex(text, language):
            parts.append(text[at:a])
            if kind == "comment":
                self.comments.append((a, b))
            elif kind == "text":
                self.texts[a] = b
            # a blanked string still is an operand, so quotes stay
            parts.append(_blank(text[a:b]) if kind != "text" else '"' + _blank(text[a + 1 : b - 1]) + '"' if b - a > 1 else text[a:b])
            at = b
        parts.append(text[at:])
        self.bare = "".join(parts)
        self.openings = list(self.texts)
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]
        self.kind = ["blank" if not ln.strip() else "code" for ln in (self.bare[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(text)]))]
        for a, b in self.comments:
            for ln in range(self.line(a), self.line(max(a, b - 1)) + 1):
                if self.kind[ln] == "blank":
                    self.kind[ln] = "comment"
        for m in re.finditer(r"^[ \t]*(?:@[\w.$]+|#!?(?=\[))", self.bare, re.M):
            end = m.end()
            if end < len(self.bare) and self.bare[end] in "([":
                end = self.close(end) + 1
            for ln in range(self.line(m.end() - 1), self.line(max(m.end(), end) - 1) + 1):
                rest = self.bare[end : self.starts[ln + 1] if ln + 1 < len(self.starts) else len(self.bare)] if ln == self.line(end - 1) else ""
                if not rest.strip():
                    self.kind[ln] = "attribute"

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def close(self, at: int) -> int:
        """The position of the bracket that closes the one at ``at``, or the last position."""
        depth = 0
        for m in _BRACKET.finditer(self.bare, at):
            depth += 1 if m[0] in _OPEN else -1
            if depth == 0:
                return m.start()
        return len(self.bare) - 1

    def body(self, at: int) -> int | None:
        """The end of a braced body whose declaration goes on at ``at``; None if it has no body."""
        i, depth = at, 0
        for m in _BRACKET.finditer(self.bare, at):
            if m.start() < i:
                continue
            between = self.bare[i : m.start()]
            if ";" in between or (depth and "\n\n" in between.replace("\r", "") and m[0] != "{"):
                return None
            if m[0] == "{":
                return self.close(m.start()) + 1
            if m[0] in _CLOSE:
                return None
            i = self.close(m.start()) + 1
            depth = 1
        return None

    def python_body(self, at: int, margin: int) -> tuple[int, int | None]:
        """Where an indented body ends, and where it opens."""
        p = self.bare.find("(", at)
        colon = self.bare.find(":", self.close(p) + 1 if p >= 0 else at)
        if colon < 0:
            return len(self.text), None
        arrow = self.bare.find("->", self.close(p), colon + 1)
        if arrow >= 0:  # a return type may hold brackets, with colons or not
            for m in re.finditer(r"[\[:]", self.bare[arrow:]):
                c = arrow + m.start()
                if self.bare[c] == ":" and self.bare.count("[", arrow, c) == self.bare.count("]", arrow, c):
                    colon = c
                    break
        end = self.starts[self.line(colon) + 1] if self.line(colon) + 1 < len(self.starts) else len(self.text)
        for ln in range(self.line(colon) + 1, len(self.starts)):
            a = self.starts[ln]
            b = self.starts[ln + 1] if ln + 1 < len(self.starts) else len(self.text)
            row = self.bare[a:b]
            if row.strip() and self.kind[ln] != "comment":
                if len(row) - len(row.lstrip(" \t")) <= margin and not self._inside(a):
                    break
                end = b
        return end, colon + 1

    def _inside(self, at: int) -> bool:
        k = bisect_left(self.openings, at) - 1  # strings do not overlap
        return k >= 0 and at < self.texts[self.openings[k]]

    def above(self, at: int) -> list[str]:
        """The lines of the comments that end right above the declaration at ``at``."""
        ln, rows = self.line(at) - 1, []
        while ln >= 0 and self.kind[ln] in ("comment", "attribute"):
            if self.kind[ln] == "comment":
                a = self.starts[ln]
                b = self.starts[ln + 1] if ln + 1 < len(self.starts) else len(self.text)
                rows.append(self.text[a:b])
            ln -= 1
        return [plain_comment(r) for r in reversed(rows)]

    def docstring(self, at: int) -> list[str]:
        """The lines of the string that opens the body at ``at``."""
        m = re.compile(r"(?:\s|#[^\r\n]*)*").match(self.text, at)
        a = m.end()
        if a not in self.texts:
            return []
        s = re.sub(r"^[rRbBuUfF]{0,2}('''|\"\"\"|'|\")", "", self.text[a : self.texts[a]])
        s = re.sub(r"('''|\"\"\"|'|\")$", "", s)
        return [r.strip() for r in re.split(r"\r\n|\n|\r", s)]


def plain_comment(row: str) -> str:
    """A comment's line without its marks."""
    s = row.strip()
    s = re.sub(r"^(?://[/!]*|/\*+!?|#+!?|\*+(?!/))\s?", "", s)
    s = re.sub(r"\**\*/$", "", s)
    return s.strip().removeprefix("* ").strip()


def declared_functions(text: str, language: str) -> Iterator[Declared]:
    """Every function and method with a body, by kind of declaration and then in the order of the text."""
    src = Source(text, language)
    seen: set[int] = set()
    for pattern in _DECLS[language]:
        for m in pattern.finditer(src.bare):
            name, at = m["name"], m.start() + len(m[0]) - len(m[0].lstrip())
            if name in _NOT_NAMES or at in seen:
                continue
            if language == "python":
                end, opens = src.python_body(m.end(), m[0].index(m[0].lstrip()[0]) if m[0].strip() else 0)
                doc = src.docstring(opens) if opens else []
            else:
                groups = m.groupdict()
                doc = []
                if groups.get("method"):
                    after = src.close(m.end() - 1) + 1
                    if not _BODY[language].match(src.bare, after) or _NO_DECL.match(m[0]):
                        continue
                    end = src.body(after)
                elif groups.get("arrow"):
                    p = src.bare.find("(", m.end())
                    after = src.close(p) + 1
                    arrow = re.compile(r"\s*(?::[^;{}=]+?)?\s*=>\s*").match(src.bare, after)
                    if not arrow:
                        continue
                    end = src.close(arrow.end()) + 1 if src.bare[arrow.end() : arrow.end() + 1] == "{" else src.starts[min(src.line(arrow.end()) + 1, len(src.starts) - 1)]
                else:
                    end = src.body(m.end())
                if end is None:
                    continue
            seen.add(at)
            code = text[src.starts[src.line(at)] if not src.text[src.starts[src.line(at)] : at].strip() else at : end].rstrip("\r\n")
            alone = not src.text[src.starts[src.line(at)] : at].strip()
            rows = (src.above(at) if alone else []) + doc
            yield Declared(name.lstrip("#"), src.line(at) + 1, src.line(max(at, end - 1)) + 1, code, rows, at, end)
