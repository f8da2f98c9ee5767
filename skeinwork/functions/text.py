"""Column functions over texts: truncation, windows, budgets, rules, templates, hashes, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the truncations.
SHELL_HEAD, SHELL_TAIL, SHELL_LINE = 400, 400, 800
SEARCH_LINES, SEARCH_LINE = 400, 600
FETCH_CHARS = 80_000
# Patterns by which comments that add nothing are known, in order, by category.
SLOP_RULES = [
    ("narration", r"^(?:this|the following|here we|now we|first,? we|next,? we|then we|finally,? we)\b"),
    ("narration", r"^(?:set|get|return|create|initialize|define|declare|assign|call|invoke|import)\s+(?:the|a|an)\b"),
    ("narration", r"^(?:the (?:above|below|following) (?:code|function|method|class|block|snippet))\b"),
    ("over-explanation", r"(?:(?:this|it) (?:is|creates|returns|takes|accepts) (?:a|an|the) (?:new |async )?(?:function|method|class|variable|constant|array|object|promise|string|number|boolean))\b"),
    ("over-explanation", r"^@?(?:type|param|returns?)\s*\{[^}]+\}\s*-?\s*(?:the|a|an)\s"),
    ("filler", r"\b(?:robust|elegant|seamless|streamlined|leverage|utilize|facilitate|comprehensive|cutting[- ]edge|best[- ]practice|industry[- ]standard|world[- ]class|enterprise[- ]grade|production[- ]ready|battle[- ]tested)\b"),
    ("filler", r"\b(?:basically|essentially|simply|just|actually|obviously|clearly|of course|needless to say)\b"),
    ("filler", r"\b(?:as (?:an ai|a language model)|note that|it(?:'s| is) (?:important|worth noting) (?:that|to))\b"),
    ("section-noise", r"^[-=─═*]{3,}\s*(?:imports?|exports?|types?|interfaces?|constants?|helpers?|utils?|main)\s*[-=─═*]*$"),
    ("section-noise", r"^(?:todo|fixme|hack|xxx)(?:\s*:)?\s*$"),
    ("politeness", r"\b(?:please note|feel free|don't hesitate|happy to help|hope this helps|let me know)\b"),
    ("changelog", r"^(?:added|removed|changed|updated|fixed|modified|refactored)\s+(?:by|on|in|for|to)\b"),
    ("changelog", r"^\d{4}[-/]\d{2}[-/]\d{2}\b"),
]
# Patterns, weight and role of each intent, in order.
INTENTS = [
    ("review", "reviewer", 1.2, [r"\breview\b", r"\baudit\b", r"\bcheck\s+(my\s+)?(code|changes|diff|pr|pull\s*request)\b", r"\bcode\s+review\b", r"\blook\s+(at|over)\s+(my\s+)?(changes|code|diff)\b", r"\bfind\s+(bugs|issues|problems)\b"]),
    ("research", "reviewer", 1.0, [r"\bresearch\b", r"\bexplain\b", r"\bwhat\s+is\b", r"\bhow\s+does\b", r"\bwhy\s+(does|is|do)\b", r"\bunderstand\b", r"\banalyze\b", r"\binvestigate\b", r"\barchitecture\b", r"\bdesign\s+pattern\b", r"\bcompare\b"]),
    ("plan", "planner", 1.1, [r"\bplan\b", r"\bdesign\b", r"\bstrateg(y|ize)\b", r"\bpropose\b", r"\boutline\b", r"\barchitect\b", r"\bblueprint\b", r"\broad\s*map\b", r"\bbreak\s+(it\s+)?down\b", r"\bsteps?\s+to\b"]),
    ("debug", "builder", 1.15, [r"\bdebug\b", r"\bfix\b", r"\bbug\b", r"\berror\b", r"\bcrash(es|ing)?\b", r"\bfailing\b", r"\bbroken\b", r"\bdoesn'?t\s+work\b", r"\bnot\s+working\b", r"\btroubleshoot\b", r"\bstack\s*trace\b"]),
    ("quick-fix", "builder", 1.3, [r"\btypo\b", r"\brename\b", r"\bdelete\s+(this|that|the)\s+(line|import|variable|function)\b", r"\bremove\s+(unused|dead)\b", r"\bformat(ting)?\b", r"\blint\s*fix\b", r"\bquick\s*fix\b"]),
    ("implement", "builder", 1.0, [r"\bimplement\b", r"\bcreate\b", r"\bbuild\b", r"\badd\b", r"\bwrite\b", r"\brefactor\b", r"\bmodify\b", r"\bupdate\b", r"\bchange\b", r"\bmigrat(e|ion)\b", r"\bsetup\b", r"\bconfigure\b", r"\binstall\b"]),
]
# Patterns of references to files, of questions, commands, many files and architecture.
FILE_REFERENCE = r"(?:@\[.+?\]|[a-zA-Z0-9_/.-]+\.[a-zA-Z]{1,6})"
QUESTION = r"(?m)[?？]|^(?:what|how|why|where|when|which|who|can|could|would|should|is|are|do|does)\b"
COMMAND = r"(?m)^(?:add|create|build|write|implement|fix|refactor|remove|delete|rename|update|change|move|install|configure|setup|migrate|deploy)\b"
MANY_FILES = r"\b(?:across|all\s+files|every\s+file|project[- ]wide|codebase|entire|whole\s+(?:project|repo))\b"
ARCHITECTURE = r"\b(?:architect|system\s+design|data\s+model|database\s+schema|api\s+design|microservice|monolith|event[- ]driven|message\s+queue)\b"
# Patterns of dangerous commands, and of error messages by kind in order.
DANGEROUS = [r"\brm\s+-rf\s+[/~]", r"\bmkfs\b", r"\bdd\s+if=", r"\bformat\b", r"\b>\s*/dev/", r"\bchmod\s+-R\s+777", r"\bcurl\b.*\|\s*(ba)?sh", r"\bwget\b.*\|\s*(ba)?sh", r"\beval\b", r"\bsudo\s+(rm|mkfs|dd|format|chmod)"]
ERROR_KINDS = [
    ("context_window", r"context window|context_length|token limit|too many tokens|maximum context|prompt is too long|context exceeded|context length"),
    ("timeout", r"timeout|timed out|deadline exceeded|etimedout|econnreset"),
    ("overloaded", r"overloaded|rate limit|too many requests|429|529|capacity|unavailable|service unavailable"),
    ("provider", r"provider|auth|model|api error|forbidden|unauthorized|not found|invalid request|bad request"),
]


def ascii_pattern(pattern: str) -> str:
    """``\\b`` between ASCII word characters only, whatever the Java version's notion of it. In the patterns
    here it opens a word at their start, or follows one; before another sign it asks for a word to end there."""
    word = "[A-Za-z0-9_]"

    def edge(m: re.Match) -> str:
        if m.start():
            return f"(?!{word})"
        return f"(?<!{word})" if re.match(r"[\w(]", pattern[m.end() :]) else f"(?<={word})"

    return re.sub(r"\\b", edge, pattern)


def matches(text: Column, pattern: str, any_case: bool = True, low: Column | None = None) -> Column:
    """Whether a pattern is found. With ``low``, the text in lower case, a pattern that opens with a
    plain word is tried only where that word occurs at all, which is much cheaper to see."""
    found = text.rlike(("(?i)" if any_case else "") + ascii_pattern(pattern))
    if low is not None and (m := re.match(r"\\b([a-z]{3,})([?*{]?)", pattern)):
        word = m[1][:-1] if m[2] else m[1]
        return low.contains(word) & found
    return found


def _clipped(lines: Column, most: int) -> Column:
    more = lambda x: F.concat(F.substring(x, 1, most), F.lit("...["), (F.length(x) - most).cast("string"), F.lit(" more chars truncated]"))
    return F.transform(lines, lambda x: F.when(F.length(x) > most, more(x)).otherwise(x))


def _long(lines: Column, most: int) -> Column:
    return F.size(F.filter(lines, lambda x: F.length(x) > most))


def truncate_shell(text: Column, head: int = SHELL_HEAD, tail: int = SHELL_TAIL, line: int = SHELL_LINE) -> Column:
    """Long lines clipped; of more than head + tail lines, those between give way to a banner."""
    raw = F.split(text, "\n")
    lines, n = _clipped(raw, line), F.size(raw)
    clips = F.when(_long(raw, line) > 0, F.concat(F.lit("; "), _long(raw, line).cast("string"), F.lit(" long lines clipped"))).otherwise("")
    banner = F.concat(F.lit("...["), (n - head - tail).cast("string"), F.lit(" lines hidden"), clips, F.lit("]..."))
    short = F.concat(F.slice(lines, 1, head), F.array(banner), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))
    return F.array_join(F.when(n <= head + tail, lines).otherwise(short), "\n")


def truncate_search(text: Column, most: int = SEARCH_LINES, line: int = SEARCH_LINE) -> Column:
    """Long lines clipped; beyond ``most`` lines a banner with the number of files matched in."""
    raw = F.split(text, "\n")
    lines, n = _clipped(raw, line), F.size(raw)
    files = F.size(F.array_distinct(F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.substring_index(x, ":", 1))))
    across = F.when(files > 0, F.concat(F.lit(" across "), files.cast("string"), F.lit(" files"))).otherwise("")
    clips = F.when(_long(raw, line) > 0, F.concat(F.lit("; "), _long(raw, line).cast("string"), F.lit(" long lines clipped"))).otherwise("")
    banner = F.concat(F.lit("...["), (n - most).cast("string"), F.lit(" more matches truncated"), across, clips, F.lit("]"))
    return F.array_join(F.when(n <= most, lines).otherwise(F.concat(F.slice(lines, 1, most), F.array(banner))), "\n")


def truncate_fetch(text: Column, most: int = FETCH_CHARS) -> Column:
    more = F.concat(F.substring(text, 1, most), F.lit("\n...["), (F.length(text) - most).cast("string"), F.lit(" chars truncated]"))
    return F.when(F.length(text) > most, more).otherwise(text)


def truncate_for_tool(tool: Column, text: Column) -> Column:
    return F.when(tool.isin("bash", "shell"), truncate_shell(text)).when(tool.isin("grep", "glob", "fs_search", "sem_search"), truncate_search(text)).when(tool.isin("webfetch", "fetch"), truncate_fetch(text)).otherwise(text)


def clip_line(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...[+"), (F.length(text) - most).cast("string"), F.lit(" chars]"))).otherwise(text)


def window_around(line: Column, start: Column, end: Column, context: int = 30) -> Column:
    """``context`` characters on either side of the 0-based span [start, end), with ellipses."""
    a, b = F.greatest(F.lit(0), start - context), F.least(F.length(line), end + context)
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(line, a + 1, b - a), F.when(b < F.length(line), "…").otherwise(""))


def estimated_tokens(text: Column, per_token: float = 4.0) -> Column:
    """Characters by 4; graph texts count 3.5 a token."""
    return F.ceil(F.length(text) / F.lit(per_token)).cast("long")


def trim_to_tokens(text: Column, tokens: int, priority: str) -> Column:
    """``low`` is cut anywhere; ``high`` and ``medium`` keep whole lines from the start while they
    fit, medium without the last fifth of them; an ellipsis marks what is missing."""
    most = tokens * 4
    if priority == "low":
        cut = F.concat(F.substring(text, 1, most), F.lit("..."))
    else:
        lines = F.split(text, "\n")
        drop = F.floor(F.size(lines) * 0.2).cast("int") if priority == "medium" else F.lit(0)
        use = F.slice(lines, F.lit(1), F.size(lines) - drop)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("on"))

        def step(acc: Column, x: Column) -> Column:
            on = acc["on"] & (acc["chars"] + F.length(x) + 1 <= most)
            return F.struct(F.when(on, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(on, acc["chars"] + F.length(x) + 1).otherwise(acc["chars"]).alias("chars"), on.alias("on"))

        kept = F.slice(use, F.lit(1), F.aggregate(use, start, step)["n"])
        cut = F.array_join(F.when(F.size(kept) < F.size(use), F.concat(kept, F.array(F.lit("...")))).otherwise(kept), "\n")
    return F.when(F.length(text) <= most, text).otherwise(cut)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def line_hash(line: Column) -> Column:
    return F.substring(sha256_hex(line), 1, 8)


def scope_hash(scope: Column) -> Column:
    return F.substring(sha256_hex(scope), 1, 16)


def anchored_view(text: Column) -> Column:
    """Each line with its number and hash before it; a line feed at the end opens no line."""
    lines = F.split(F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n")
    view = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("#"), line_hash(x), F.lit(": "), x)), "\n")
    return F.when(text == "", "").otherwise(view)


def slop_category(comment: Column) -> Column:
    """The category of the first rule that a comment's text meets; null below 5 characters or for none."""
    out = F.lit(None).cast("string")
    for category, pattern in reversed(SLOP_RULES):
        out = F.when(matches(comment, pattern), category).otherwise(out)
    return F.when(F.length(comment) >= 5, out)


def traits(text: Column) -> Column:
    """Struct of what the rules below ask of a text, each found once: hits of every intent's patterns by weight, references to files,
    words, and whether it asks, tells, speaks of architecture or of many files. Select it first, then what is told by it."""
    # bound once each, as an array of one, so that nothing is worked out again where it is used again
    def found(t: Column) -> Column:
        hits = lambda patterns: sum((matches(t["text"], p, low=t["low"]).cast("int") for p in patterns), F.lit(0))
        return F.struct(
            *((hits(patterns) * weight).alias(tag) for tag, _, weight, patterns in INTENTS), F.regexp_count(t["text"], F.lit(FILE_REFERENCE)).alias("refs"), F.size(F.split(t["text"], r"\s+")).alias("words"),
            matches(t["text"], QUESTION).alias("asks"), matches(t["text"], COMMAND).alias("tells"), matches(t["text"], ARCHITECTURE).alias("design"), matches(t["text"], MANY_FILES).alias("many"),
        )

    both = F.array(F.struct(text.alias("text"), F.lower(text).alias("low")))
    return F.when(text.isNotNull(), F.transform(both, found)[0])


def complexity(s: Column) -> Column:
    """Of a text's traits: trivial, simple, moderate, complex or architectural."""
    return (
        F.when(s["design"] | (s["words"] > 150), "architectural").when(s["many"] | (s["refs"] > 3) | (s["words"] > 80), "complex")
        .when((s["refs"] > 1) | (s["words"] > 30), "moderate").when(s["words"] > 10, "simple").otherwise("trivial")
    )


def conversation_type(s: Column) -> Column:
    return F.when(s["asks"] & s["tells"], "mixed").when(s["asks"], "question").otherwise("command")


def scope_of(s: Column) -> Column:
    return F.when(s["design"], "architectural").when(s["many"] | (s["refs"] > 2), "multi-file").otherwise("single-file")


def intent(s: Column, roles: dict[str, str] | None = None) -> Column:
    """Of a text's traits: struct of tag, role and confidence (the share of the best score in all); the first of equals wins.
    ``roles`` gives own names to builder, planner and reviewer."""
    names = {"builder": "builder", "planner": "planner", "reviewer": "reviewer"} | (roles or {})
    scores = [s[tag] for tag, *_ in INTENTS]
    total, best = sum(scores, F.lit(0.0)), F.greatest(*scores)
    tag, role = F.lit("unknown"), F.lit("builder")
    for t, r, _, _ in reversed(INTENTS):
        tag, role = F.when((s[t] == best) & (best > 0), t).otherwise(tag), F.when((s[t] == best) & (best > 0), r).otherwise(role)
    kind, scope = conversation_type(s), scope_of(s)
    research = (kind == "question") & (scope == "architectural") & (role != "reviewer") & (s["research"] > 0) & (s["research"] >= best * 0.6)
    plan = (kind == "command") & (scope == "architectural") & (tag == "implement")
    return F.struct(
        F.when(research, "research").when(plan, "plan").otherwise(tag).alias("tag"),
        _renamed(F.when(research, "reviewer").when(plan, "planner").otherwise(role), names).alias("role"),
        F.when(total > 0, F.when(research, s["research"]).otherwise(best) / total).otherwise(F.lit(0.0)).alias("confidence"),
    )


def _renamed(value: Column, names: dict[str, str]) -> Column:
    out = value
    for old, new in names.items():
        if old != new:
            out = F.when(value == old, new).otherwise(out)
    return out


def gate_passes(judged: Column, complexity_: Column, role: Column) -> Column:
    """Whether a message of an intent and a complexity may stay with ``role``: unsure, its own, or a trivial quick fix."""
    return (judged["confidence"] < 0.5) | (judged["role"] == role) | ((complexity_ == "trivial") & judged["tag"].isin("quick-fix", "unknown"))


def base_command(command: Column) -> Column:
    """The program of a command's first segment, assignments before it left out; null if there is none."""
    bare = F.regexp_replace(F.trim(command), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S+\s+)++", "")
    first = F.trim(F.split(bare, "[|;&]")[0])
    return F.when(F.length(first) > 0, F.split(first, r"\s+")[0])


def shell_reason(command: Column, listed: Column) -> Column:
    """Why a command is allowed or not; ``listed`` is the role's array of allowed programs, null for no list."""
    danger = F.lit(False)
    for p in DANGEROUS:
        danger = danger | matches(command, p, any_case=False)
    base = base_command(command)
    return F.when(base.isNull(), "unparseable").when(danger, "dangerous").when(listed.isNull(), "no list").when(F.array_contains(listed, base), "listed").otherwise("not listed")


def error_kind(message: Column) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(ERROR_KINDS):
        out = F.when(F.lower(message).rlike(pattern), kind).otherwise(out)
    return out


def model_parts(model: Column) -> Column:
    """Struct of provider and model, parted at the first slash; null unless both are there."""
    at = F.instr(model, "/")
    good = (at > 1) & (at < F.length(model))
    return F.when(good, F.struct(F.substring(model, F.lit(1), at - 1).alias("provider"), F.substring(model, at + 1, F.length(model)).alias("model")))


def fallback_chain(models: Column) -> Column:
    """The parsable models of an array in order, each once."""
    return F.array_distinct(F.filter(models, lambda m: model_parts(m).isNotNull()))


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by the values at hand, once each; unknown names stay."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
    parts = F.split(template, r"(?=\{\{\w+\}\})|(?<=\}\})")
    known = F.create_map(*(x for k, v in values.items() for x in (F.lit("{{" + k + "}}"), v)))
    return F.when(F.size(names) == 0, template).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), ""))


def template_names(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))


def unknown_names(template: Column, known: list[str]) -> Column:
    return F.array_except(template_names(template), F.array(*map(F.lit, known)))


_FRONT = r"^---\s*\n((?s:.*?))\n---\s*\n"


def frontmatter(text: Column) -> Column:
    """Map of the ``key: value`` lines between two ``---`` lines at the start of a text, values as they stand; the last
    of equal keys counts, lines that begin with # do not; empty without such a block."""
    block = F.regexp_extract(text, _FRONT, 1)
    rows = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    pairs = F.filter(rows, lambda x: x.rlike("^[^#:][^:]*:"))
    part = lambda x, n: F.regexp_replace(F.regexp_extract(x, "(?s)^([^:]+):(.*)$", n), r"^\s+|\s+$", "")
    each = F.transform(pairs, lambda x: F.struct(part(x, 1).alias("k"), part(x, 2).alias("v")))
    last = F.filter(each, lambda x, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def front_body(text: Column) -> Column:
    """What follows the front matter, or the whole text without any."""
    return F.regexp_replace(text, _FRONT, "")


def unquoted(value: Column) -> Column:
    q = (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    return F.when(q, F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)


def front_list(value: Column) -> Column:
    """A value as a list: ``[a, "b"]`` its parts, anything else itself, nothing for an empty one."""
    inner = F.regexp_extract(value, r"^\[(.+)\]$", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: unquoted(F.trim(x))), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(F.length(inner) > 0, parts).when(F.length(value) > 0, F.array(unquoted(value))).otherwise(none)


def format_tokens(n: Column) -> Column:
    """``1.2k`` from 1000 on, rounded as the binary fraction n / 1000 stands to the half."""
    d = n / F.lit(1000.0)
    high = d * 134217729.0 - (d * 134217729.0 - d)
    over = (high * 1000.0 - n) + (d - high) * 1000.0 >= 0
    rest = F.pmod(n, F.lit(100))
    tenths = F.floor(n / 100) + F.when((rest > 50) | ((rest == 50) & over), 1).otherwise(0)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("k"))
    return F.when(n >= 1000, short).otherwise(n.cast("string"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds, halves up, between two timestamps; 0 without a start."""
    ms = F.unix_millis(end) - F.unix_millis(start)
    return F.when(start.isNull(), 0).otherwise(F.floor(ms / 1000 + 0.5)).cast("long")


def format_duration(seconds: Column) -> Column:
    m, s = F.floor(seconds / 60).cast("string"), F.pmod(seconds, F.lit(60)).cast("string")
    return F.when(seconds >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def compare_versions(a: Column, b: Column) -> Column:
    """Negative, zero or positive as the first differing numbers of two dotted versions differ; missing ones are 0."""
    num = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    diff = F.zip_with(num(a), num(b), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.coalesce(F.get(F.filter(diff, lambda d: d != 0), F.lit(0)), F.lit(0))


def squash(x: Column) -> Column:
    return 1 - 1 / (1 + F.log1p(F.greatest(x, F.lit(0.0))))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def escape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_cypher(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def graph_id(text: Column) -> Column:
    """A text in word characters that does not begin with a digit."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^([0-9]|$)"), F.concat(F.lit("n_"), plain)).otherwise(plain)


def mermaid_label(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" ")), F.lit('"'))


def number_text(n: Column) -> Column:
    """A number without a fraction of zeros."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, F.floor(n).cast("long").cast("string")).otherwise(n.cast("string"))


def partial_match(text: Column, wanted: str) -> Column:
    """2 for an equal name in any case, 1 for one that contains it, else 0; an empty wish meets all."""
    low = F.lower(text)
    return F.when(F.lit(wanted == ""), 1).when(low == wanted.lower(), 2).when(F.instr(low, wanted.lower()) > 0, 1).otherwise(0)


_INTO = re.compile(r"^.*?/\*+\s*")


def comments_in(text: str) -> list[tuple[str, str]]:
    """(line, comment) of the lines that are comments, block or single, or part of one, both without blanks around
    them. The line that opens a block counts by what follows its mark; a block open at the end is taken in."""
    out, inside = [], False
    for row in text.split("\n"):
        line = row.strip()
        if not inside and "/*" in line:
            inside = True
            after = _INTO.sub("", line, count=1)
            if after and not after.startswith("*"):
                out.append((line, re.sub(r"\*/\s*$", "", after).strip()))
        if inside:
            inside = "*/" not in line
            body = re.sub(r"^\s*\*?\s*", "", re.sub(r"\*/.*$", "", line)).strip()
            if body:
                out.append((line, body))
        elif m := re.match(r"(?://|#)\s*(.+)", line):
            out.append((line, m[1].strip()))
    return out
