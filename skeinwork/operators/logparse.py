"""Physical log lines of many programs to entries with time, level, component and message.

The header words of each line become a shape signature (runs of digits and of letters
collapse to one sign each). Each distinct signature is resolved once: the layout it can
belong to, if any, with that layout's pattern. The signatures that open an entry are
broadcast while they are few, and a line is met with its own layout's pattern only, once.
Continuation lines attach to the last opening line before them, per log in blocks of line
numbers, so that a log with a third of all lines is not one task's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.runtime import hinted, stored

#: Line numbers per block of a log.
BLOCK_LINES = 20_000
#: Year of headers that name none.
YEAR = 2026


@dataclass(frozen=True)
class Layout:
    """``shape`` is matched against signatures (9 digits, a letters, w words of both). ``line`` is matched
    against the whole line without control sequences; ``time``, ``component``, ``level`` and ``message``
    say what its groups give. ``Y`` in a time is the year of headers without one. Where fields
    stand in any order, ``line`` is empty and the four are patterns of one group each."""

    name: str
    shape: str
    line: str
    time: str
    component: str
    level: str
    message: str


# The headers of the programs whose logs are read.
LAYOUTS = [
    Layout("epoch", r"^9\.9 a/a\([ 9]*9\): ", r"^(\d{9,10}\.\d+) ([A-Z])/(\w+)\([ \d]+\): ?(.*)$", "$1", "$3", "$2", "$4"),
    Layout("slashed", r"^9/a/9:9:9:9 [+-]9 a - ", r"^(\d+)/(\w+)/(\d+):(\d+:\d+:\d+) ([+-]\d\d)(\d\d) (\w+) - (.*)$", "$3-$2-$1 $4$5:$6", "$7", "", "$8"),
    Layout("bracketed", r"^\[9-9-9 9:9:9,9\] \[a\] a: ", r"^\[(\d+-\d+-\d+) (\d+:\d+:\d+)[,.](\d+)\] \[(\w+)\] (\w+): ?(.*)$", "$1 $2.$3", "$5", "$4", "$6"),
    Layout("zulu", r"^9-9-9T9:9:9\.9Z a \[a\] ", r"^(\d+-\d+-\d+)T(\d+:\d+:\d+\.\d+Z) (\w+) +\[(\w+)\] ?(.*)$", "$1 $2", "$4", "$3", "$5"),
    Layout("zoned", r"^9-9-9T9:9:9\.9[+-]9(:9)? a +a \| ", r"^(\d+-\d+-\d+)T(\d+:\d+:\d+\.\d+[+-]\d\d):?(\d\d) (\w+) +(\w+) \| ?(.*)$", "$1 $2:$3", "$5", "$4", "$6"),
    Layout("letter", r"^[a]9 9:9:9\.9 +9 a\.a:9\] ", r"^([A-Z])(\d\d)(\d\d) (\d+:\d+:\d+\.\d+) +\d+ (\w+)\.\w+:\d+\] ?(.*)$", "Y-$2-$3 $4", "$5", "$1", "$6"),
    Layout("pairs", r"^a=9-9-9T9:9:9\.9Z ", "", r"^\w+=(\d+-\d+-\d+T\S+) ", r"(?:^| )component=(\S+)", r"(?:^| )level=(\w+)", r'(?:^| )msg="((?:[^"\\]|\\.)*+)"'),
    Layout("dashed", r"^9-9-9 9:9:9,9 - a(\.a)? - a - ", r"^(\d+-\d+-\d+) (\d+:\d+:\d+)[,.](\d+) - (?:\w+\.)*+(\w+) - (\w+) - ?(.*)$", "$1 $2.$3", "$4", "$5", "$6"),
    Layout("syslog", r"^a +9 9:9:9 w a-a\[9\]: <a> ", r"^(\w{3}) +(\d+) (\d+:\d+:\d+) \S+ (?:\w+-)*+(\w+)\[\d+\]: <(\w+)> ?(.*)$", "Y-$1-$2 $3", "$4", "$5", "$6"),
    Layout("object", r'^\{"a": ?', "", r'"(?:time|ts|timestamp)" ?: ?"?([0-9][^",}]*)', r'"(?:component|logger)" ?: ?"(?:\w+\.)*(\w+)"', r'"level" ?: ?"?(\w+)', r'"(?:msg|message)" ?: ?"((?:[^"\\]|\\.)*+)"'),
    Layout("spaced", r"^9-9-9 9:9:9\.9 a a ", r"^(\d+-\d+-\d+) (\d+:\d+:\d+\.\d+) (\w+) +(\w+) ?(.*)$", "$1 $2", "$4", "$3", "$5"),
]
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz_", "012345678"
# The words, letters and numbers by which programs name a level.
LEVELS = {
    "DEBUG": ["debug", "dbg", "trace", "trc", "verbose", "fine", "d", "t", "v", "10", "20"],
    "INFO": ["info", "inf", "information", "notice", "i", "n", "30"],
    "WARN": ["warn", "warning", "wrn", "w", "40"],
    "ERROR": ["error", "err", "fatal", "critical", "crit", "severe", "panic", "emerg", "alert", "e", "f", "c", "50", "60"],
}


def clean_line(message: Column) -> Column:
    """A line without terminal control sequences and the CR at its end."""
    plain = F.when(F.instr(message, "\x1b") > 0, F.regexp_replace(message, "\x1b\\[[0-9;?]*[A-Za-z]", "")).otherwise(message)
    return F.rtrim(plain, F.lit("\r"))


def signature(line: Column) -> Column:
    """The shape of a line's first eight words, however long, or of the key that opens an object: digits as 9,
    letters as a, words of both as w, other signs as they are; dotted and dashed names of many
    parts have the shape of two. A ``T`` or ``Z`` between digits stays."""
    s = F.regexp_extract(line, r'^(?:\{"[^"]*+": ?|(?:[^ ]++ ++){1,8}+)', 0)
    s = F.regexp_replace(s, r"(?<=[0-9])T(?=[0-9])", "\x01")
    s = F.regexp_replace(s, r"(?<=[0-9])Z(?![A-Za-z0-9_])", "\x02")
    s = F.translate(s, _LETTERS + _DIGITS + "\x01\x02", "a" * len(_LETTERS) + "9" * len(_DIGITS) + "TZ")
    s = F.regexp_replace(s, r"(a|9)\1+", "$1")
    s = F.regexp_replace(s, r"a([.-])a(?:\1a)+", "a$1a")
    # a host name such as runner-07 is one word
    return F.regexp_replace(s, r"(?<=9:9:9 )[a9.-]+(?= a)", "w")


def resolve(sig: Column, layouts: list[Layout]) -> Column:
    """The number of the first layout that a signature can belong to, null for none."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(layouts))):
        out = F.when(sig.rlike(rule.shape), k).otherwise(out)
    return out


def level_name(word: Column) -> Column:
    out = F.lit("")
    low = F.lower(word)
    for name, words in LEVELS.items():
        out = F.when(low.isin(words), name).otherwise(out)
    return out


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _time_of(text: Column) -> Column:
    """Epoch milliseconds, finer parts cut off, of a number of seconds or milliseconds, or of a date and time with
    the month as number or name; without zone UTC, null if it is neither."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)$", 1)
    value = number.try_cast("decimal(26,6)")
    epoch = F.floor(F.when(value < 100_000_000_000, value * 1000).otherwise(value)).cast("long")
    word = F.regexp_extract(text, "^[0-9]+-([A-Za-z]{3})", 1)
    month = F.instr(F.lit(_MONTHS), F.initcap(word))
    dated = F.when((F.length(word) > 0) & (month % 3 == 1), F.regexp_replace(text, "-[A-Za-z]{3}-", "-MM-")).otherwise(text)
    dated = F.when(F.length(word) > 0, F.replace(dated, F.lit("MM"), F.lpad(((month + 2) / 3).cast("int").cast("string"), 2, "0"))).otherwise(dated)
    dated = F.regexp_replace(F.regexp_replace(dated, r"(\.\d{6})\d+", "$1"), r"(:.*[+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(F.length(number) > 0, epoch).otherwise(F.floor(F.unix_micros(dated.try_cast("timestamp")) / 1000).cast("long"))


def parse_log(lines: DataFrame, block_lines: int = BLOCK_LINES, layouts: list[Layout] = LAYOUTS, year: int = YEAR) -> DataFrame:
    """Entries: log_name, first_line_id, last_line_id, ts_ms, level, component, message.

    A line opens an entry if it begins with a program's header that states time and
    component; one that is indented or quotes another does not. The entry runs to the line
    before the next opening one of its log by line_no; its message is the rest of the opening
    line and, after line feeds, the lines that follow, control sequences and CR at the end removed.
    ``ts_ms`` is in epoch milliseconds UTC; without zone UTC, without year ``year``. ``level`` is
    DEBUG, INFO, WARN, ERROR or '' if the header states none. Lines before a log's first
    opening one belong to no entry. Null and blank lines continue an entry. Rows repeated with
    equal line_id, log_name and line_no count once; lines without log_name form a log of
    their own; lines without line_no come first, by line_id. Other columns are left aside.
    Headers are those of ``layouts``; a header's names and numbers may have any length.
    """
    rows = lines.select("line_id", "log_name", "line_no", clean_line(F.col("message")).alias("line"))
    heads = rows.where(F.col("line").rlike(r"^[\[{A-Za-z0-9]")).select(signature(F.col("line")).alias("sig"))
    # stored before they are resolved, else the rules would be tried on every line again
    found = stored(heads.distinct(), "signatures").select("sig", resolve(F.col("sig"), layouts).alias("rule")).where("rule is not null")
    fixed = F.create_map(*(F.lit(x) for k, r in enumerate(layouts) if r.line for x in (k, "(?s)" + r.line)))
    given = F.create_map(*(F.lit(x) for k, r in enumerate(layouts) if r.line for x in (k, "\x02" + "\x01".join((r.time, r.component, r.level, r.message)).replace("Y-", f"{year}-"))))
    rules = hinted(found.select("sig", "rule", F.try_element_at(fixed, F.col("rule")).alias("pattern"), F.try_element_at(given, F.col("rule")).alias("parts")))
    rows = rows.withColumn("sig", signature(F.col("line"))).join(rules, "sig", "left")
    # one pattern a line, that of its layout; what it does not match comes back as it is
    got = F.when(F.col("pattern").isNotNull(), F.regexp_replace("line", F.col("pattern"), F.col("parts")))
    got = F.when(got.startswith("\x02"), F.split(F.substring(got, 2, 1 << 30), "\x01", 4))
    rows = rows.select("line_id", "log_name", "line_no", "line", "rule", got.alias("got"))
    text = [F.col("got")[i] for i in range(4)]
    for k, rule in enumerate(layouts):
        if rule.line:
            continue
        # among pairs, what a quoted value says is no key
        bare = F.regexp_replace("line", r'"(?:[^"\\]|\\.)*+"', '""') if rule.name == "pairs" else F.col("line")
        own = [F.translate(F.regexp_extract("line", rule.time, 1), ",T", ". "), F.regexp_extract(bare, rule.component, 1), F.regexp_extract(bare, rule.level, 1), F.regexp_extract("line", rule.message, 1)]
        text = [F.when(F.col("rule") == k, o).otherwise(t) for o, t in zip(own, text)]
    rows = rows.select("line_id", "log_name", "line_no", "line", *(t.alias(n) for t, n in zip(text, ("time", "component", "level", "rest"))))
    rows = rows.select("line_id", "log_name", "line_no", "line", _time_of(F.col("time")).alias("ts_ms"), F.lower("component").alias("component"), level_name(F.col("level")).alias("level"), "rest")
    opens = F.col("ts_ms").isNotNull() & (F.length("component") > 0)
    # lines without number come in blocks of their ids, before all others
    block = F.coalesce(F.floor(F.col("line_no") / block_lines), F.floor(F.col("line_id") / block_lines) - (1 << 40)).alias("block")
    rows = rows.select("line_id", "log_name", "line_no", block, F.coalesce(opens, F.lit(False)).alias("opens"), *(F.when(opens, F.col(c)).alias(c) for c in ("ts_ms", "component", "level")), F.when(opens, F.col("rest")).otherwise(F.coalesce("line", F.lit(""))).alias("text"))
    # one shuffle by block serves the removal of repeated rows and the windows inside blocks
    rows = rows.repartition("log_name", "block")
    rows = rows.dropDuplicates(["log_name", "block", "line_no", "line_id"])
    before = Window.partitionBy("log_name", "block").orderBy("line_no", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.last(F.when(F.col("opens"), F.col("line_id")), True).over(before))
    rows = stored(rows, "lines")
    ends = rows.groupBy("log_name", "block").agg(F.max_by("start", F.struct("line_no", "line_id")).alias("open"))
    earlier = Window.partitionBy("log_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("log_name", "block", F.last("open", True).over(earlier).alias("carried"))
    return _entries(_carried(rows, carry))


def _carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Lines before a block's first opening one go to the entry open at the end of the blocks before."""
    c = carry.where("carried is not null").select(F.col("log_name").alias("c_log"), F.col("block").alias("c_block"), "carried")
    got = rows.join(hinted(stored(c, "carry")), F.col("log_name").eqNullSafe(F.col("c_log")) & (F.col("block") == F.col("c_block")), "left")
    return got.withColumn("start", F.coalesce("start", "carried")).where("start is not null")


def _entries(rows: DataFrame) -> DataFrame:
    at = F.struct("line_no", "line_id")
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text")))
    found = rows.groupBy("log_name", "start").agg(
        F.max_by("line_id", at).alias("last_line_id"),
        *(F.max(F.when(F.col("opens"), F.col(c))).alias(c) for c in ("ts_ms", "level", "component")),
        lines.alias("l"),
    )
    return found.select("log_name", F.col("start").alias("first_line_id"), "last_line_id", "ts_ms", "level", "component", F.array_join(F.col("l.text"), "\n").alias("message"))
