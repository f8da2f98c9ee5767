"""Selecting and packing texts for a prompt, patches at anchored lines, doc comments, names, reads of changed files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from skeinwork.functions.paths import glob_pattern
from skeinwork.functions.text import comments_in, line_hash, slop_category
from skeinwork.operators.versioning import line_diff

# Characters of a packed context, of its README, and below which no part of an item is worth adding;
# characters of a unique name, of a doc comment, and of a difference that is shown instead of a file.
PACK_CHARS, README_CHARS, LEAST_PART = 50_000, 4_000, 200
NAME_CHARS, DOC_CHARS, DIFF_CHARS = 25, 80, 1500
MORE = "\n\n[... truncated ...]"
SCOPES = ["global", "user", "project"]


def select_skills(skills: DataFrame, agent: str, touched: list[str] | None = None) -> DataFrame:
    """Skills (name, scope, agents, globs, body) of an agent: of one name that of the narrowest scope; an empty list of
    agents or globs admits all; with touched files, one has to match one of the globs."""
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    best = skills.groupBy("name").agg(F.max_by(F.struct("scope", "agents", "globs", "body"), rank).alias("s")).select("name", "s.*")
    fit = (F.coalesce(F.size("agents"), F.lit(0)) <= 0) | F.array_contains("agents", agent)
    if touched is None:
        return best.where(fit)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [g for g in batch.column("g").to_pylist() if any(re.search(p, t) for p in [glob_pattern(g)] for t in touched)]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.string())], names=["g"])

    # globs become patterns once per distinct glob, where they are
    each = best.select(F.col("name").alias("_n"), F.explode("globs").alias("g")).where("g is not null")
    good = each.select("g").distinct().mapInArrow(match, "g string")
    hit = each.join(good, "g").select("_n").distinct().withColumn("_hit", F.lit(True))
    fit = fit & ((F.coalesce(F.size("globs"), F.lit(0)) <= 0) | F.coalesce("_hit", F.lit(False)))
    return best.join(hit, best["name"].eqNullSafe(hit["_n"]), "left").where(fit).drop("_n", "_hit")


def pack(items: list[tuple[str, str]], most: int = PACK_CHARS) -> list[tuple[str, str]]:
    """(source, content) pairs that fit, in order: blank and repeated contents are left out, one that is too long gives
    its beginning if enough room is left; what follows may still fit."""
    seen, out, used = set(), [], 0
    for source, content in items:
        if not content or not content.strip() or content in seen:
            continue
        if source == "README.md" and len(content) > README_CHARS:
            content = content[:README_CHARS] + "\n\n[... README truncated ...]"
        room = most - used
        if len(content) > room:
            if room <= LEAST_PART:
                continue
            out.append((source, content[:room] + MORE))
        else:
            out.append((source, content))
        seen.add(content)
        used += len(out[-1][1])
    return out


def pack_contexts(items: DataFrame, most: int = PACK_CHARS) -> DataFrame:
    """Items (session_id, pos, source, content) packed per session: session_id, nth, source, content. A session's items
    are those offered to one prompt; they are gathered per session, each content once and no longer than a pack."""
    fresh = items.where("trim(content) <> ''").withColumn("_f", F.row_number().over(Window.partitionBy("session_id", F.xxhash64("content"), "content").orderBy("pos"))).where("_f = 1").drop("_f")
    fresh = fresh.withColumn("content", F.substring("content", 1, most + 1))
    kind = dict(items.dtypes)["session_id"]

    def fold(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["pos", "source", "content"]).to_pylist(), key=lambda r: r["pos"])
        got = pack([(r["source"], r["content"]) for r in rows], most)
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(got), key[0].type), "nth": pa.array(range(len(got)), pa.int32()), "source": pa.array([s for s, _ in got], pa.string()), "content": pa.array([c for _, c in got], pa.string())})

    return fresh.groupBy("session_id").applyInArrow(fold, f"session_id {kind}, nth int, source string, content string")


def anchors_hold(patches: DataFrame, lines: DataFrame) -> DataFrame:
    """Patches (file, line, hash, ...) with ``holds``: whether the file's line (file, line, text) still has that hash."""
    now = lines.select("file", "line", line_hash(F.col("text")).alias("_now"))
    return patches.join(now, ["file", "line"], "left").withColumn("holds", F.coalesce(F.lower("hash") == F.col("_now"), F.lit(False))).drop("_now")


def replace_lines(text: Column, first: Column, last: Column, new: Column) -> Column:
    """A text with its lines ``first`` to ``last`` replaced by those of ``new``, none if that is empty. A line feed at its end stays."""
    tail = text.endswith("\n")
    lines = F.split(F.when(tail, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n")
    middle = F.when(new == "", F.array().cast("array<string>")).otherwise(F.split(new, "\n"))
    out = F.array_join(F.concat(F.slice(lines, F.lit(1), first - 1), middle, F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))), "\n")
    return F.when(tail, F.concat(out, F.lit("\n"))).otherwise(out)


def doc_line(lines: list[str], at: int) -> str | None:
    """One line about the symbol at 0-based ``at``: its docstring, or the comment above it, at most 80 characters; null below 5."""
    found: list[str] = []
    if at < len(lines) and re.match(r"\s*(?:async\s+def|def|class)\s", lines[at]):
        ahead = "\n".join(x.strip() for x in lines[at + 1 : at + 13])
        if m := re.match(r"\s{0,2}(\"\"\"|''')([\s\S]*?)(?:\1|\Z)", ahead):
            found = m[2].split("\n")
    if not found:
        above, k = [], at - 1
        if k >= 0 and not lines[k].strip():
            k -= 1
        block = k >= 0 and lines[k].strip().endswith("*/")
        while k >= 0:
            s = lines[k].strip()
            if block or re.match(r"//|#(?!!)", s):
                above.append(s)
            else:
                break
            if block and s.startswith("/*"):
                break
            k -= 1
        for s in reversed(above):
            s = re.sub(r"^(?:/\*+|\*+(?!/)|//+|#)\s?|\s*\*+/$", "", s).strip()
            if block and s.startswith("@"):
                break
            found.append(s)
    text = " ".join(" ".join(found).split())
    return None if len(text) < 5 else text if len(text) <= DOC_CHARS else text[: DOC_CHARS - 3] + "..."


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``base, name`` for names asked for (base) one by one, against names taken (name): the base, cut at 25 characters,
    or the least ``-n`` of it that is not taken."""
    cut = wanted.select("base", F.substring("base", 1, NAME_CHARS).alias("cut")).where("base is not null").distinct()
    plain = taken.select("name").where("name is not null").distinct()
    numbers = plain.select(F.regexp_extract("name", "^(.*)-[1-9][0-9]*$", 1).alias("cut"), F.regexp_extract("name", "-([1-9][0-9]*)$", 1).try_cast("long").alias("n")).where("n is not null and cut <> ''")
    used = plain.select(F.col("name").alias("cut"), F.lit(0).cast("long").alias("n")).union(numbers)
    # the least number missing is one more than a used one whose successor is not used
    after = used.select("cut", (F.col("n") + 1).alias("n")).join(used, ["cut", "n"], "left_anti").groupBy("cut").agg(F.min("n").alias("free"))
    held = plain.select(F.col("name").alias("cut"), F.lit(True).alias("held"))
    got = cut.join(after, "cut", "left").join(held, "cut", "left")
    return got.select("base", F.when(F.col("held"), F.concat("cut", F.lit("-"), F.col("free").cast("string"))).otherwise(F.col("cut")).alias("name"))


def unique_name(taken: DataFrame, base: str) -> str:
    """``base``, cut, or the least ``-n`` of it that is not among ``taken`` (name)."""
    cut = base[:NAME_CHARS]
    number = F.when(F.col("name") == cut, 0).otherwise(F.regexp_extract("name", "^\\Q" + cut + "\\E-([1-9][0-9]*)$", 1).try_cast("int"))
    used = taken.where(F.col("name").startswith(cut)).select(number.alias("n")).where("n is not null").distinct()
    # the least number missing is one more than a used one whose successor is not used
    after = used.select((F.col("n") + 1).alias("n")).join(used, "n", "left_anti").agg(F.min("n")).first()[0]
    return cut if used.where("n = 0").count() == 0 else f"{cut}-{after}"


def best_match(rows: DataFrame, wanted: str, fields: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, with a field equal to ``wanted`` in any case; else the only row with one that holds
    it; else all rows that hold it as candidates (match false)."""
    low = wanted.lower()
    equal, held = F.lit(False), F.lit(False)
    for f in fields:
        equal = equal | F.coalesce(F.lower(f) == low, F.lit(False))
        held = held | F.coalesce(F.instr(F.lower(f), low) > 0, F.lit(False)) if low else F.lit(True)
    hit = rows.withColumn("_e", equal).where(held)
    first = hit.where("_e").orderBy(order).limit(1)
    if first.count():
        return first.drop("_e").withColumn("match", F.lit(True))
    n = hit.limit(2).count()
    return hit.drop("_e").withColumn("match", F.lit(n == 1))


def read_answers(reads: DataFrame, most: int = DIFF_CHARS) -> DataFrame:
    """Reads of files (session_id, seq, path, mtime, content) with what is answered: ``full`` the first time, ``unchanged`` if the
    mtime is that of the read before, ``delta`` with the difference if there is one and it is short, else ``full``."""
    w = Window.partitionBy("session_id", "path").orderBy("seq")
    rows = reads.withColumn("_m", F.lag("mtime").over(w)).withColumn("_c", F.lag("content").over(w))
    changed = F.col("_m").isNotNull() & (F.col("_m") != F.col("mtime"))
    rows = rows.withColumn("_old", F.when(changed, F.col("_c"))).withColumn("_first", F.col("_m").isNull())
    kept = [*reads.columns, "_first"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("_diff", StringType()), StructField("_changed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diffs = [None if o is None or c is None else line_diff(o, c, p or "") for o, c, p in zip(*(batch.column(n).to_pylist() for n in ("_old", "content", "path")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(diffs, pa.string()), batch.column("_changed")], names=[*kept, "_diff", "_changed"])

    rows = rows.withColumn("_changed", F.coalesce(changed, F.lit(False))).select(*reads.columns, "_first", "_old", "_changed").mapInArrow(run, schema)
    kind = F.when(F.col("_first"), "full").when(~F.col("_changed"), "unchanged").when((F.length("_diff") > 0) & (F.length("_diff") < most), "delta").otherwise("full")
    rows = rows.withColumn("answer", kind)
    return rows.select(*reads.columns, "answer", F.when(F.col("answer") == "delta", F.col("_diff")).alias("delta"))


def rolling_hash(text: Column) -> Column:
    """The 32-bit rolling hash of a text's UTF-16 units, signed, in base 36; null for a null text."""
    units = F.encode(text, "UTF-16BE")
    pair = lambda k: F.conv(F.hex(F.substring(units, k * 2 + 1, 2)), 16, 10).cast("long")
    steps = F.when(F.octet_length(units) > 0, F.sequence(F.lit(0), (F.octet_length(units) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, k: (acc * 31 + pair(k)) % (1 << 32))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.when(text.isNotNull(), F.concat(F.when(signed < 0, "-").otherwise(""), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))))


def symbol_docs(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, doc``: one line about each symbol (id, file_id, line) from its file's text (file_id, content), as ``doc_line`` reads it;
    null where there is none or the line lies outside the text."""
    s = symbols.where("id is not null and line > 0").groupBy("id").agg(F.min(F.struct("file_id", "line")).alias("s")).select("id", "s.*")
    per = s.groupBy("file_id").agg(F.collect_list(F.struct("id", "line")).alias("at"))
    rows = per.join(texts.where("content is not null").groupBy("file_id").agg(F.max("content").alias("content")), "file_id").select("at", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs = [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("content").to_pylist()):
                lines = re.split(r"\r?\n", text)
                for x in at:
                    ids.append(x["id"])
                    docs.append(doc_line(lines, x["line"] - 1) if x["line"] <= len(lines) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("at").type.value_type.field("id").type), pa.array(docs, pa.string())], names=["id", "doc"])

    return rows.mapInArrow(run, f"id {dict(symbols.dtypes)['id']}, doc string")


def comment_slop(texts: DataFrame, id: str = "id", text: str = "text", least: int = 2) -> DataFrame:
    """Comments of code that add nothing: id, nth, category, line, warned. The first rule that a comment of five
    characters or more meets counts, once per line and category; warned is whether the text has ``least`` of them."""
    kind = dict(texts.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for k, (line, comment) in enumerate(comments_in(t)):
                    for col, v in zip(cols, (i, k, line, comment)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string()))], names=["id", "k", "line", "comment"])

    rows = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, f"id {kind}, k int, line string, comment string")
    found = rows.withColumn("category", slop_category(F.col("comment"))).where("category is not null")
    once = found.groupBy("id", "category", "line").agg(F.min("k").alias("k"))
    n = once.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    short = F.when(F.length("line") > 120, F.concat(F.substring("line", 1, 120), F.lit("…"))).otherwise(F.col("line"))
    return once.join(n, "id").select("id", "k", "category", short.alias("line"), (F.col("n") >= least).alias("warned"))


def message_text(role: Column, parts: Column) -> Column:
    """A message as text: its role, then its parts (array of struct<kind, text>), tools in brackets, blanks left out."""
    one = lambda p: F.when(p["kind"] == "text", p["text"]).when(p["kind"].isin("tool", "subtask"), F.concat(F.lit("["), p["text"], F.lit("]")))
    rows = F.filter(F.transform(parts, one), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.concat(role, F.lit(": "), F.array_join(rows, "\n"))


def _kept_json(rows: DataFrame, project: str | None, prefix: str, now: int, schema: str) -> DataFrame:
    hit = rows.where(F.col("key").startswith(prefix) & (F.col("expires_at") > now))
    if project is not None:
        hit = hit.where(F.col("project_id") == project)
    return hit.select("key", F.from_json("data", schema).alias("j"))


def loop_states(rows: DataFrame, now: int, project: str | None = None, prefix: str = "loop:") -> DataFrame:
    """Loops kept as JSON under keys with a prefix, unexpired, that have a name and a session: key, name, session_id,
    active, phase (coding if absent), iteration, most_iterations (0 if absent), started, tokens, cost."""
    j = "loopName string, sessionId string, active boolean, phase string, iteration int, maxIterations int, startedAt string, totalTokens long, totalCostUsd double"
    got = _kept_json(rows, project, prefix, now, j).where("length(j.loopName) > 0 and length(j.sessionId) > 0")
    none = lambda c, v: F.coalesce(F.col(f"j.{c}"), F.lit(v))
    return got.select("key", F.col("j.loopName").alias("name"), F.col("j.sessionId").alias("session_id"), none("active", False).alias("active"), none("phase", "coding").alias("phase"), none("iteration", 0).alias("iteration"), none("maxIterations", 0).alias("most_iterations"), F.try_to_timestamp(F.col("j.startedAt")).alias("started"), F.col("j.totalTokens").alias("tokens"), F.col("j.totalCostUsd").alias("cost"))


def open_tasks(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The last pending and running tasks (id, target_agent, status, summary, created_at)."""
    return tasks.where(F.col("status").isin("pending", "running")).orderBy(F.desc("created_at"), "id").limit(limit).select("id", "target_agent", "status", "summary")


def fresh_budgets(rows: DataFrame, now: int, project: str | None = None, session: str | None = None, fresh: int = 600_000) -> DataFrame:
    """Budget snapshots kept as JSON under ``budget:`` keys, unexpired and updated within ten minutes: key, agent, session_id, updated_at, turns, tokens."""
    j = "agent string, sessionId string, updatedAt long, state struct<turns:long, tokensUsed:long>"
    got = _kept_json(rows, project, "budget:", now, j).where("length(j.agent) > 0 and length(j.sessionId) > 0").where(F.col("j.updatedAt") >= now - fresh)
    if session is not None:
        got = got.where(F.col("j.sessionId") == session)
    return got.select("key", "j.agent", F.col("j.sessionId").alias("session_id"), F.col("j.updatedAt").alias("updated_at"), F.col("j.state.turns").alias("turns"), F.col("j.state.tokensUsed").alias("tokens"))
