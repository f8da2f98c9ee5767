"""The reading level of the English prose in each document.

Prose is taken out of a document first: fenced and bare code, tables, traces, log lines,
links, headings and lists of names stay behind. Its words, and of each sentence a token each
for its length, its joints and its share of long words, are the tokens of smoothed unigram
language models, one per level, trained on labelled documents; a document gets the level of
highest posterior. (Held out on the test labels, the models of words alone mistake "level 4
or 5" three times as often.) Levels that have too few labelled documents are seeded by a
readability formula over all documents.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import stored

LEVELS = (1, 2, 3, 4, 5)
#: Labelled documents that train the models at most, a hash-ordered sample of the labels.
MOST_LABELLED = 20_000
#: Labels from which on a level needs no seeds.
LEAST_LABELLED = 5
#: Share of a seeded level's tokens from which on a token is held; it bounds them to 100,000 a level.
LEAST_SHARE = 1e-5
# School years at whose end elementary, middle and high school and college end.
SCHOOL_ENDS = (5.0, 8.0, 12.0, 16.0)
#: Words of prose below which a document is a stub.
LEAST_WORDS = 10

_FENCE = re.compile(r"^\s*(```+|~~~+)")
_QUOTE = re.compile(r"^(?:\s*>\s?)+")
_ROLE = re.compile(r"^\s*(?:user|assistant|system|human|ai|q|a|question|answer)\s*:\s+", re.I)
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_LOG = re.compile(r"^\W{0,2}(?:\w+: )?(?:\d{4}-\d\d-\d\d[T ]\d\d:|\d\d/\w{3}/\d{4}:|\d{9,10}\.\d+ |[A-Z]\d{4} \d\d:\d\d|[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d |(?:ts|time)=\S+|\{\s*\")|\x1b\[")
_TRACE = re.compile(r"^\s*(?:at \S+ ?\(|File \"|Traceback\b|Caused by:|\d+: \w+::|thread '|\.\.\. \d+ more)|\(\S+:\d+:\d+\)\s*$|^\w*(?:Error|Exception)\b:")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)|https?://\S+|www\.\S+")
_NOISE = re.compile(r"`[^`]*`|\((?:about|approx\.?|ca\.?)\s[^)]*\)|<\|?[^<>\s]*\|?>|\bv?\d+(?:\.\d+)+\b|\b\d[\d.,]*\s?(?:ms|s|kb|mb|gb|%)?(?=\W|$)|[​-‏⁠﻿]|[=_*~#-]{4,}")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*[{}\[\]()<#@/]|[=<>!:+-]=|=>|->|::|&&|\|\||\w\(\S*\)|\w\.\w+\(|\w\[\w|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*\b|^\s*\||\s\|\s|\s=\s|\\n")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’-][A-Za-zÀ-ÖØ-öø-ÿ]+)*")
_STOP = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_ABBREVIATED = re.compile(r"\b(?:e\.g|i\.e|etc|vs|cf|approx|no)\.", re.I)
# Function words that tell English from its neighbours.
_ENGLISH = set("the a an and or but of to in on at by for with from as that this these those which who it its is are was were be been has have had do does did not no so if when while until before after because we you he she they our your their can should may will then into than each every any one also too twice now there here what where although whereas".split())
_FOREIGN = set("der die das den dem ein eine einen und nicht ist wenn wird danach zuerst bitte jeder el la los las un una unos y que del cuando cada otra vez primero después il faut le les des du une et est pas quand chaque puis dans pour sur nach mit auf von zu lo gli che di per con não os da em para".split())


# What the patterns above need to match at all; looking for these is cheaper.
_MAYBE_LINK, _MAYBE_NOISE = re.compile(r"\]\(|://|www\."), re.compile(r"[`(<\d\u200b-\u200f\u2060\ufeff]|[=_*~#-]{4}")
_MAYBE_CODE = re.compile(r"[;{}\[\]()<>#@/=&|_\\]|::|[a-z][A-Z]")
_TITLE = re.compile(r"^\s*(?:#{1,6}\s|\*\*[^*]*\*\*\s*$|={3,}|-{3,}|\|)")
_RUN, _CODE_END = re.compile(r"[a-z]{2,} [a-z]{2,} [a-z]{2,}"), re.compile(r"[;{}]\s*$|^\s*[{}|/#@]|\s=\s|:=|=>|\w\.\w+\(.*\)\s*$")
_STATEMENT = re.compile(r"^\s*(?:return|if|for|while|const|let|var|throw|defer|raise|assert|with)\b.*\w[(\[{]")
_STRONG = re.compile(r"[*_~]{1,3}(?=\w)|(?<=\w)[*_~]{1,3}")
_SHORT = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "approx.", "no.")


@dataclass
class Sentence:
    """``words`` in lower case, the number of ``joints`` (commas and semicolons, up to 8), and how many of the words
    are function words of English (``own``) and of its neighbours (``other``)."""

    words: list[str]
    joints: int
    own: int
    other: int


def prose_of(text: str) -> list[Sentence]:
    """The sentences of a text's prose."""
    rows = re.split(r"\r\n|\n|\r", text)
    inside = _fenced(rows) if "```" in text or "~~~" in text else ()
    parts: list[str] = []
    for i, row in enumerate(rows):
        if i in inside or not row or row.isspace():
            parts.append("\n")
            continue
        if ">" in row:
            row = _QUOTE.sub("", row)
            if not row.strip():
                parts.append("\n")
                continue
        if _BULLET.match(row) or _ROLE.match(row):
            parts.append("\n")
            row = _ROLE.sub("", _BULLET.sub("", row))
        if (kept := _prose_row(row)) is None:
            parts.append("\n")
        else:
            parts.append(kept)
    sentences = []
    for block in " ".join(parts).split("\n"):
        # two letters whose lower case is one of the plain ones
        block = block.strip().replace("\u0130", " ").replace("\u212a", " ").lower()
        if not block:
            continue
        if any(x in block for x in _SHORT):
            block = _ABBREVIATED.sub(" ", block)
        for s in _STOP.split(block):
            words = _WORD.findall(s)
            if len(words) >= 6 or (len(words) >= 3 and s.rstrip("\"')] ")[-1:] in ".!?"):
                sentences.append(Sentence(words, min(s.count(",") + s.count(";"), 8), len([w for w in words if w in _ENGLISH]), len([w for w in words if w in _FOREIGN])))
    return sentences


def _fenced(rows: list[str]) -> set[int]:
    """The lines of fenced code; a fence that never closes ends at the next blank line that prose follows."""
    fences = [i for i, r in enumerate(rows) if _FENCE.match(_QUOTE.sub("", r))]
    inside = set()
    for a, b in zip(fences[::2], [*fences[1::2], None] if len(fences) % 2 else fences[1::2]):
        inside.update(range(a, (b if b is not None else next((k for k in range(a + 1, len(rows)) if not rows[k].strip() and k + 1 < len(rows) and _prose_row(rows[k + 1])), len(rows) - 1)) + 1))
    return inside


def _prose_row(row: str) -> str | None:
    """A line's prose, or None for a line of another kind."""
    if _LOG.search(row) or _TRACE.search(row) or _TITLE.match(row):
        return None
    bare = _LINK.sub(r"\1 ", row) if _MAYBE_LINK.search(row) else row
    bare = (_NOISE.sub(" ", bare) if _MAYBE_NOISE.search(bare) else bare).strip()
    if _MAYBE_CODE.search(bare):
        marks = len(_CODE_LINE.findall(bare))
        if marks and (marks >= 2 or len(_WORD.findall(bare)) < 6 or not _RUN.search(bare) or _CODE_END.search(bare)):
            return None
        if _STATEMENT.search(bare):
            return None
    first = _WORD.search(bare)
    if not first or (bare[-1:] not in ".!?" and not _WORD.search(bare, first.end())):
        return None
    return _STRONG.sub("", bare) if "*" in bare or "_" in bare or "~" in bare else bare


def is_english(sentences: list[Sentence]) -> bool:
    words, own = sum(len(s.words) for s in sentences), sum(s.own for s in sentences)
    return words > 0 and own >= 0.12 * words and own > 2 * sum(s.other for s in sentences)


def english(sentences: list[Sentence]) -> list[Sentence]:
    """The sentences that are English."""
    return [s for s in sentences if s.own > s.other]


def tokens_of(sentences: list[Sentence]) -> Counter:
    """A document's tokens: its words, and of each sentence its length, its joints and its share of long words."""
    out: list[str] = []
    for s in sentences:
        out += s.words
        out.append(f"#len{min(len(s.words) // 3, 20)}")
        out.append(f"#joint{s.joints}")
        out.append(f"#long{round(10 * len([w for w in s.words if len(w) >= 9]) / len(s.words))}")
    return Counter(out)


_VOWELS = re.compile(r"[aeiouy]+")


@functools.lru_cache(maxsize=200_000)
def _syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    return max(1, n - (word.endswith("e") and not word.endswith("le") and n > 1))


def grade(sentences: list[Sentence]) -> float:
    """The Flesch-Kincaid grade of sentences."""
    words = [w for s in sentences for w in s.words]
    return 0.39 * len(words) / len(sentences) + 11.8 * sum(map(_syllables, words)) / len(words) - 15.59


def grade_ends(medians: dict[int, float]) -> list[float]:
    """Upper ends of the grade for levels 1 to 4: midway between the medians of the labelled levels, those of
    others in line with them; with fewer than two, the ends of the school stages."""
    if len(medians) < 2:
        return list(SCHOOL_ENDS)
    at = sorted(medians)
    line = np.interp(LEVELS, at, [medians[k] for k in at])
    for k, (a, b) in ((0, at[:2]), (1, at[-2:])):
        slope = (medians[b] - medians[a]) / (b - a)
        for i, lv in enumerate(LEVELS):
            if (k == 0 and lv < at[0]) or (k == 1 and lv > at[-1]):
                line[i] = medians[a] + slope * (lv - a)
    line = np.maximum.accumulate(line)
    return [float(x) for x in (line[1:] + line[:-1]) / 2]


@dataclass
class LevelModels:
    """Log probabilities of tokens per level, and log priors; tokens not held have none."""

    tokens: dict[str, int]
    logs: np.ndarray
    prior: np.ndarray

    def posterior(self, counts: Counter) -> np.ndarray:
        known = [(self.tokens[t], n) for t, n in counts.items() if t in self.tokens]
        score = self.prior.copy()
        if known:
            at, n = np.array([k for k, _ in known]), np.array([n for _, n in known], float)
            score += n @ self.logs[at]
        score = np.exp(score - score.max())
        return score / score.sum()


def fit(samples: list[tuple[int, str, float]], documents: dict[int, float], smoothing: float = 0.5, shared: float = 0.02) -> LevelModels:
    """Models from (level, token, count) and documents per level. Each level's model is additively
    smoothed and mixed with a share of the model of all levels."""
    total: Counter = Counter()
    for _, t, n in samples:
        total[t] += n
    tokens = {t: i for i, t in enumerate(sorted(total))}
    counts = np.full((max(1, len(tokens)), len(LEVELS)), smoothing / max(1, len(tokens)) * 10)
    for level, t, n in samples:
        counts[tokens[t], level - 1] += n
    p = counts / counts.sum(axis=0)
    everywhere = counts.sum(axis=1) / counts.sum()
    prior = np.array([documents.get(lv, 0.0) + 1.0 for lv in LEVELS])
    return LevelModels(tokens, np.log((1 - shared) * p + shared * everywhere[:, None]), np.log(prior / prior.sum()))


def _usable(text: str | None) -> list[Sentence] | None:
    if not text or not text.strip():
        return None
    found = prose_of(text)
    if not is_english(found):
        return None
    found = english(found)
    return found if sum(len(s.words) for s in found) >= LEAST_WORDS else None


def _counting(ends: list[float] | None = None):
    """Tokens and their counts of each document, with '' once; of level 0, the formula's level comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, toks, ns = [], [], []
            for level, text in zip(batch.column("level").to_pylist(), batch.column("text").to_pylist()):
                if (found := _usable(text)) is None:
                    continue
                level = level or 1 + int(np.searchsorted(ends, grade(found)))
                counts = tokens_of(found)
                levels += [level] * (len(counts) + 1)
                toks += [*counts, ""]
                ns += [*counts.values(), 1]
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(toks, pa.string()), pa.array(ns, pa.int64())], names=["level", "token", "n"])

    return run


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(lv, grade(found)) for lv, t in zip(batch.column("level").to_pylist(), batch.column("text").to_pylist()) if (found := _usable(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], names=["level", "grade"])


def train(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED) -> LevelModels:
    """Models from labels (doc_id, level), each rater's label counting as one; levels outside 1 to 5 and
    null ones are left out. Training rows are bounded by ``most_labelled``, so are the counts collected.

    Levels with fewer than five labels are seeded from all documents, dealt to levels by a readability
    grade; tokens rarer than a hundred-thousandth of a seeded level's are not held."""
    marks = labels.where(F.col("level").between(1, 5)).select(F.col("doc_id").cast("long").alias("id"), F.col("level").cast("int").alias("level"), F.xxhash64("doc_id", "level").alias("h"))
    marks = stored(marks.orderBy("h").limit(most_labelled), "labels")
    per = {r.level: r.n for r in marks.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(marks.drop("h")), "id").select("level", "text")
    short = [lv for lv in LEVELS if per.get(lv, 0) < LEAST_LABELLED]
    if short:
        rows = stored(rows, "labelled")
    schema = "level int, token string, n bigint"
    counts = rows.mapInArrow(_counting(), schema).groupBy("level", "token").agg(F.sum("n").cast("double").alias("n"))
    if short:
        medians = {r.level: r.m for r in rows.mapInArrow(_graded, "level int, grade double").groupBy("level").agg(F.percentile_approx("grade", 0.5).alias("m")).collect() if r.level not in short}
        every = texts.select(F.lit(0).alias("level"), "text")
        seeds = every.mapInArrow(_counting(grade_ends(medians)), schema).where(F.col("level").isin(short))
        seeds = stored(seeds.groupBy("level", "token").agg(F.sum("n").cast("double").alias("n")), "seeds")
        whole = seeds.where("token <> ''").groupBy("level").agg((F.sum("n") * LEAST_SHARE).alias("floor"))
        seeds = seeds.join(F.broadcast(whole), "level").where("token = '' or n >= floor").select("level", "token", "n")
        counts = counts.union(seeds)
    got = counts.collect()
    held: Counter = Counter()
    for r in got:
        if not r.token:
            held[r.level] += r.n
    return fit([(r.level, r.token, r.n) for r in got if r.token], dict(held))


def reading_levels(documents: DataFrame, models: LevelModels, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, level, confidence, grade, prose_words`` of every row. The level is null, as are
    confidence and grade, for documents without English prose of ten words or more: null, blank, stubs,
    only code or log lines, or in another language. Whole texts are read. Rows repeated give a row each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for s in batch.column("text"):
                found = _usable(s.as_py())
                if found is None:
                    row = (None, None, None, 0)
                else:
                    p = models.posterior(tokens_of(found))
                    row = (int(np.argmax(p)) + 1, float(p.max()), grade(found), sum(len(x.words) for x in found))
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())], names=["doc_id", "level", "confidence", "grade", "prose_words"])

    rows = documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, level int, confidence double, grade double, prose_words int")
