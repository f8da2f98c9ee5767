import os

import pytest

from skeinwork.llm.mixing import Mixture, sainte_lague
from skeinwork.llm.tokenize import FOLDER

T = "source string, target_share double, max_repeats int"
D = "doc_id long, text string, source string"


def plain(weights, seats):
    held = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda k: (weights[k] / (2 * held[k] + 1), -k))
        held[i] += 1
    return held


def test_highest_quotients():
    for w, n in (([0.53, 0.24, 0.23], 7), ([5, 3, 1, 1], 100), ([1, 1, 1], 1), ([0.22, 0.18, 0.15, 0.14, 0.11, 0.2], 1234), ([1000, 1], 50)):
        assert sainte_lague(w, n) == plain(w, n)
    assert sainte_lague([1, 1], 10, [2, 100]) == [2, 8]
    assert sainte_lague([1, 1], 10, [2, 3]) == [2, 3]
    assert sainte_lague([], 5) == [] and sainte_lague([0, 0], 5) == [0, 0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabularies here")
def test_shares_and_repeats(spark, frame):
    docs = [(k, f"word{k} of a text number {k} " * (1 + k % 7), ["a", " A", "b", "c", "x", None][k % 6]) for k in range(900)] + [(5000, None, "a"), (5001, "", "b"), (None, "text", "a"), (0, docs0(), "a")]
    m = Mixture(frame(docs, D), frame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 2), (None, 0.5, 1)], T), block=64, shards=8)
    s = {r.source: r for r in m.shares.collect()}
    assert set(s) == {"a", "b", "c", "none"} and s["none"].tokens == 0
    for name, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(s[name].reached_share - want / 0.9) < 0.02
        assert s[name].most_used <= s[name].max_repeats
    rows = m.rows.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {5000, 5001, None} & {r.doc_id for r in rows}
    again = Mixture(frame(docs, D), frame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 2)], T), block=64, shards=8)
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, rows))


def docs0():
    return "word0 of a text number 0 "


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabularies here")
def test_empty(spark, frame):
    m = Mixture(frame([], D), frame([("a", 1.0, 1)], T))
    assert m.rows.count() == 0 and m.shares.first().reached_share == 0
    assert Mixture(frame([(1, "x", "a")], D), frame([], T)).rows.count() == 0
