import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm.splitting import cut_points, split_oversized, split_pieces

SCHEMA = "id string, file_path string, start_line int, content string, symbol_name string"


def text_of(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(["def x():\n", "    y = 1\n", "\n", "A sentence here. ", "word ", "}\n"]) for _ in range(n))


def valid(text, limit=2000, overlap=200):
    ps = split_pieces(text)
    assert "".join(p[1][p[4] :] for p in ps) == text
    assert all(len(p[1]) <= limit and 0 <= p[4] <= overlap for p in ps)
    for a, b in zip(ps, ps[1:]):
        assert a[1].endswith(b[1][: b[4]])
    return ps


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n\r\té́}。", min_size=0, max_size=6000))
def test_any_text_comes_back(text):
    valid(text)


def test_hard_cases():
    for t in ["x" * 7001, "\r\n" * 3000, "é" * 4500, "́" * 4001, "😀" * 2500, "word " * 2000]:
        ps = valid(t)
        assert all(not (p[1].startswith("\n") and t.startswith("\r\n")) for p in ps)


def test_lines_are_those_of_the_content():
    t = text_of(2000)
    for _, piece, top, last, _ in split_pieces(t, 10):
        at = t.index(piece)
        assert top == 10 + t[:at].count("\n")
        assert last == 10 + t[: at + len(piece) - 1].count("\n")


def test_cuts_fall_between_lines():
    t = text_of(3000, 1)
    ends = [e for _, _, e in cut_points(t)][:-1]
    assert sum(t[e - 1] == "\n" for e in ends) > 0.9 * len(ends)


def test_an_edit_changes_few_pieces():
    t = text_of(8000, 2)
    a, b = {p[1] for p in split_pieces(t)}, {p[1] for p in split_pieces(t[:20000] + "A new line.\n" + t[20000:])}
    assert len(b - a) <= 4 and len(a) > 30


def test_operator_edges(spark, frame):
    long = text_of(600, 3)
    rows = [("a", "p", 5, long, "s"), ("a", "p", 5, long, "s"), ("b", None, None, long, None), (None, "p", 1, long, "s"), ("c", "p", 1, None, "s"), ("d", "p", 1, "", "s"), ("e", "p", 1, "x" * 2000, "s")]
    got = split_oversized(frame(rows, SCHEMA)).collect()
    assert {r.id for r in got} == {"a", "b", None}
    mine = sorted((r.piece, r.content, r.overlap, r.start_line) for r in got if r.id == "a")
    assert "".join(c[o:] for _, c, o, _ in mine) == long and mine[0][3] == 5
    assert min(r.start_line for r in got if r.id == "b") == 1
    assert split_oversized(frame([], SCHEMA)).count() == 0


def test_very_long_text(spark, frame):
    t = "lorem ipsum dolor\n" * 60_000
    got = split_oversized(frame([("a", "p", 1, t, None)], SCHEMA)).collect()
    assert sum(len(r.content) - r.overlap for r in got) == len(t)
