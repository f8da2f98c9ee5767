import random
from collections import Counter

from skeinwork.llm.reading import LevelModels, fit, grade_ends, is_english, prose_of, reading_levels, tokens_of, train

EASY = ["The cat sat on the mat.", "We can see the dog now.", "It is a big red box.", "Do not drop the cup."]
HARD = ["Notwithstanding that the infrastructure presupposes the serialization of every configuration, the orchestration substantiates its representation, which the authorization subsequently invalidates.", "Inasmuch as the reconciliation of the heterogeneous representation necessitates authentication, the dependability of the architecture characterizes the implementation that it encapsulates."]


def test_prose_only():
    t = "# Title of it\n\nuser: The team reads the log.\n\n```python\nx = call(y)\n```\n\n| a | b |\n|---|---|\n\n    at f (src/a.ts:1:2)\n2026-01-01T00:00:00Z INFO [x] the log line is not prose\n- `some_name`\n* One path keeps, and the other stops.\n\nThe first half of a line\nthat is wrapped goes on here."
    assert [" ".join(s.words) for s in prose_of(t)] == ["the team reads the log", "one path keeps and the other stops", "the first half of a line that is wrapped goes on here"]
    assert not is_english(prose_of("Der Bericht prüft den Fehler. Jeder Plan liest den Befehl und wartet danach."))
    assert is_english(prose_of("The plan reads the order and it waits for the end."))


def labelled(seed=0, n=60):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        hard = k % 2
        docs.append((k, " ".join(r.choices(HARD if hard else EASY, k=4 if not hard else 2))))
        labels.append((k, 5 if hard else 1))
    return docs, labels


def test_held_out_accuracy(spark, frame):
    docs, labels = labelled()
    test, _ = labelled(7)
    models = train(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, level int"))
    got = {r.doc_id: r.level for r in reading_levels(frame(test, "doc_id long, text string"), models).collect()}
    assert sum((got[k] >= 4) == bool(k % 2) for k in got) >= 0.95 * len(got)


def test_edges(spark, frame):
    docs, labels = labelled()
    odd = [(100, None), (101, ""), (102, " \n"), (103, "wip"), (104, "x = 1;\ny = f(x);\n" * 30), (105, "Der Bericht prüft den Fehler. " * 9), (None, " ".join(EASY)), (107, " ".join(EASY * 20_000)), (108, "まず予算を確認する。" * 30), (109, "```\nopen fence")]
    models = train(frame(docs, "doc_id long, text string"), frame(labels + [(0, None), (1, 9), (None, 2), (12345, 3)], "doc_id long, level int"))
    got = {r.doc_id: r.level for r in reading_levels(frame(odd, "doc_id long, text string"), models).collect()}
    assert {k for k, v in got.items() if v is None} == {100, 101, 102, 103, 104, 105, 108, 109} and got[None] is not None and got[107] is not None
    assert reading_levels(frame([], "doc_id long, text string"), models).count() == 0


def test_without_labels_the_formula_seeds(spark, frame):
    docs, _ = labelled()
    models = train(frame(docs, "doc_id long, text string"), frame([], "doc_id long, level int"))
    assert isinstance(models, LevelModels)
    got = {r.doc_id: r.level for r in reading_levels(frame(docs, "doc_id long, text string"), models).collect()}
    assert all(got[k] >= 4 for k in got if k % 2) and all(got[k] <= 2 for k in got if not k % 2)
    assert train(frame([], "doc_id long, text string"), frame([], "doc_id long, level int")).posterior(Counter(a=1)).sum() > 0.99


def test_models():
    m = fit([(1, "a", 5.0), (5, "b", 5.0)], {1: 2, 5: 2})
    assert m.posterior(Counter(a=3)).argmax() == 0 and m.posterior(Counter(b=3)).argmax() == 4
    assert tokens_of(prose_of("The cat, then, sat."))["the"] == 1


def test_ends_of_grades():
    assert grade_ends({1: 0.0, 3: 4.0, 5: 8.0}) == [1.0, 3.0, 5.0, 7.0]
    assert grade_ends({2: 2.0, 4: 6.0}) == [1.0, 3.0, 5.0, 7.0]
    assert grade_ends({2: 2.0}) == [5.0, 8.0, 12.0, 16.0]


def test_no_token_is_dropped(spark, frame):
    docs = [(k, " ".join(f"word{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)} the" for j in range(200)) + ".") for k in range(30)]
    models = train(frame(docs, "doc_id long, text string"), frame([(k, 1 + k % 5) for k in range(30)], "doc_id long, level int"))
    assert sum(t.startswith("word") for t in models.tokens) == 26 * 200
