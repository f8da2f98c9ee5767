import os

import pytest

from skeinwork.llm.tokenize import FOLDER, PATTERN, decode_corpus, encode_corpus, token_counts

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabularies here")
TEXTS = ["", None, " ", "Hello  world\n\n", "<|endoftext|> is text", "it's 日本語 a​b 😀😀", "x" * 5000, "\r\n\t  \x1c z", "naïve ﬁne ½ ²", "same", "same", "a" * 100 + " " * 3000 + "b", "퟿�"]


@pytest.fixture(scope="module")
def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_pattern_is_the_public_one():
    public = pytest.importorskip("public_tokenizers")
    assert public.PATTERN == PATTERN


def test_ids_and_round_trip(spark, frame, expected):
    docs = frame(list(enumerate(TEXTS)) + [(0, "")], "doc_id long, text string", "ids string, words string, block string, pos int, piece string")
    ids = encode_corpus(docs)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert ids.count() == len(TEXTS) + 1 and [got[k] for k in range(len(TEXTS))] == expected
    back = {r.doc_id: r.text for r in decode_corpus(ids).collect()}
    assert [back[k] for k in range(len(TEXTS))] == [x or "" for x in TEXTS]
    assert {r.doc_id: r.tokens for r in token_counts(docs).collect()}[4] == len(expected[4])


def test_empty_and_blocks(spark, frame, monkeypatch, expected):
    import skeinwork.llm.tokenize as tk

    assert encode_corpus(frame([], "doc_id long, text string")).count() == 0
    assert decode_corpus(encode_corpus(frame([], "doc_id long, text string"))).count() == 0
    monkeypatch.setattr(tk, "BLOCK_CHARS", 10)
    got = {r.doc_id: list(r.ids) for r in encode_corpus(frame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected
