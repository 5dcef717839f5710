from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.bpe import DEFAULT_VOCABULARY, PATTERN, BytePairEncoder, encode_corpus, read_ranks

tiktoken = pytest.importorskip("tiktoken")
RANKS = read_ranks(DEFAULT_VOCABULARY)
MINE = BytePairEncoder(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_equals_the_library(texts):
    assert [x.tolist() for x in MINE.encode_batch(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900, "<|endoftext|> x", "\r\n \t  x  ", "日本語" * 300, "é́" * 400, " " * 2000, "1234567890" * 100])
def test_long_and_odd(text):
    assert MINE.encode_batch([text])[0].tolist() == THEIRS.encode_ordinary(text)
    assert THEIRS.decode(MINE.encode_batch([text])[0].tolist()) == text


def test_corpus(spark):
    df = spark.createDataFrame([(1, "two words", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "two words", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == [(0, THEIRS.encode_ordinary("a")), (1, THEIRS.encode_ordinary("two words")), (1, THEIRS.encode_ordinary("two words")), (2, []), (3, [])]
    assert encode_corpus(df.where("false")).count() == 0
