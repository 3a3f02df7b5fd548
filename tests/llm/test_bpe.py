import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import bpe as B

DATA = open(B.VOCABULARY, "rb").read()
ENCODER = B.Encoder(B.parse_ranks(DATA))
REFERENCE = tiktoken.Encoding("own", pat_str=B.PRE_TOKEN, mergeable_ranks=B.parse_ranks(DATA), special_tokens={})


def ours(text):
    return np.frombuffer(ENCODER.encode(text), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'sdtab0123가각 　")), max_size=80))
def test_same_ids_as_the_public_library(text):
    assert ours(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["aaaaaaa" * 500, "ab" * 3000, "가나다라" * 2000, "x" * 20_000, "   lead", "trail   ", "a  b   c", "don't we'll", "<|endoftext|>", "tab\t\tnew\n\n x", " "])
def test_long_and_odd_texts(text):
    assert ours(text) == REFERENCE.encode_ordinary(text)


def test_leaves_are_clean_after_each_word():
    ENCODER.merge("überraschend".encode())
    assert not any(ENCODER.leaves)


def test_table(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (4, "끝 " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    out = [(r["doc_id"], r["ids"]) for r in B.encode_texts(df).collect()]
    assert sorted(out, key=lambda r: r[0])[:4] == [(1, REFERENCE.encode_ordinary("Hello world"))] * 2 + [(2, []), (3, [])]
    assert dict(out)[4] == REFERENCE.encode_ordinary(rows[4][1])
    assert B.encode_texts(df.limit(0)).count() == 0


def test_more_ranks_than_one_word_per_leaf_holds():
    with open(B.VOCABULARY, "rb") as file:
        ranks = B.parse_ranks(file.read())
    small, large = B.Encoder(ranks), B.Encoder({token: 3 * rank for token, rank in ranks.items()})
    for text in ("Die Wartung der Anlage", "한국어 문장입니다", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 9):
        assert (3 * np.frombuffer(small.encode(text), "<i4")).tolist() == np.frombuffer(large.encode(text), "<i4").tolist()
