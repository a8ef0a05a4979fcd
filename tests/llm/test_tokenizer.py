import random

import pytest
from hypothesis import given, settings, strategies as st

from memloom.llm.tokenizer import BYTE_BPE_50K, decode_corpus, encode_corpus, load

tokenizers = pytest.importorskip("tokenizers")
library = tokenizers.Tokenizer.from_file(BYTE_BPE_50K)
library.encode_special_tokens = True


def theirs(text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert load(BYTE_BPE_50K).encode(text) == theirs(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aaabcdeit h'sS.-=_ \n\t\r\x1c 　é漢ж0१²"), max_size=80))
def test_text_that_merges_much(text):
    coder = load(BYTE_BPE_50K)
    assert coder.encode(text) == theirs(text) and coder.decode(coder.encode(text)) == text


def test_long_pieces():
    coder, r = load(BYTE_BPE_50K), random.Random(6)
    for text in ["a" * 5000, "<|endoftext|>" * 30, "".join(r.choice("etaoin") for _ in range(3000)), " " * 900 + "x", "-" * 777]:
        assert coder.encode(text) == theirs(text)


def test_corpus(spark):
    rows = [(1, "one <|endoftext|> two", 5), (2, "", 5), (3, None, 5), (4, " \n ", 5), (4, " \n ", 5), (None, "x", 5), (5, "déjà vu " * 4000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode_corpus(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    mine = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(((i, theirs(t) if t else []) for i, t, _ in rows), key=repr)
    back = {r["doc_id"]: r["text"] for r in decode_corpus(got).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode_corpus(df.where("false")).count() == 0
