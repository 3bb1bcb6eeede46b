import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kvern.llm import tokens

VOCABULARY = os.environ.get("KVERN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

TEXTS = [
    None, "", " ", "  \n\t ", "Hello world", "we're  it's 'S 's x's''s", "Blåbærsyltetøy på 1 234,50 kr!", "<|endoftext|> as text", "日本語の案内 🙂🏗️ مرحبا",
    "a b c​d﻿", "\u0085x y", "é ạ́ Å", "\U0001e900\U00016e40 \U0002ebf0 new", "½ ²3 Ⅳ １２３", "x" * 5000, "end  ", "\r\n\r\n", "tab\there",
]


def direct(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def encoded(spark, texts):
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, block int")
    return tokens.encode_corpus(frame, VOCABULARY)


def test_ids_are_those_of_the_tokenizer(spark):
    texts = TEXTS + [" ".join(f"ord{i % 97}" for i in range(200_000))]
    got = {r.doc_id: r.ids for r in encoded(spark, texts).collect()}
    assert got == dict(enumerate(direct(texts)))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=40, max_size=80))
def test_any_text(spark, texts):
    got = {r.doc_id: r.ids for r in encoded(spark, texts).collect()}
    assert got == dict(enumerate(direct(texts)))


def test_decoding_gives_the_text_back(spark):
    out = tokens.decode_corpus(encoded(spark, TEXTS), VOCABULARY).collect()
    assert {r.doc_id: r.text for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_no_rows_and_copies(spark):
    assert encoded(spark, []).count() == 0
    out = encoded(spark, ["same text here"] * 300).collect()
    assert len(out) == 300 and {tuple(r.ids) for r in out} == {tuple(direct(["same text here"])[0])}
