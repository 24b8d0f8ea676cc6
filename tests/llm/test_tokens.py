import os

import pytest
from graphquarry.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st

if not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.json"):
    pytest.skip("no vocabularies", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "\n\n\t x", "Hello world's  end", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "été ﬁle 索引已重建 ดัชนี \u200b\ufeff 👩‍👩‍👧", "ab" * 1000 + "=-" * 500, "0123456789" * 30])
def test_known_texts(reference, text):
    assert bpe.encoder().encode(text) == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    assert bpe.encoder().encode(text) == reference(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeinrst ", max_size=80))
def test_other_vocabulary(text):
    import base64

    import tiktoken

    lines = open(f"{bpe.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    enc = tiktoken.Encoding("t", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert bpe.encoder("byte_bpe_multi_50k").encode(text) == enc.encode_ordinary(text)


def test_round_trip():
    e = bpe.encoder()
    text = "def f(x):\n    return x  # naïve\r\n"
    assert "".join(e.text[i] for i in e.encode(text)).encode("latin-1").decode() == text


def test_documents(spark, reference):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hi there", "c"), (3, "Hi there", "c")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_documents(df).collect())
    assert got == [(1, []), (2, []), (3, reference("Hi there")), (3, reference("Hi there"))]
    assert bpe.encode_documents(df.filter("false")).count() == 0
