import base64
import functools
from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import encode as E

PATH = Path(E.TOKENIZER_DIR) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not PATH.exists(), reason="no tokenizer here")


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder():
    return E.Encoder(PATH.read_bytes())


def ids(texts):
    flat, counts = encoder().encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(tokenizer, texts):
    assert ids(texts) == [tokenizer.encode_ordinary(t) for t in texts]


def test_long_and_odd_texts(tokenizer):
    texts = ["a" * 3000, " " * 2000 + "x", "abcab" * 300, "日本語" * 200, "=-" * 700, "<|endoftext|>", "﻿x\r\n\r\n", "ZZ" * 131]
    assert ids(texts) == [tokenizer.encode_ordinary(t) for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "Hello there", "x"), (4, "Hello there", "x")], "doc_id bigint, text string, ids string")
    found = E.encode_corpus(df)
    assert found.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, len(r.ids)) for r in found.collect()) == [(1, 0), (2, 0), (3, 1), (4, 2), (4, 2)]
    assert E.encode_corpus(df.limit(0)).count() == 0


def test_a_vocabulary_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        E.encode_corpus(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
