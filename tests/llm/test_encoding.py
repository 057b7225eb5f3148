from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import encoding as E

TOKENS = E.read_ranks(E.TOKENIZERS, "byte_bpe_50k")
ENCODER = E.Encoder(E.serialise_model(TOKENS), E.read_pattern(E.TOKENIZERS))


@pytest.fixture(scope="module")
def official():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


HARD = ["", "a", " ", "\n\n  \t", "<|endoftext|>", "it's we'll I'D", "naïve Ångström ﬁ Ⅷ", "你好，世界 こんにちは", "👩‍💻🧾🇮🇸", "\x00\x01\x7f", "x" * 5000, "ab " * 3000, "1234567890" * 50, "﻿BOM", "á" * 40]


@pytest.mark.parametrize("text", HARD)
def test_same_ids_and_round_trip(official, text):
    (ids,) = ENCODER.encode_batch([text])
    assert ids == official(text)
    assert E.decode(ids, TOKENS) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = getattr(test_any_text, "_t", None) or Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    test_any_text._t = t
    t.encode_special_tokens = True
    assert ENCODER.encode_batch(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "CACHE_SIZE", 10)
    e = E.Encoder(E.serialise_model(TOKENS), E.read_pattern(E.TOKENIZERS))
    texts = [" ".join(f"w{i}{j}" for j in range(20)) for i in range(5)]
    got = [e.encode_batch([t])[0] for t in texts]
    assert got == ENCODER.encode_batch(texts) and len(e.known) <= 10


def test_nulls_repeats_and_further_columns(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in E.encode_corpus(df).collect())
    assert got[:2] == [(1, ()), (2, ())] and got[2] == got[3] and len(got[3][1]) == 2
    assert E.encode_corpus(df.where("false")).count() == 0
