"""The encoder against another implementation of the same vocabulary, and exact round trips."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.load())


@pytest.fixture(scope="module")
def other(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.tables.tokens)}, special_tokens={})


_TEXTS = st.one_of(st.text(max_size=80), st.text(alphabet="aeinrst' \n\r\tABé漢हि=-_0123.,", max_size=120), st.text(alphabet="ab", max_size=60), st.text(alphabet=" \n\t 　\x1c\x85x", max_size=40))


@settings(max_examples=400, deadline=None)
@given(_TEXTS)
def test_equals_merging(encoder, other, text):
    ids = list(encoder.encode(text))
    assert ids == other.encode_ordinary(text)
    assert encoder.decode(ids) == text


def test_every_token_stands_for_itself(encoder):
    assert all(encoder.tables.reachable)
    rnd = random.Random(1)
    for i in rnd.sample(range(len(encoder.tables.tokens)), 2000):
        s = encoder.tables.tokens[i].decode("latin-1")
        text = encoder.tables.tokens[i].decode(errors="ignore")
        if text.encode().decode("latin-1") == s and len(encoder.cut(text)) == 1:
            assert encoder.piece(text) == (i,)


def test_long_pieces_take_linear_time(encoder, other):
    for text in ("a" * 200_000, "ab" * 100_000, "-=" * 50_000, "9" * 100_000, "漢" * 50_000):
        assert encoder.decode(list(encoder.encode(text))) == text
    text = "".join(random.Random(3).choices("abcdefgh", k=20_000))
    assert list(encoder.encode(text)) == other.encode_ordinary(text)


def test_special_strings_are_text(encoder):
    ids = list(encoder.encode("a<|endoftext|>b"))
    assert max(ids) < len(encoder.tables.tokens) and encoder.decode(ids) == "a<|endoftext|>b"


def test_frames(spark, encoder):
    rows = [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "é\r\n" * 20_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids", "0 as n_tokens")
    got = T.token_ids(df, ["doc_id"], "text").collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, list(encoder.encode(t))) for i, t in rows)
    counts = T.token_counts(df, ["doc_id"], "text").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counts) == sorted((i or 0, len(list(encoder.encode(t)))) for i, t in rows)
    back = T.decoded(T.token_ids(df, ["doc_id"], "text"), ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert T.token_ids(df.limit(0), ["doc_id"], "text").collect() == []


def test_batches_are_split(spark, monkeypatch):
    monkeypatch.setattr(T, "BATCH_TOKENS", 10)
    df = spark.createDataFrame([(n, "one two three four five " * (n % 4)) for n in range(50)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: len(r.ids) for r in T.token_ids(df, ["doc_id"], "text").collect()}.keys() == set(range(50))


def test_white_space_is_that_of_the_pattern(encoder, other):
    rnd = random.Random(9)
    for alphabet in ("a1 '\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f.s\x00", "a1 '\n\x1d\x85\xa0 ᠎ ​ 　﻿.é"):
        for _ in range(5000):
            text = "".join(rnd.choices(alphabet, k=rnd.randint(1, 30)))
            assert list(encoder.encode(text)) == other.encode_ordinary(text), repr(text)
