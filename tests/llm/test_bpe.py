import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from vitrine.llm import bpe, queries

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["ab", "c", "", "\n", "a\n", "\nb", "  x", "!?", "\x1c", "\u00a0", "'s", "12"]), max_size=12).map(" ".join))
def test_as_the_library_encodes(encoder, library, text):
    assert ids(encoder, text) == library.encode_ordinary(text)
    assert encoder.decode(np.array(ids(encoder, text), np.int64)) == text.encode()


def test_very_long_pretokens(encoder, library):
    draw = random.Random(1)
    for text in ("a" * 30_000, "".join(draw.choice("abcdefgh") for _ in range(50_000)), " " * 5_000 + "x"):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_memory_of_words_has_a_bound(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{k % 37} x{k}" for k in range(500))
    assert ids(small, text) == library.encode_ordinary(text)
    assert len(small.memo) <= 10 and len(small.older) <= 10 and len(small.known) <= 10


def test_round_trip_of_every_row(spark, library):
    rows = cases.texts()
    docs = cases.clashing(cases.documents(spark, rows))
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text in rows:
        own = library.encode_ordinary(text or "")
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode(spark):
    docs = cases.documents(spark)
    tokens = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(tokens, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {(i, (t or "").encode()) for i, t in cases.texts()}


def test_empty_table(spark):
    assert bpe.round_trip(cases.documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
