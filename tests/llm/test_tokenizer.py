import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from traceloom.llm import tokenizer as Q

pytestmark = pytest.mark.skipif(not os.path.exists(Q.TOKENIZER_DIR), reason="no vocabularies")


@pytest.fixture(scope="module")
def encoder():
    return Q.Encoder(Q.vocabulary_bytes())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Q.vocabulary_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=Q.UNIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    e = test_any_text.encoder = getattr(test_any_text, "encoder", None) or Q.Encoder(Q.vocabulary_bytes())
    ids = list(e.encode(text))
    assert b"".join(e.transducer.token[i] for i in ids).decode() == text


def test_same_as_the_library(encoder, known):
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinshrdlu ETAOIN'0123 \n\t.,-_éß漢字😀 ") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "a" * 3000, " " * 500, "ab" * 2000, "don't WE'LL", "﻿x"]
    assert [list(encoder.encode(t)) for t in texts] == [known(t) for t in texts]


def test_lookahead_is_bounded(encoder):
    state, out = encoder.transducer.start, []
    for byte in ("supercalifragilistic" * 40).encode():
        state, made = state.step.get(byte) or encoder.transducer.advance(state, byte)
        out.extend(made)
        assert sum(x is not None for x in state.pending) <= encoder.transducer.longest + 1
        assert max(len(x) for x in state.pending if x is not None) <= 2 * encoder.transducer.longest


def test_streaming_decode(encoder):
    text = "漢字😀é plain 🙂"
    ids = list(encoder.encode(text))
    for chunk in (1, 2, 5):
        d = Q.StreamDecoder(encoder.transducer.token)
        assert "".join(d.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)) + d.feed((), last=True) == text
    d = Q.StreamDecoder({0: b"\xe6\xbc", 1: b"a"})
    assert d.feed([0]) == "" and d.feed([1]) + d.feed([0], last=True) == "�a�"


def test_frame(spark, known):
    rows = [(1, "hello world", 5), (2, "", 5), (3, None, 5), (3, "hello world", 5), (None, " ", 5), (4, "x y " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in Q.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(k, known(t) if t else []) for k, t, _ in rows], key=str)
    assert sorted(str(r.text) for r in Q.decode(Q.encode(df)).collect()) == sorted(t or "" for _, t, _ in rows)
    assert sorted(r.n_tokens for r in Q.token_counts(df, ["doc_id"]).collect()) == sorted(len(i) for _, i in got)
    assert Q.encode(df.limit(0)).collect() == []


def test_states_are_bounded_within_a_unit(monkeypatch):
    encoder = Q.Encoder(Q.vocabulary_bytes())
    texts = ["x" + "abcdefghijklmnopqrstuvwxyz"[k % 26] * (k % 5) + "qzjxkvw" * k for k in range(1, 40)]
    want = [list(encoder.encode(t)) for t in texts]
    monkeypatch.setattr(Q, "STATES_KEPT", 8)
    tight = Q.Encoder(Q.vocabulary_bytes())
    assert [list(tight.encode(t)) for t in texts] == want and len(tight.transducer.states) <= 10
