import os

import pytest

from traceloom.llm import mixing as Q
from traceloom.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.TOKENIZER_DIR), reason="no vocabularies")
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, n_tokens int")


def report(spark, rows, targets, **more):
    return {r.source: r for r in Q.shares(docs(spark, rows), spark.createDataFrame(targets, TARGETS), **more).collect()}


def many(source, n, first):
    return [(first + i, source, "word " * (5 + i % 11)) for i in range(n)]


def test_shares_and_caps(spark):
    rows = many("big", 2000, 0) + many("mid", 700, 10_000) + many("small", 150, 20_000) + many("other", 99, 30_000) + [(40_000, None, "x"), (40_001, "big", None), (40_002, "big", ""), (40_003, "big", "  ")]
    got = report(spark, rows, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("none", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 1)])
    assert set(got) == {"big", "mid", "small", "none", "zero"} and got["none"].n_uses == got["zero"].n_uses == 0
    for s, want in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(got[s].actual_share - want) < 0.01 and got[s].most_uses <= got[s].max_repeats
    assert max(got[s].n_documents / n for s, n in (("big", 2000), ("mid", 700), ("small", 150))) > 0.95  # the tightest source is used up


def test_a_smaller_total(spark):
    got = report(spark, many("a", 1500, 0) + many("b", 1500, 5000), [("a", 0.8, 2), ("b", 0.2, 2)], total=6000)
    assert abs(sum(r.n_tokens for r in got.values()) - 6000) < 100 and abs(got["a"].actual_share - 0.8) < 0.01


def test_mixture_is_repeatable_and_whole(spark):
    t = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 1)], TARGETS)
    d = docs(spark, many("a", 100, 0) + many("b", 300, 500))
    x, y = (sorted(map(tuple, Q.mixture(d, t).collect())) for _ in range(2))
    assert x == y and len({(r[1], r[4]) for r in x}) == len(x)
    parts = [p for p in Q.mixture(d, t).rdd.glom().map(lambda rs: [r.place for r in rs]).collect() if p]
    assert [v for p in parts for v in p] == sorted(v for p in parts for v in p)


def test_nothing(spark):
    assert report(spark, [], [("a", 1.0, 2)])["a"].n_uses == 0
    assert report(spark, many("a", 3, 0), []) == {}
    assert Q.mixture(docs(spark, many("a", 3, 0)), spark.createDataFrame([], TARGETS)).count() == 0


def test_equal_documents_and_one_document(spark):
    got = report(spark, [(1, "a", "same text")] * 5 + [(2, "b", "same text")], [("a", 0.5, 1), ("b", 0.5, 3)])
    assert got["a"].most_uses <= 1 and got["b"].n_uses <= 3
