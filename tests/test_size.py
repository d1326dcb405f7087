"""Work that grows with the pairs of a standard stays where it is done: rows travel, pairs don't."""

import math
import re
from collections import Counter

from traceloom.operators import layers as L
from traceloom.operators import requirements as R
from traceloom.operators import similarity as S
from traceloom.plans import compliance as C
from traceloom.session import SHUFFLES_GO, stored

WORDS = ["brake", "lamp", "duct", "valve", "pump", "wheel", "shaft", "gear", "fuse", "relay"]


def exchanges(df):
    return re.findall(r"hashpartitioning\((.*?)\)", df._jdf.queryExecution().executedPlan().toString())


def test_cosines_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "DOCUMENTS", 8, raising=False)
    monkeypatch.setattr(S, "DENSE", 30, raising=False)
    rng = __import__("random").Random(5)
    text = lambda words: " ".join(rng.choices(words, k=rng.randint(0, 9)))
    arts = [("s" if i % 5 else "t", i, text(WORDS[:8])) for i in range(60)] + [(None, 60, "lamp"), ("u", 61, "lamp")]
    nodes = [("s" if i % 4 else "t", i, text(WORDS)) for i in range(50)] + [(None, 50, "lamp"), ("v", 51, "lamp"), ("s", 52, "qqqq zzzz"), ("s", 53, None)]
    found = S.alignment(spark.createDataFrame(nodes, "std string, node_ord long, node_text string"), spark.createDataFrame(arts, "std string, art_ord long, full_text string"))
    assert not [x for x in exchanges(found) if "term" in x or "art_ord" in x]

    def unit(words, idf):
        c, n = Counter(words), len(words)
        w = {t: k / n * idf.get(t, 1.0) for t, k in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length if length else 0.0 for t, x in w.items()}

    got = {r.node_ord: r.sim for r in found.collect()}
    assert len(got) == len(nodes)
    for std, key, words in nodes:
        own = [a[2].split() for a in arts if a[0] == std and std]
        idf = {t: math.log(len(own) / (1 + sum(t in a for a in own))) for t in WORDS if any(t in a for a in own)}
        x = unit((words or "").split(), idf)
        best = max([sum(x.get(t, 0.0) * w for t, w in unit(a, idf).items()) for a in own], default=0.0)
        assert abs(got[key] - max(best, 0.0)) < 1e-12, key


def test_words_of_texts_stay_with_them(spark, monkeypatch):
    monkeypatch.setattr(S, "DOCUMENTS", 4, raising=False)
    rng = __import__("random").Random(7)
    arts = spark.createDataFrame([("s", i, " ".join(rng.choices(["Brakes", "lamp-duct", "a1b2", "x"], k=2))) for i in range(20)] + [("s", 20, ""), (None, 21, "lamp"), ("u", 22, "lamp")], "std string, art_ord long, full_text string")
    nodes = spark.createDataFrame([("s", 1, "brake lamp"), ("s", 2, "brake pump gear"), ("v", 3, "lamp"), (None, 4, "lamp"), ("s", 5, "of"), ("s", 6, "pump"), ("u", 7, "lamp")], "std string, node_ord long, node_text string")
    shares = S.containment(nodes, arts)
    assert not [x for x in exchanges(shares) if "word" in x]
    assert {r.node_ord: round(r.share, 9) for r in shares.collect()} == {1: 1.0, 2: round(1 / 3, 9), 3: 0.0, 4: 0.0, 6: 0.0, 7: 1.0}
    phrases = spark.createDataFrame([("s", "Lamp-D"), ("s", "pump"), ("v", "lamp"), (None, "lamp"), ("u", "AM")], "std string, p string")
    hits = L.text_hits(phrases, arts, "p")
    assert not [x for x in exchanges(hits) if "word" in x or "gram" in x]
    assert {(r.std, r.p) for r in hits.collect()} == {("s", "Lamp-D"), ("u", "AM")}


def test_rows_of_single_keys_stay(spark):
    rows = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (2, "only", None), (None, "none", 1), (3, "undated", None), (3, "dated", 9)], "k long, v string, loaded_at int")
    kept = {(1, "early"), (2, "only"), (3, "dated")}
    assert {(r.k, r.v) for r in R.first_delivery(rows, "k").collect()} == kept
    for most in (10, 1):  # few repeated keys; more than are sent to every executor
        assert sorted((r.k, r.v) for r in R.few_repeats(rows, "k", most=most).collect()) == sorted(kept)


def test_layers_do_not_fill_the_driver(spark, data, monkeypatch):
    running, most = set(), []

    def counted(df, name):
        running.add(name)
        most.append(len(running))
        try:
            return stored(df, name)
        finally:
            running.discard(name)

    monkeypatch.setattr(C, "stored", counted)
    m = C.Model(spark, data, fuzzy=False)
    findings = m.findings()
    assert max(most) == 1 and len(most) == 2 + len(m.layers())
    assert "InMemory" not in findings._jdf.queryExecution().optimizedPlan().toString()
    matrix = C.QUERIES["compliance_matrix_exact"](spark, data)
    assert "InMemory" not in matrix._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_go_when_a_table_is_written(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, set_to = shuffles(), spark.conf.get(SHUFFLES_GO)
    kept = stored(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    assert shuffles() <= before and spark.conf.get(SHUFFLES_GO) == set_to
    assert {r["count"] for r in kept.collect()} == {14, 15}


def test_findings_stop_rating_at_enough(spark, data, monkeypatch):
    rng = __import__("random").Random(11)
    text = lambda: " ".join(rng.choices([*WORDS, "q" * 30, "z" * 40], k=rng.randint(0, 6)))
    n = spark.createDataFrame([("s", i, text()) for i in range(40)] + [("t", 40, "x")], "std string, node_ord long, text string")
    a = spark.createDataFrame([("s", i, text()) for i in range(60)], "std string, art_ord long, full_text string")
    best = {r.node_ord: r.ratio for r in S.best_ratio(n, a).collect()}
    for enough in (0.0, 0.5, 0.9):
        got = {r.node_ord: r.ratio for r in S.best_ratio(n, a, enough=enough).collect()}
        assert got.keys() == best.keys() and all(got[k] == b if b < enough else enough <= got[k] <= b for k, b in best.items())
        assert enough > 0.5 or got != best
    asked = []
    monkeypatch.setattr(S, "best_ratio", lambda reqs, arts, enough=None: asked.append(enough) or reqs.select("std", "node_ord", L.F.lit(1.0).alias("ratio")))
    m = C.Model(spark, data)
    m.findings(), m.gaps()
    assert asked == [L.LOW_RATIO]
    m.scores(), m.findings()  # scores need all ratios, once
    assert asked == [L.LOW_RATIO, None]


def test_scores_take_one_aggregation(spark, data):
    m = C.Model(spark, data, fuzzy=False)
    scores = m.scores()
    assert "Join" not in scores._jdf.queryExecution().optimizedPlan().toString()
    t, stds = m.layers(), m.stds()
    traces = L.trace_score(t["traceability_chain"])
    apart = {"node_coverage": L.coverage_score(t["node_coverage"]), "content_alignment": L.mean_score(t["content_alignment"], "sim"), "concept_coverage": L.concept_score(t["concept_coverage"]), "reference_integrity": L.reference_score(t["reference_integrity"]), "method_audit": L.method_score(t["method_audit"]), "traceability_chain": traces}
    wanted = {(r.std, n, r.score) for n, p in apart.items() for r in L.scored(stds, p, 100.0 if n == "method_audit" else 0.0).collect()}
    assert {(r.std, r.layer, r.score) for r in scores.collect()} == wanted


def test_scores_of_standards_with_nothing(spark):
    rows = lambda *xs: spark.createDataFrame(xs, "std string, points double")
    stds = spark.createDataFrame([("s",), ("s",), ("t",), (None,)], "std string")
    got = {(r.std, r.layer): r.score for r in L.layer_scores(stds, {"method_audit": rows(("s", 1.0), ("s", 0.0), ("s", 0.0), ("u", 1.0), (None, 0.5)), "content_alignment": rows(("t", 0.12345))}).collect()}
    assert got == {("s", "method_audit"): 33.3, ("t", "method_audit"): 100.0, (None, "method_audit"): 100.0, ("s", "content_alignment"): 0.0, ("t", "content_alignment"): 12.3, (None, "content_alignment"): 0.0}
