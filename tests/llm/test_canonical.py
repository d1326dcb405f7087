import random
from datetime import datetime as D

import pytest

from traceloom.llm import canonical as Q

CATALOG = [(1, "method", "modular hazard forecasting", "MHF"), (2, "method", "formal hazard audit", "FHA"), (3, "method", "layered budget knockout trial", "LBK"), (11, "tag", "thermal policy", None), (12, "tag", "degradation baseline", None), (13, "tag", "thermal policy", None)]
T1, T2 = D(2024, 1, 1), D(2024, 2, 1)
PRODUCT = "wp_key long, methods_used array<string>, tags_addressed array<string>, loaded_at timestamp_ntz, value string, kind string, entry_id int"


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_is_right_and_a_metric():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    d = {(a, b): Q.levenshtein(a, b) for a in words for b in words}
    assert all(v == slow(a, b) for (a, b), v in d.items())
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in words[:20] for b in words[:20] for c in words[:20])
    assert Q.edits("hybrdi", "hybrid") == 1


def test_tree_returns_every_entry_within():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(300)})
    tree = Q.BkTree()
    for w in words:
        tree.add(w, w)
    for q in words[::17] + ["abcabc", "zzzz"]:
        for most in (0, 1, 2, 3):
            assert sorted(t for _, t, _ in tree.within(q, most)) == [w for w in words if slow(q, w) <= most]


@pytest.mark.parametrize("value, want", [
    ("Modular Hazard Forecasting", 1), ("modularhazardforecasting", 1), ("ModularHazardForecasting", 1), ("modula rhazyrd forecasting", 1), ("hazard forecasting, modular", 1), ("forecasting of modular hazard", 1), ("modul. hazard forecasting", 1), ("modular_hazard / forecastings ", 1),
    ("MHF", 1), ("mhf", 1), ("M.H.F.", 1), ("MHF (full)", 1), ("MHF rev 2", 1), ("MHF - system level", 1), ("MHF (modular hazard forecasting)", 1), ("1) formal hazard audit", 2), ("manual formal hazard audit", 2), ("formal hazard audit, partly", 2), ("formal hazard audit (see annex)", 2), ("formal hazard audit - per plan", 2),
    ("Layered Budget Knockuot Trial ;", 3), ("tbd", 0), ("-", 0), ("???", 0), ("formal postcard photo set", 0), ("formal budget", 0), ("see sheet 4", 0), ("漢字", 0), ("x" * 100_000, 0), ("thermal policy", 0),
])
def test_values(value, want):
    assert Q.Matcher([(i, n, s) for i, k, n, s in CATALOG if k == "method"]).match(value)[-1] == want


def run(spark, products, catalog=None, **more):
    c = spark.createDataFrame(CATALOG if catalog is None else catalog, "entry_id long, kind string, name string, short_name string")
    p = spark.createDataFrame([(*r, "v", "k", 1) for r in products], PRODUCT)
    return sorted(tuple(r) for r in Q.mapped_values(p, c).select("wp_key", "field_name", "pos", "entry_id").collect())


def test_frame(spark):
    rows = [(1, [None, "modular hazard forecasting", " MHF", "", " "], ["#label", " #label", "Thermal Policy", "tbd"], T1), (1, ["other"], None, T2), (2, None, [], T1)]
    assert run(spark, rows) == [(1, "methods_used", 3, 1), (1, "tags_addressed", 3, 11), (1, "tags_addressed", 4, 0)]
    assert run(spark, []) == [] and run(spark, [(1, ["a"], None, T1)], catalog=[]) == [(1, "methods_used", 1, 0)]


def test_shards_agree(spark, monkeypatch):
    rows = [(1, ["Modular hazard forecasting", "FHA", "layered budgt knockout trial", "nothing"], ["thermal polici", "degradation base line"], T1)]
    one = run(spark, rows)
    monkeypatch.setattr(Q, "SHARD_ENTRIES", 2)
    assert run(spark, rows) == one and [r[3] for r in one] == [1, 2, 3, 0, 11, 12]


def test_no_length_ends_the_search(spark):
    long = "fault tree analysis of the " + " ".join(f"part{i}" for i in range(60))
    m = Q.Matcher([(1, "Fault tree analysis", None), (2, long, None)])
    assert m.match(f"Fault tree analysis ({'x' * 1040})")[-1] == 1 and m.match(f"Fault tre analysis ({'note ' * 900})")[-1] == 1
    assert m.match(long.upper())[-1] == 2 and m.match(long.replace("part7", "prat7"))[-1] == 2 and m.match("y" * 3000)[-1] == 0


def test_shards_agree_on_short_names_and_ties(spark, monkeypatch):
    catalog = [(i, "method", n, s) for i, n, s in ((9, "gate check", "GC"), (4, "gate cheek", None), (2, "grand circuit", "GC"), (7, "gate check", None), (1, "gc", None), (5, "gated checking plan", None), (6, "gated checks plan", "GCP"))]
    rows = [(k, [v], None, T1) for k, v in enumerate(("GC", "gc", "gate chexk", "Gate check", "gat. check. plan", "g. c.", "gate chck rev 2", "GCP (all)", "plan, gated checking", "nothing"))]
    one = run(spark, rows, catalog)
    for size in (1, 2, 3):
        monkeypatch.setattr(Q, "SHARD_ENTRIES", size)
        assert run(spark, rows, catalog) == one
    assert dict((r[0], r[3]) for r in one)[0] == 2 and dict((r[0], r[3]) for r in one)[4] == 5
