"""The whole model against brute force over a few rows."""

from datetime import datetime
from difflib import SequenceMatcher

import pytest

from traceloom.operators import layers as L
from traceloom.plans import compliance as C
from traceloom.plans.compliance import QUERIES

STD, T = "STD-0000001", datetime(2024, 1, 1)
CLAUSE = "clause_key long, standard_id string, part string, section string, title string, type string, text string, tags array<string>, notes array<string>, asil_level string, cross_references array<string>, loaded_at timestamp_ntz"
PRODUCT = "wp_key long, id string, project_id string, standard_id string, title string, mapped_sections array<string>, status string, content string, tags_addressed array<string>, methods_used array<string>, traceability_links array<struct<`from`:string,`to`:string,type:string>>, loaded_at timestamp_ntz"
CLAUSES = [
    (1, STD, "3", "5.1", "Braking safety goals", "requirement", "The wheel unit shall brake.", None, None, None, ["part_3:7.2"], T),
    (2, STD, "3", "6.1", "Zzz", "requirement", "qqqq jjjj xxxx zzzz", None, None, None, None, T),
]
PRODUCTS = [
    (11, "WP-1", "P", STD, "Braking safety goal", ["9.9"], "final", "Our notes on oil, ducts and lamps.", None, ["fault tre analisis"], None, T),
    (12, "WP-2", "P", STD, "Lamp", ["7.2"], "final", "A lamp is lit.", None, None, None, T),
    (13, "WP-3", "P", STD, "Pump", ["5"], "final", "A pump is dry.", None, None, None, T),
]
METHODS = [(1, "method", "fault tree analysis"), (8, "method", "xylophone"), (2, "method", "lamp is lit"), (3, "method", "hazard review"), (4, "tag", "no method")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(CLAUSES, CLAUSE).write.parquet(f"{d}/part_3_concept.parquet")
    spark.createDataFrame([], CLAUSE).write.parquet(f"{d}/part_4_system.parquet")
    spark.createDataFrame(PRODUCTS, PRODUCT).write.parquet(f"{d}/sample_user_doc_v2.parquet")
    spark.createDataFrame(METHODS, "entry_id long, kind string, name string").write.parquet(f"{d}/term_catalog.parquet")
    return str(d)


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_titles_and_texts_are_rated(spark, small):
    found = {(r.type, r.node_id) for r in C.Model(spark, small).findings().collect()}
    for c in CLAUSES:
        near = any(ratio(c[4], p[4]) > 0.6 for p in PRODUCTS)
        assert (("PARTIAL_COVERAGE" if near else "MISSING_COVERAGE"), c[3]) in found
        assert (("LOW_SEMANTIC_MATCH", c[3]) in found) == (max(ratio(c[6], p[7]) for p in PRODUCTS) < 0.2)
    assert ("PARTIAL_COVERAGE", "5.1") in found and ("LOW_SEMANTIC_MATCH", "6.1") in found
    gaps = {r.gap_key: r for r in QUERIES["gap_groups"](spark, small).collect()}
    assert gaps["6.1"].base_risk == 10 + 5 + 2 and gaps["5.1"].worst == "MAJOR"
    place = {r.gap_key: r.place for r in QUERIES["gap_recommendations"](spark, small).collect()}
    assert place["6.1"] < place["5.1"]


def test_seven_layers(spark, small):
    rows = QUERIES["layer_scores_weighted"](spark, small).collect()
    assert len(rows) == 7 and abs(sum(r.weight for r in rows) - 1) < 1e-9
    last = max(QUERIES["waterfall"](spark, small).collect(), key=lambda r: r.running)
    assert abs(last.running - QUERIES["overall_score"](spark, small).first().raw) < 1e-6
    best = [max(ratio(c[6], p[7]) for p in PRODUCTS) for c in CLAUSES]
    assert [r.score for r in rows if r.layer == "semantic_matching"] == [round(100 * sum(best) / 2, 1)]


def test_slips_in_methods(spark, small):
    found = {r.method: r.found for r in QUERIES["method_hits"](spark, small).collect()}
    assert found["fault tree analysis"] and not found["xylophone"]


def test_every_method_of_every_standard(spark, small):
    rows = QUERIES["method_hits"](spark, small).collect()
    texts, used = [p[7].lower() for p in PRODUCTS], [u for p in PRODUCTS for u in p[9] or []]
    wanted = {(m, any(ratio(m, u) >= 0.5 for u in used) or any(m in t for t in texts)) for _, kind, m in METHODS if kind == "method"}
    assert {(r.method, r.found) for r in rows} == wanted and len(rows) == 4
    assert [(r.n_required, r.n_found) for r in QUERIES["method_audit"](spark, small).collect()] == [(4, sum(f for _, f in wanted))]


def test_register_takes_what_messages_name(spark, small):
    findings = [f for f in C.Model(spark, small).findings().collect() if f.node_id]
    rows = {r.art_ord: r for r in QUERIES["register"](spark, small).collect()}
    for p in PRODUCTS:
        mine = [f for f in findings if any(s in i for s in p[5] for i in [f.node_id, *([f"{f.group_key}:{f.node_id}", f.title] if f.type == "BROKEN_REFERENCE" else [])])]
        r = rows[p[0]]
        assert (r.n_findings, r.n_critical, r.n_major) == (len(mine), sum(f.severity == "CRITICAL" for f in mine), sum(f.severity == "MAJOR" for f in mine))
    assert rows[12].n_major == 1 and rows[12].state == "Partially Compliant" and rows[13].n_major == 2


def test_matrix_holds_all_rows(spark):
    states = spark.range(130).selectExpr("'s' AS std", "id AS node_ord", "'part_3' AS group_key", "string(id) AS node_id", "'full' AS state")
    sims = spark.range(130).selectExpr("'s' AS std", "id AS node_ord", "0.5D AS sim")
    assert sorted(r.place for r in L.compliance_matrix(states, sims).collect()) == list(range(1, 131))


def test_nothing_to_measure(spark, small):
    m = C.Model(spark, small)
    m.rules = ()
    assert m.traces().count() == 0
    none = m.nodes.limit(0)
    assert [r.score for r in L.reference_score(L.reference_states(L.reference_edges(none), m.arts), m.stds()).collect()] == [0.0]
    assert [(r.n_required, r.score) for r in L.method_score(m.methods().limit(0), m.stds()).collect()] == [(0, 100.0)]
    by_layer = {r.layer: r for r in m.scores().collect()}
    assert by_layer["traceability_chain"].score == 0.0
    assert [(r.type, r.severity) for r in m.findings().filter("layer_ord = 7").collect()] == [("NO_TRACEABILITY_EVIDENCE", "CRITICAL")]
    linked = spark.createDataFrame([("s", 1, [("a", "b", None)])], "std string, art_ord long, links array<struct<`from`:string,`to`:string,type:string>>")
    assert L.trace_default(linked).first().score == 70.0 and L.trace_default_findings(linked).first().type == "NO_TRACEABILITY_MODEL"


def test_phrases_of_any_script(spark):
    arts = spark.createDataFrame([("s", 1, "この文書は機能安全計画を示す。"), ("s", 2, "A fault-tree analysis -- done"), ("t", 3, "x" * 5000 + "keyword" + "y" * 5000)], "std string, art_ord long, full_text string")
    phrases = spark.createDataFrame([("s", "安全計画"), ("s", "tree anal"), ("s", "--"), ("s", "Fault tree"), ("t", "keyword"), ("t", "安全計画")], "std string, p string")
    assert {(r.std, r.p) for r in L.text_hits(phrases, arts, "p").collect()} == {("s", "安全計画"), ("s", "tree anal"), ("s", "--"), ("t", "keyword")}


def test_blocks_hold_all_pairs(spark):
    from traceloom.operators import similarity as S

    rng = __import__("random").Random(3)
    name = lambda: "".join(rng.choices("abcde ", k=rng.randint(0, 12)))
    left, right = [("s", name()) for _ in range(40)], [("s", name()) for _ in range(70)]
    got = S.blocked(spark.createDataFrame(left, "std string, a string").distinct(), spark.createDataFrame(right, "std string, b string").distinct(), "std", lambda x, y: __import__("pyarrow").table({"n": [x.num_rows * y.num_rows]}), "n long", block=8)
    assert got.groupBy().sum("n").first()[0] == len(set(left)) * len(set(right))
    pairs = {(r.a, r.b) for r in S.alike(spark.createDataFrame(left, "std string, a string"), spark.createDataFrame(right, "std string, b string"), 0.5).collect()}
    assert pairs == {(a, b) for _, a in left for _, b in right if SequenceMatcher(None, a, b).ratio() >= 0.5}


def test_lookups_of_the_report(spark):
    rows = spark.createDataFrame([("s", 2, "WP-1", 5), ("s", 1, "WP-1", 7), ("s", 3, "WP-2", 9)], "std string, art_ord long, art_id string, n_findings int")
    assert sorted((r.art_id, r.n_findings) for r in L.register_by_id(rows).collect()) == [("WP-1", 7), ("WP-2", 9)]
    scores = spark.createDataFrame([("s", "3.1", 50.0), ("s", "part_4:2", 41.0), ("s", "3.2", 40.0), ("s", "43", 99.0)], "std string, node_id string, score double")
    groups = spark.createDataFrame([("s", "part_3"), ("s", "part_4")], "std string, group_key string")
    assert sorted((r.node_id, r.group_key) for r in L.inferred_groups(scores, groups).collect()) == [("3.1", "part_3"), ("43", "part_4"), ("part_4:2", "part_4")]
