import json

from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.operators import structure as Q


def test_members(spark):
    doc = {
        "part": "4", "methods_tables": [{"title": "Design", "methods": [{"name": "walkthrough"}, {"method": "fta", "ASIL": ["C", "D"]}]}], "annexes": [{"tables": [{"activity": "Test", "methods": [{"technique": "boundary", "level": ["B"]}]}]}],
        "informative_guidance": {"examples": [{"title": "E", "description": "d"}]}, "traceability_model": {"mapping": [{"from": "a", "to": "b"}]}, "cross_part_links": {"mapping": [{"from": "c", "to": "d"}]},
        "clauses": [{"section": "5.1", "cross_references": [{"part": "3", "section": "6.1", "context": "x"}, {"clause": "7"}]}, {"id": "5.2"}],
    }
    df = spark.createDataFrame([("a.json", json.dumps(doc)), ("b.json", "{}"), ("c.json", "broken"), ("d.json", None)], "file_name string, text string")
    tables = Q.method_tables(df)
    assert sorted((r.activity, r.method, r.levels) for r in tables.collect()) == [("Design", "fta", ["C", "D"]), ("Design", "walkthrough", None), ("Test", "boundary", ["B"])]
    assert sorted(r.method for r in Q.methods_for(tables, "B").collect()) == ["boundary", "walkthrough"]
    assert [(r.title, r.text) for r in Q.guidance(df).collect()] == [("E", "d")]
    assert [(r.place, r.from_item, r.to_item) for r in Q.trace_rules(df).collect()] == [(0, "a", "b"), (1, "c", "d")]
    assert [(r.src, r.target, r.context) for r in Q.reference_edges(df).collect()] == [("part_4:5.1", "part_3:6.1", "x"), ("part_4:5.1", "7", None)]


def test_formats(spark):
    df = spark.createDataFrame([("[HIGH] 5.1: x", "<a & 'b'>", 47.0, "2026-01-02T10:00"), ("y", None, 120.0, None)], "line string, t string, s double, d string")
    rows = df.select(T.priority_of(F.col("line")), T.without_priority(F.col("line")), T.html_escaped(F.col("t")), T.text_bar(F.col("s")), T.inverse_percent(F.col("s")), T.document_id("TL", F.col("d"))).collect()
    assert tuple(rows[0]) == ("HIGH", "5.1: x", "&lt;a &amp; &#x27;b&#x27;&gt;", "#" * 9, 53.0, "TL-20260102")
    assert tuple(rows[1]) == ("LOW", "y", "", "#" * 24, 0.0, "TL-DRAFT")


def test_numbers_of_hot_groups(spark):
    from traceloom.operators import requirements

    rows = [("hot", k * 3) for k in range(500)] + [("cold", 7), (None, 4), (None, 2), ("hot", -5)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    got = {(r.g, r.k): r.n for r in requirements.numbered(df, "g", "k", bits=4).collect()}
    want = {(g, k): n for g in ("hot", "cold", None) for n, k in enumerate(sorted(k for h, k in rows if h == g), 1)}
    assert got == want
