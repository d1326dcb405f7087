import json

from traceloom.operators import nested
from traceloom.session import scratch_path

COLUMNS = ["file_id", "wp_no", "parent_no", "kind", "pos", "item_value"]


def rows(spark, *payloads, schema="file_id long, payload string", more=()):
    df = spark.createDataFrame([(i, p, *more) for i, p in enumerate(payloads, 1)], schema)
    return sorted((tuple(r) for r in nested.nested_rows(nested.stored_tables(df, scratch_path(spark, "nested-test"))).select(COLUMNS).collect()), key=str)


PRODUCT = {"id": "A", "tags_addressed": ["x", None, " ", ["y", "x"]], "methods_used": [{"name": "m", "asil": ["A"]}, "n"], "traceability_links": {"upstream": [{"from": ["p", ""], "to": "q"}], "downstream": [{"from": None}, {"from": "r"}]}}
EXPECTED = [(1, 1, 0, "link_from", 1, "p"), (1, 1, 0, "link_from", 2, "r"), (1, 1, 0, "method", 1, "m"), (1, 1, 0, "method", 2, "n"), (1, 1, 0, "product", 0, "A"), (1, 1, 0, "tag", 1, "x"), (1, 1, 0, "tag", 2, "y"), (1, 1, 0, "tag", 3, "x")]


def test_shapes(spark):
    assert rows(spark, json.dumps({"work_products": [PRODUCT]})) == EXPECTED


def test_wrappers(spark):
    bare = json.dumps({"Work-Products": PRODUCT})
    for wrapped in (bare, "﻿ " + bare, json.dumps(bare), json.dumps(json.dumps(bare)), json.dumps({"envelope": {"body": json.loads(bare)}}), json.dumps({"envelope": {"body": bare}}), json.dumps([{"packages": [json.loads(bare)]}]), f"```json\n{bare}\n```"):
        assert rows(spark, wrapped) == EXPECTED, wrapped


def test_nothing_to_read(spark):
    assert rows(spark, None, "", "  ", "null", "{}", "[]", '{"work_products": null}', '{"work_products": [null]}', '{"work_products": [{"id": "A"}', json.dumps('{"work_products": [{"id": "A"}')) == []


def test_order_and_parents(spark):
    payload = '{"work_products": [{"sub_products": [{"id": "B", "sub_products": [{"id": "C"}]}], "id": "A"}, {"id": "D"}]}'
    assert rows(spark, payload) == [(1, 1, 0, "product", 0, "A"), (1, 2, 1, "product", 0, "B"), (1, 3, 2, "product", 0, "C"), (1, 4, 0, "product", 0, "D")]


def test_repeated_members_and_numbers(spark):
    assert rows(spark, '{"work_products": [{"id": 7, "tags_addressed": "a", "tags_addressed": ["b", 3, true]}]}') == [(1, 1, 0, "product", 0, "7"), (1, 1, 0, "tag", 1, "a"), (1, 1, 0, "tag", 2, "b"), (1, 1, 0, "tag", 3, "3"), (1, 1, 0, "tag", 4, "true")]


def test_very_deep_and_very_long(spark):
    depth = 20_000
    deep = '{"work_products":[' + '{"id":"x","sub_products":[' * depth + "]}" * depth + "]}"
    got = rows(spark, deep, json.dumps({"work_products": [{"id": "y", "tags_addressed": ["z" * 2_000_000]}]}))
    assert len(got) == depth + 2 and (1, depth, depth - 1, "product", 0, "x") in got
    text = '{"a": [1, {"b": "c\\"}"}, null], "d": -1.5e3}'
    assert nested._parse_deep(text) == (nested._DECODER.decode(text), len(text))
    # deep inside a wrapper that isn't JSON, and inside twenty strings
    assert len(rows(spark, f"```json\n{deep}\n```")) == depth
    wrapped = json.dumps({"work_products": [{"id": "w"}]})
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    assert rows(spark, wrapped) == [(1, 1, 0, "product", 0, "w")]
    shallow = '{"work_products": [{"id": "w"}]}'
    for _ in range(30):
        shallow = f'"{shallow}"' if '"' not in shallow else json.dumps(shallow) if len(shallow) < 20_000 else shallow
    assert rows(spark, shallow) == [(1, 1, 0, "product", 0, "w")]


def test_clashing_columns_and_empty_table(spark):
    assert rows(spark, json.dumps({"work_products": [PRODUCT]}), schema="file_id long, payload string, tag string, pk int, value string, kind string", more=("t", 1, "v", "k")) == EXPECTED
    assert rows(spark) == [] and rows(spark, json.dumps({"work_products": [PRODUCT]}), None) == EXPECTED


def test_numbers_as_written(spark):
    big = "9" * 60
    payload = '{"work_products": [{"id": 1.10, "tags_addressed": [1e5, %s, -0.0, {"name": 2.50}]}]}' % big
    assert [r[5] for r in rows(spark, payload)] == ["1.10", "1e5", big, "-0.0", "2.50"]
    assert [r[5] for r in rows(spark, '{"work_products": [{"id": "a\\ud800b"}]}')] == ["a\ufffdb"]


def test_columns_by_any_spelling(spark, tmp_path):
    files = [(1, '{"WORK_PRODUCTS": [{"ID": "A", "Title": "T", "mappedPart": 3, "STATUS": "done", "Owner": {"name": "o", "n": 1.50}, "reviewer": null}]}'), (2, '{"work products": [{"id": "B", "mapped-part": "4", "content": "c", "id": "later"}]}')]
    tables = nested.stored_tables(spark.createDataFrame(files, "file_id long, payload string"), str(tmp_path / "t"))
    got = {r.id: r.asDict() for r in tables["product"].collect()}
    assert (got["A"]["title"], got["A"]["mapped_part"], got["A"]["status"], got["A"]["content"]) == ("T", "3", "done", None)
    assert got["A"]["others"] == {"owner": '{"name": "o", "n": 1.50}', "reviewer": None}
    assert (got["B"]["mapped_part"], got["B"]["content"], got["B"]["others"]) == ("4", "c", {})
    spec = nested.NestedSpec(columns=("owner",), values={})
    own = nested.stored_tables(spark.createDataFrame(files, "file_id long, payload string"), str(tmp_path / "u"), spec)
    assert list(own) == ["product"] and {r.owner for r in own["product"].collect()} == {'{"name": "o", "n": 1.50}', None}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps({"work_products": [PRODUCT | {"title": "T"}]}))], "file_id long, payload string")
    nested.write_tables(nested.emit_tagged(df), str(tmp_path / "t"))
    tables = nested.apply_schemas(spark.read.parquet(str(tmp_path / "t")))
    assert [(r.wp_no, r.id, r.title) for r in tables["product"].collect()] == [(1, "A", "T")]
    assert sorted(r.item_value for r in tables["tag"].collect()) == ["x", "x", "y"]
