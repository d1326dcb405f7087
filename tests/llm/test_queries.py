import pytest

from tests.oracle import compare
from traceloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, data, name):
    mine, theirs = compare(spark, data, name, Q.queries()[name], Q.oracle_sql()[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, data, name):
    df = Q.queries()[name](spark, data)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_columns(spark, data):
    want = {"p2_found": "field_name term n_occurrences n_records mark", "p3_found": "left_key right_key", "p4_found": "clause_key field_name item_pos defect", "p5_found": "wp_key field_name pos entry_id", "p7_ids": "doc_id ids", "p9_found": "doc_id"}
    for name, columns in want.items():
        assert Q.queries()[name](spark, data).columns == columns.split(), name
