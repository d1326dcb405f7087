"""Every query with SQL gives the SQL's rows; the others give a stable schema."""

import pytest

from tests.oracle import compare
from traceloom.plans import registry

WITH_SQL = sorted(registry.oracle_sql())
WITHOUT = sorted(set(registry.queries()) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, data, name):
    mine, theirs = compare(spark, data, name, registry.queries()[name], registry.oracle_sql()[name])
    assert mine == theirs


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.flagship(spark, data).count() > 0
