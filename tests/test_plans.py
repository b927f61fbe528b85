"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from evidloom.plans import registry
from tests.conftest import normal

registry.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = normal(registry.QUERIES[name](spark, sf_dir).toPandas())
    want = normal(duck.execute(registry.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.values.tolist() == want.values.tolist()


def test_entry_has_all(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()[registry.FLAGSHIP](spark, sf_dir).count() > 0
