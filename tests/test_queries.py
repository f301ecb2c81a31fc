"""Every query of the engine runs; those with SQL give what DuckDB gives."""

import pytest

from tidebar.plans import catalog

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        assert_same(df, catalog.ORACLES[name], con)
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
