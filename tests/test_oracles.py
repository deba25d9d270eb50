"""Every registered query of the library against its DuckDB oracle; the others must run and give rows."""

import pytest

from ragmill import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
