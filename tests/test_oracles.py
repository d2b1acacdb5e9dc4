import math

import pytest

from axonframe import registry

from .compare import SMALL, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_kernel_query_gives_rows_of_finite_numbers(spark, name):
    rows = registry.QUERIES[name](spark, SMALL).collect()
    assert rows
    numbers = [x for r in rows for x in r if isinstance(x, float)]
    assert all(math.isfinite(x) for x in numbers)
    again = registry.QUERIES[name](spark, SMALL).collect()
    assert len(again) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
