"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from dielens.plans.catalog import ORACLES, QUERIES
from dielens.plans.compare import differences, oracle_connection


@pytest.fixture(scope="module")
def connection(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, connection, name):
    assert differences(spark, connection, sf, name, QUERIES[name], ORACLES.get(name)) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
