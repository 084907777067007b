"""Every registered query equals its SQL twin on whole tables."""

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF
from workload.queries import REGISTRY
from tests.oracle import connect, spark_rows, sql_rows

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert REGISTRY.keys() <= ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, expected = sql_rows(con, ORACLES[name])
    assert sorted(df.columns) == names
    assert expected, "an empty result proves nothing"
    assert spark_rows(df) == expected


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns == ["url", "outcome", "keys", "digest"]
