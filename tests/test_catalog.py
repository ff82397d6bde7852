"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from gaitworks.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER).toArrow()
    wanted = tables.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert compare(found, wanted) is None


def test_entry(spark):
    derived = entry.entry(spark)
    assert derived.count() == 500
    assert {"state", "cmd", "state_hist", "cmd_hist", "state_delta", "recovery_flag"} <= set(derived.columns)
