"""Every query against its SQL twin; queries without one must give rows with a stable schema."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from loomwright.catalog import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1
