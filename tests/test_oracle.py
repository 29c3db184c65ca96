"""Every query against its SQL oracle on whole tables."""

import pytest

import __spark_entry__ as entry
from kickstand.plans.catalog import all_queries
from kickstand.plans.oracles import all_oracles
from tests.compare import DATA, compare, duck

SF_DIR = str(DATA / "sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(name, spark, con):
    same, message = compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert same, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
