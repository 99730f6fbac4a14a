"""Every query with an SQL counterpart gives the same rows as another engine."""

import pytest

import __spark_entry__ as entry
from tools.compare import connect, difference
from wardenlog.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES.keys()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= entry.queries().keys()
