"""Every query of the library's own operators against its SQL."""

import pytest

import __spark_entry__ as contract
from feedloom.plans import oracle
from feedloom.plans.queries import registered
from tools.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(registered()) == set(oracle.oracle_sql())
    assert set(registered()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 5 and "similarity_score" in frame.columns


@pytest.mark.parametrize("name", sorted(registered()))
def test_same_rows(spark, con, name):
    assert difference(spark, con, FOLDER, registered()[name], oracle.oracle_sql()[name]) is None
