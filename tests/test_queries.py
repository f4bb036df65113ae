"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from gainsay.workload.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    _, problem = compare(spark, duck, SF_DIR, QUERIES[name], ORACLE[name])
    assert problem is None
