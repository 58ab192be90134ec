"""Every registered query of the library's own against its SQL."""

import os

import pytest

import registered_queries as registered
import __spark_entry__ as contract
from tests.oracle import assert_same, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    assert_same(frame, duck, contract.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()
