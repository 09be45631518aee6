"""Every registered query against its SQL, on the small tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    assert compare(df, con, entry_module.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
