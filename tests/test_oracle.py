"""Every query with a SQL twin must give the same rows."""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows_as_sql(spark, sql, name):
    assert compare(spark, sql, entry_points.queries()[name], entry_points.oracle_sql()[name], SF) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
