"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import compare, duck
from tracewell.catalog import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    same, note = compare(con, df, all_sql()[name])
    assert same, note


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    # Beside the library's own queries, all with SQL, the driver may list those of the optional subpackage.
    assert set(all_queries()) <= set(driver.queries())
    assert set(all_sql()) <= set(driver.oracle_sql()) <= set(driver.queries())
