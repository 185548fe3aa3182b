"""Every query against its SQL on DuckDB, over whole tables."""

import os

import pytest
from harness import differences, duck

from __spark_entry__ import entry
from streakline.plans.catalog import catalog as queries
from streakline.plans.oracle import oracle as oracle_sql

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) - set(oracle_sql()) == ROWS_ONLY
    assert not set(oracle_sql()) - set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 22
