"""Every query with SQL against DuckDB, on odd, empty and given tables."""

import pytest
from llm_tables import CLASHING, duck, odd_rows, plain, write

from streakline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), odd_rows(), CLASHING)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_tables(spark, odd, name):
    columns, expected = duck(odd, ORACLES[name])
    found = QUERIES[name](spark, odd)
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.select(*columns).collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name == "op9_chat" else 0)


@pytest.mark.parametrize("name", ["op3_decontamination", "op6_setsketch", "op1_substring_dedup"])
def test_given_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    columns, expected = duck(folder, ORACLES[name])
    assert plain(QUERIES[name](spark, folder).select(*columns).collect()) == plain(expected)
