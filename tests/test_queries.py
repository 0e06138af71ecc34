"""Every query with SQL against DuckDB; the contract of the entry module."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], SQL[name], sf_dir) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    routed = {r["metric"]: r["value"] for r in rows if r["class"] == ""}
    assert routed["flagged"] + routed["bypassed"] == routed["rows"] > 0
