"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry
from tablewright.plans import load

QUERIES, ORACLES = load()
# Pages that lie beyond the smallest tables.
EMPTY = {"page_offset", "page_keyset", "row_number_page"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, small, name):
    problem = compare(spark, con, small, QUERIES[name], ORACLES.get(name))
    assert problem is None or problem == "both sides are empty" and name in EMPTY, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["status", "o_orderkey", "n_changes", "changed_columns"]
    assert {r["status"]: r["count"] for r in df.groupBy("status").count().collect()} == {
        "added": 16, "removed": 15, "modified": 196,
    }
