"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, db, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"auc", "mrr"} and 0 < rows["auc"] < 1
