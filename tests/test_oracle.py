"""Every query with SQL must give the rows DuckDB gives; the others must run and keep their columns."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
# Fits of many models: covered on small tables in test_learning.py.
LONG = {"text_coder_cv", "coder_predictions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_files_have_true_checksums(spark):
    import hashlib

    for r in QUERIES["file_fingerprint"](spark, SF).collect():
        with open(f"{SF}/{r['key']}", "rb") as f:
            content = f.read()
        assert r["md5"] == hashlib.md5(content).hexdigest() and r["length"] == len(content)


def test_manifest_outcome(spark):
    got = {r["key"]: (r["found"], r["ok"]) for r in QUERIES["manifest_check"](spark, SF).collect()}
    assert [k for k, v in got.items() if not v[1]] and got["orders.parquet"] == (True, False) and got["gone.parquet"] == (False, False)
    assert sum(ok for _, ok in got.values()) == 13
