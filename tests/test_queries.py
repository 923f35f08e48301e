"""Every registered query next to its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    found = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], names, found.fetchall()) == "ok"


@pytest.mark.parametrize("name", ["step_aic_path", "elimination_path", "tree_metrics"])
def test_fitted_queries_run(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0
