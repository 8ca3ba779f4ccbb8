"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from ddlscope.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["migration_id", "overall_score", "overall_level", "n_ops", "blocked"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n.startswith("q_")))
def test_query_matches_oracle(spark, duck, name):
    from check_oracle import _digest

    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows)[0] == _digest(ocols, orows)[0]


def test_every_query_has_an_oracle():
    missing = {n for n in E.queries() if n.startswith("q_")} - set(E.oracle_sql())
    assert not missing
