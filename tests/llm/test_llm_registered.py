"""Registered queries over the smallest tables: schemas, whole tables, and SQL or brute-force rows."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import brute

SF = "/root/testdata/sf0.001"
NAMES = [f"op{n}_" for n in range(1, 14)]


def query(prefix):
    (name,) = [n for n in entry.queries() if n.startswith(prefix)]
    return name, entry.queries()[name]


@pytest.mark.parametrize("prefix", NAMES)
def test_every_row_of_the_table_has_its_result(spark, prefix):
    _, run = query(prefix)
    rows = run(spark, SF).collect()
    table, key, least = {"op1_": ("pages", "page_id", 1), "op3_": ("embeddings", "query_id", 20), "op12_": ("embeddings", "vec_id", 1)}.get(prefix, ("documents", "doc_id", 1))
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert len(rows) == n if prefix not in ("op3_", "op10_") else len(rows) >= n * least // 20
    assert len({r[key] for r in rows}) in (n, -(-n // 20))


@pytest.mark.parametrize("prefix", ["op3_", "op5_", "op12_", "op13_"])
def test_sql_gives_the_same_rows(spark, prefix):
    name, run = query(prefix)
    found = run(spark, SF)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_brute_force_gives_the_same_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.repeated_bytes(docs, 400)]
    assert sorted(map(tuple, query("op2_")[1](spark, SF).collect())) == sorted(want)
    groups = brute.near_components(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in query("op9_")[1](spark, SF).collect()} == groups
    texts = dict(docs)
    for r in query("op4_")[1](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest()
