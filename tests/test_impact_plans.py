"""Impacts: patterns run once per query, and pairs of queries and indexes aren't shuffled."""

from pyspark.sql import functions as F

from ddlscope.operators import querylog
from ddlscope.functions import patterns


def _refs(spark):
    rows = [(1, "SELECT t.a, t.b FROM t WHERE t.c = 1"), (1, "SELECT t.a, t.b FROM t"), (2, "SELECT t.b FROM t")]
    return querylog.with_references(spark.createDataFrame(rows, "log_id long, query string"))


def _changes(spark):
    rows = [(7, "index", "removed", "t", None, "i", ["a", "b"]), (7, "index", "removed", "t", None, "i", ["a", "b"]),
            (7, "index", "removed", "t", None, "j", ["c", "b", "a"]), (7, "index", "removed", "t", None, "k", [])]
    return spark.createDataFrame(rows, "migration_id long, object_kind string, change_type string, table_name string, column_name string, "
                                 "index_name string, index_columns array<string>")


def test_patterns_run_once(spark):
    keys = _refs(spark).select("log_id", "query", F.explode("key_cols").alias("k"))
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp" in line for line in filters)
    assert plan.count(patterns.LOCKING[:30]) == 1


def test_pairs_met_once_without_a_shuffle_of_pairs(spark):
    migrations = spark.createDataFrame([(7, 1)], "migration_id long, db_id long")
    found = querylog.match_impacts(_refs(spark), _changes(spark), migrations)
    got = sorted((r.query, r.description) for r in found.collect())
    # i is dropped twice, j and k once; a query that shares several columns with an index meets it once
    assert len(got) == 8
    assert len({d for _, d in got}) == 3
    dropped = querylog._dropped_indexes(_changes(spark), migrations)
    keys = querylog._database(_refs(spark)).select("log_id", "query", "_db", F.explode("key_cols").alias("_kc")).select(
        "log_id", "query", "_db", F.col("_kc.key").alias("key"), F.col("_kc.cols").alias("cols"))
    plan = querylog._met_indexes(keys, ["log_id", "query"], dropped)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")
