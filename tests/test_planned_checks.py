"""Checks planned from scripts, rules that ask the catalogue, row counts per schema, the index of dropped indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ddlscope.operators import extract, locks, planned, querylog, scoring
from helpers import scripts

SCRIPT = """
ALTER TABLE orders ADD CONSTRAINT a FOREIGN KEY (cust) REFERENCES customer (id);
ALTER TABLE orders ADD FOREIGN KEY (code) REFERENCES customer (id);
ALTER TABLE orders ADD FOREIGN KEY (cust, code) REFERENCES customer (id, name);
ALTER TABLE orders ADD FOREIGN KEY (cust) REFERENCES nowhere (id);
ALTER TABLE orders ADD FOREIGN KEY (gone) REFERENCES customer (id);
ALTER TABLE orders ADD CONSTRAINT b CHECK (amount > 0 AND (code <> 'x' OR code IS NULL));
ALTER TABLE orders ADD CONSTRAINT c CHECK (java_method('java.lang.System', 'exit') IS NULL);
ALTER TABLE orders ADD CONSTRAINT d CHECK (missing > 0);
ALTER TABLE orders ALTER COLUMN amount TYPE INTEGER USING amount::int;
ALTER TABLE orders ALTER COLUMN code SET DATA TYPE VARCHAR(2);
ALTER TABLE orders ALTER COLUMN code SET NOT NULL;
ALTER TABLE orders ALTER COLUMN at TYPE NUMERIC(18, 4);
ALTER TABLE orders ALTER COLUMN code TYPE hstore;
ALTER TABLE unknown ALTER COLUMN a TYPE INTEGER;
ALTER TABLE orders DROP COLUMN code;
"""


def test_planned_checks(spark):
    tables = {
        "orders": spark.createDataFrame([(1, "a", 1.0), (1, "abc", 2.5), (9, None, -1.0), (None, "x", 4.0)], "cust int, code string, amount double")
        .withColumn("at", F.lit("2024-01-01").cast("timestamp")),
        "customer": spark.createDataFrame([(1, "n"), (1, "m"), (2, "o")], "id long, name string"),
    }
    ops = extract.extract_operations(scripts(spark, SCRIPT, SCRIPT))   # two migrations, one set of demands
    rows = planned.settle_checks(planned.planned_checks(ops), tables.get).collect()
    got = [(r.check_kind, r.column_name, r.status, r.checked_rows, r.violating_rows) for r in sorted(rows, key=lambda r: (r.migration_id, r.stmt_pos))]
    assert got[:len(got) // 2] == got[len(got) // 2:] == [
        ("foreign_key", "cust", "violated", 4, 1), ("foreign_key", "code", "type_mismatch", None, None),
        ("foreign_key", "cust, code", "unsupported", None, None), ("foreign_key", "cust", "missing_table", None, None),
        ("foreign_key", "gone", "missing_column", None, None), ("check", "", "violated", 4, 2), ("check", "", "unsupported", None, None),
        ("check", "", "unsupported", None, None), ("type", "amount", "violated", 4, 1), ("type", "code", "violated", 3, 1),
        ("not_null", "code", "violated", 4, 1), ("type", "at", "type_mismatch", None, None), ("type", "code", "unsupported", None, None),
        ("type", "a", "missing_table", None, None)]
    assert planned.settle_checks(planned.planned_checks(ops.limit(0)), tables.get).count() == 0


def test_predicates_are_of_known_parts():
    for text in ("a > 1 AND b IS NOT NULL", "length(a) <= 10 OR a IN ('x;y', 'z--')", "a BETWEEN 1 AND 2.5", "coalesce(a, 0) >= -1"):
        assert planned._predicate(text, ["a", "b"]) == text
    for text in ("", "c > 1", "reflect('x', 'y') = a", "a > 1 -- b", "(SELECT max(a) FROM t) > a", "a > `b`", "a > $$x$$", "1 = 1"):
        assert planned._predicate(text, ["a", "b"]) is None, text


def test_rules_that_ask_the_catalogue(spark):
    ops = extract.extract_operations(scripts(spark, "ALTER TABLE t DROP COLUMN a; ALTER TABLE t DROP COLUMN b; ALTER TABLE u DROP COLUMN a; DROP TABLE t;"))
    known = spark.createDataFrame([("t", "a"), ("t", "a"), (None, "b")], "table_name string, column_name string")
    of_column = {"table_name": "target_table", "column_name": "target_column"}
    drop = F.col("op_class") == "DROP_COLUMN"
    rules = [scoring.CatalogRule("known", drop, known, of_column, True, "high", "m", "s"),
             scoring.CatalogRule("unknown", drop, known, of_column, False, "low", "m", "s"),
             scoring.CatalogRule("table", drop, known, {"table_name": "target_table"}, True, "low", "m", "s")]
    hits = scoring.catalog_rules(ops, rules)
    assert sorted((r.stmt_pos, r.rule) for r in hits.collect()) == [(0, "known"), (0, "table"), (1, "table"), (1, "unknown"), (2, "unknown")]
    assert not [c for c in hits.columns if c.startswith("_in")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2   # two rules share a lookup and its keys


def test_row_counts_of_a_schema(spark):
    rows = [(0, "CREATE INDEX i ON t (a);", "postgres", "s1"), (1, "CREATE INDEX i ON t (a);", "postgres", "s2"), (2, "CREATE INDEX i ON t (a);", "postgres", None)]
    ops = extract.extract_operations(spark.createDataFrame(rows, "migration_id long, text string, dialect string, schema_id string"), keep=["schema_id"])
    stats = spark.createDataFrame([("s1", "t", 10), ("s2", "t", 20), ("s2", "u", 30)], "schema_id string, table_name string, row_count long")
    got = {r.migration_id: r.row_count for r in locks.apply_lock_analysis(ops, stats).collect()}
    assert got == {0: 10, 1: 20, 2: None}
    got = {r.migration_id: r.row_count for r in locks.apply_lock_analysis(ops, stats.filter("schema_id = 's1'").drop("schema_id")).collect()}
    assert got == {0: 10, 1: 10, 2: 10}


def test_dropped_indexes_meet_queries_by_their_columns(spark):
    logs = spark.createDataFrame([(1, 0, "SELECT t.a, t.b FROM t;\nSELECT * FROM t;\nSELECT t.z FROM t;\nSELECT u.a FROM u;\n")], "log_id long, chunk_id long, text string")
    refs = querylog.with_references(querylog.extract_queries(logs))
    migrations = spark.createDataFrame([(7, 1), (8, 2)], "migration_id long, db_id long")
    rows = [(7, "t", "ab", ["A", "b"]), (7, "t", "ab", ["A", "b"]), (7, "t", "none", None), (7, "t", "c", ["c"]), (8, "t", "ab", ["a"])]
    changes = spark.createDataFrame([(m, "index", "removed", t, None, i, c) for m, t, i, c in rows],
                                    "migration_id long, object_kind string, change_type string, table_name string, column_name string, index_name string, "
                                    "index_columns array<string>")
    found = querylog.match_impacts(refs, changes, migrations)
    got = sorted((r.query, r.description.split("`")[1] if "`" in r.description else r.description) for r in found.collect())
    # by columns: an index on a, b (dropped twice) meets the query of both once each time; no columns on either side meets all
    count = {}
    for q, _ in got:
        count[q] = count.get(q, 0) + 1
    assert count == {"SELECT t.a, t.b FROM t;": 3, "SELECT * FROM t;": 4, "SELECT t.z FROM t;": 1}
    summary = {r.migration_id: r.index_missing for r in querylog.impact_summary(refs, changes, migrations).collect()}
    assert summary == {7: 8, 8: 0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan


def test_only_demands_are_written(spark):
    from ddlscope.plans import queries

    plan = queries.q_planned_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_sql" not in plan and "lock_type" not in plan


def test_keys_are_compared_as_numbers(spark):
    tables = {"a": spark.createDataFrame([(0.0, "x"), (-0.0, "y"), (2.0, None), (None, "x")], "k double, t string"),
              "b": spark.createDataFrame([(0, "x"), (1, "z"), (None, None)], "id int, t string")}
    sql = "ALTER TABLE a ADD FOREIGN KEY (k) REFERENCES b (id); ALTER TABLE a ADD FOREIGN KEY (t) REFERENCES b (t);"
    rows = planned.settle_checks(planned.planned_checks(extract.extract_operations(scripts(spark, sql))), tables.get).collect()
    assert sorted((r.column_name, r.status, r.checked_rows, r.violating_rows) for r in rows) == [("k", "violated", 4, 1), ("t", "violated", 4, 1)]
