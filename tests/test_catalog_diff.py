"""Catalogue from schema dumps (C1-C7) and schema changes."""

from __future__ import annotations

from ddlscope.operators import catalog, diff, extract
from helpers import scripts

SCHEMA = """-- Full e-commerce schema dump
CREATE TABLE users (
    id             BIGSERIAL PRIMARY KEY,
    email          VARCHAR(255) NOT NULL UNIQUE,
    username       VARCHAR(100) NOT NULL,
    legacy_token   VARCHAR(512),
    created_at     TIMESTAMP NOT NULL DEFAULT NOW()
);
CREATE INDEX idx_users_email ON users (email);
CREATE INDEX idx_ghost ON ghosts (x);
CREATE TABLE orders (
    id          BIGINT,
    user_id     BIGINT NOT NULL,
    status      VARCHAR(50) NOT NULL DEFAULT 'pending',
    PRIMARY KEY (id),
    FOREIGN KEY (user_id) REFERENCES users (id)
);
CREATE INDEX idx_orders_status ON orders (status);
"""


def dumps(spark, text=SCHEMA):
    return spark.createDataFrame([("s", text)], "schema_id string, text string")


def test_parses_create_table(spark):
    cols = catalog.catalog_columns(dumps(spark, "CREATE TABLE users (\n id BIGSERIAL PRIMARY KEY,\n"
                                                " email VARCHAR(255) NOT NULL\n);"))
    got = {(r.table_name, r.column_name, r.data_type, r.nullable) for r in cols.collect()}
    assert got == {("users", "id", "BIGSERIAL", True), ("users", "email", "VARCHAR(255)", False)}


def test_parses_multiple_tables_and_empty(spark):
    t = catalog.catalog_tables(dumps(spark, "CREATE TABLE users (id BIGSERIAL PRIMARY KEY);\n"
                                            "CREATE TABLE orders (id BIGSERIAL PRIMARY KEY);"))
    assert sorted(r.table_name for r in t.collect()) == ["orders", "users"]
    assert catalog.catalog_columns(dumps(spark, "")).count() == 0


def test_keys_defaults_and_indexes(spark):
    cols = {(r.table_name, r.column_name): r for r in catalog.catalog_columns(dumps(spark)).collect()}
    assert cols[("orders", "id")].is_primary_key and not cols[("users", "id")].is_primary_key
    assert cols[("orders", "user_id")].references == "users.id"
    assert cols[("orders", "status")].default_value == "'pending'"
    assert cols[("users", "created_at")].default_value == "NOW()"
    idx = {r.index_name: r for r in catalog.catalog_indexes(dumps(spark)).collect()}
    assert set(idx) == {"idx_users_email", "idx_orders_status"}      # ghosts was never created
    assert idx["idx_users_email"].columns == ["email"]


def test_lookup_and_type_compatibility(spark):
    from pyspark.sql import functions as F
    tables = catalog.catalog_tables(dumps(spark))
    df = spark.createDataFrame([("users",), ("USERS",), ("nope",)], "t string")
    got = {r.t: r.catalog_table for r in catalog.lookup_table(df, "t", tables).collect()}
    assert got == {"users": "users", "USERS": "users", "nope": None}
    pairs = spark.createDataFrame([("VARCHAR(10)", "varchar (20)"), ("INT", "BIGINT")], "a string, b string")
    assert [r[0] for r in pairs.select(catalog.type_compatible(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_snapshot_diff(spark):
    before = catalog.catalog_columns(dumps(spark))
    after = catalog.catalog_columns(dumps(spark, SCHEMA.replace("    legacy_token   VARCHAR(512),\n", "")
                                          .replace("username       VARCHAR(100) NOT NULL",
                                                   "username       TEXT")
                                          + "CREATE TABLE extra (x INT);"))
    got = sorted((r.table_name, r.column_name, r.change_type) for r in catalog.snapshot_diff(before, after).collect())
    assert got == [("extra", "x", "added"), ("users", "legacy_token", "removed"),
                   ("users", "username", "nullable_changed"), ("users", "username", "type_changed")]


def changes_for(spark, sql):
    ops = extract.extract_operations(scripts(spark, sql))
    idx = catalog.catalog_indexes(dumps(spark))
    ops = extract.resolve_index_tables(ops, idx)
    return diff.schema_changes(ops, catalog.catalog_columns(dumps(spark)), idx)


def test_add_column_appears_in_diff(spark):
    r = changes_for(spark, "ALTER TABLE users ADD COLUMN bio TEXT;").collect()
    assert [(x.change_type, x.column_name, x.after, x.breaking) for x in r] == [("added", "bio", "bio", False)]


def test_add_not_null_on_existing_table_is_breaking(spark):
    r = changes_for(spark, "ALTER TABLE users ADD COLUMN score INT NOT NULL;\n"
                           "ALTER TABLE nope ADD COLUMN score INT NOT NULL;").orderBy("stmt_pos").collect()
    assert [x.breaking for x in r] == [True, False]


def test_drop_column_marked_breaking_with_before(spark):
    r = changes_for(spark, "ALTER TABLE users DROP COLUMN email;\nALTER TABLE users DROP COLUMN ghost;") \
        .orderBy("stmt_pos").collect()
    assert [(x.change_type, x.breaking, x.before) for x in r] == [
        ("removed", True, "email VARCHAR(255)"), ("removed", True, None)]


def test_table_index_and_constraint_changes(spark):
    r = changes_for(spark, "CREATE TABLE audit_log (id INT);\nDROP INDEX idx_users_email;\n"
                           "CREATE INDEX ON orders (status);\nALTER TABLE orders ADD CONSTRAINT c CHECK (id > 0);"
                           ).orderBy("stmt_pos").collect()
    assert [(x.object_kind, x.change_type, x.table_name) for x in r] == [
        ("table", "added", "audit_log"), ("index", "removed", "users"), ("index", "added", "orders"),
        ("constraint", "added", "orders")]
    assert r[1].index_columns == ["email"]
    assert r[2].index_name == "idx_orders_new"
    assert (r[3].constraint_name, r[3].constraint_type) == ("fk_orders", "CONSTRAINT")


def test_diff_summary_and_breaking_flag(spark):
    ch = changes_for(spark, "ALTER TABLE users DROP COLUMN email;\nDROP INDEX idx_users_email;")
    m = spark.createDataFrame([(0,), (1,)], "migration_id long")
    s = {r.migration_id: r for r in diff.diff_summary(ch, m).collect()}
    assert (s[0].column_changes, s[0].index_changes, s[0].removed_indexes, s[0].has_breaking_changes) == (1, 1, 1, True)
    assert (s[1].column_changes, s[1].has_breaking_changes) == (0, False)


def test_comments_quotes_and_options_in_dumps(spark):
    text = ("CREATE TABLE \"Main Bin\" (\n  id INT, -- key, surrogate\n  email VARCHAR(9) /* a, b */ NOT NULL,\n"
            "  note TEXT DEFAULT 'a, (b', total NUMERIC(8, 2) CHECK (total IS NOT NULL)\n) ENGINE=InnoDB;")
    rows = {r.column_name: r for r in catalog.catalog_columns(dumps(spark, text)).collect()}
    assert set(rows) == {"id", "email", "note", "total"} and {r.table_name for r in rows.values()} == {"Main Bin"}
    assert not rows["email"].nullable and rows["total"].nullable and rows["total"].data_type == "NUMERIC(8, 2)"


def test_wide_table_and_last_definition_wins(spark):
    wide = ", ".join(f"c{i} VARCHAR({i}) DEFAULT 'x'" for i in range(1, 401))
    text = f"CREATE TABLE w ({wide}); CREATE TABLE u (a INT); CREATE TABLE u (a BIGINT, b INT, b TEXT);"
    cols = catalog.catalog_columns(dumps(spark, text))
    assert cols.filter("table_name = 'w'").count() == 400
    assert sorted((r.column_name, r.data_type) for r in cols.filter("table_name = 'u'").collect()) == [("a", "BIGINT"), ("b", "TEXT")]
    parts = spark.createDataFrame([("s", "2.sql", "CREATE TABLE u (z INT);"), ("s", "1.sql", "CREATE TABLE u (a INT);")],
                                  "schema_id string, part string, text string")
    assert [r.column_name for r in catalog.catalog_columns(parts).collect()] == ["z"]


def test_changes_look_up_their_own_schema(spark):
    two = spark.createDataFrame([("p", "CREATE TABLE users (email VARCHAR(10)); CREATE INDEX i ON users (email);"),
                                 ("q", "CREATE TABLE users (email TEXT); CREATE TABLE users (email TEXT);")], "schema_id string, text string")
    sql = scripts(spark, "ALTER TABLE users DROP COLUMN email; DROP INDEX i;", "ALTER TABLE Users DROP COLUMN email;")
    from pyspark.sql import functions as F
    sql = sql.withColumn("schema_id", F.when(F.col("migration_id") == 0, "p").otherwise("q"))
    cols, idx = catalog.catalog_columns(two), catalog.catalog_indexes(two)
    ops = extract.resolve_index_tables(extract.extract_operations(sql, keep=["schema_id"]), idx)
    got = [(r.migration_id, r.change_type, r.before, r.index_columns)
           for r in diff.schema_changes(ops, cols, idx).orderBy("migration_id", "stmt_pos").collect()]
    assert got == [(0, "removed", "email VARCHAR(10)", None), (0, "removed", None, ["email"]), (1, "removed", "email TEXT", None)]


def test_has_column_keeps_every_row(spark):
    cols = catalog.catalog_columns(dumps(spark, "CREATE TABLE users (email INT, \"Name\" INT);"))
    rows = [("users", "EMAIL", None), ("users", "email", "x"), ("users", "email", "x"), ("users", "Name", None), ("users", "name", None),
            (None, "email", None), ("users", None, None)]
    df = spark.createDataFrame(rows, "t string, c string, other string")
    got = catalog.has_column(df, "t", "c", cols)
    assert sorted((r.t or "", r.c or "", r.column_present) for r in got.collect()) == sorted([
        ("users", "EMAIL", True), ("users", "email", True), ("users", "email", True), ("users", "Name", True), ("users", "name", False),
        ("", "email", False), ("users", "", False)])


def test_narrower_type_is_a_change(spark):
    a, b = (catalog.catalog_columns(dumps(spark, f"CREATE TABLE t (c VARCHAR({n}));")) for n in (10, 5))
    assert [(r.change_type, r.before, r.after) for r in catalog.snapshot_diff(a, b).collect()] == [("type_changed", "VARCHAR(10)", "VARCHAR(5)")]
