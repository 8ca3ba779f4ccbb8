"""Schema dumps of many databases, derived from the driver's customers and orders.

Every group of customers (``c_custkey div 10``) is a database with two dumps,
before and after a release; types differ by database, every fourth database
defines a table twice, and the texts hold comments, quoted names and literals
with commas and semicolons.  Expected catalogue rows are given as DuckDB SQL
from the same parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.session import read_table
from ddlscope.sources.corpus import DB_PER_CUSTOMER_DIV

LOOKUP_TABLES = ["account", "ACCOUNT", "Order Line", "missing"]
LOOKUP_COLUMNS = ["name", "QTY", "balance"]

_BEFORE = """-- database {db}; CREATE TABLE ghosts (x INT);
CREATE TABLE account (
    id BIGINT, -- key, surrogate
    name VARCHAR({v}) /* a, b; c */ NOT NULL,
    balance NUMERIC(18, {s}) DEFAULT 0.0,
    note TEXT DEFAULT 'a, b; (c',
    PRIMARY KEY (id)
);
CREATE TABLE "Order Line" (
    id BIGINT NOT NULL, account_id BIGINT,
    qty INTEGER CHECK (qty IS NOT NULL AND qty > 0),
    FOREIGN KEY (account_id) REFERENCES account (id)
);
CREATE INDEX by_name ON account (name);
"""
_AGAIN = "CREATE TABLE account (id BIGINT, name TEXT, PRIMARY KEY (id));\n"
_AFTER = """CREATE TABLE account (id BIGINT, name VARCHAR({w}), note TEXT DEFAULT 'z', email TEXT, PRIMARY KEY (id));
CREATE TABLE "Order Line" (id BIGINT NOT NULL, account_id BIGINT, qty INTEGER);
"""


def _filled(template: str) -> Column:
    db = F.col("schema_id")
    values = {"{db}": db, "{v}": 50 + db % 7, "{s}": db % 5, "{w}": 50 + (db + 1) % 7}
    text = F.lit(template)
    for name, value in values.items():
        if name in template:
            text = F.replace(text, F.lit(name), value.cast("string"))
    return text


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(schema_id): one row per database."""
    return read_table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {DB_PER_CUSTOMER_DIV}").alias("schema_id")).distinct()


def dumps_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.when(F.col("schema_id") % 4 == 0, F.lit(_AGAIN)).otherwise(F.lit(""))
    return databases(spark, sf_dir).select("schema_id", F.concat(_filled(_BEFORE), again).alias("text"))


def dumps_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return databases(spark, sf_dir).select("schema_id", _filled(_AFTER).alias("text"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(migration_id, schema_id, table_name, column_name): a name to look up for every order, in its customer's database."""
    key = F.col("o_orderkey")
    pick = [F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int")) for names in (LOOKUP_TABLES, LOOKUP_COLUMNS)]
    return read_table(spark, sf_dir, "orders").select(
        key.alias("migration_id"), F.expr(f"o_custkey div {DB_PER_CUSTOMER_DIV}").alias("schema_id"),
        pick[0].alias("table_name"), pick[1].alias("column_name"))


DATABASES_SQL = f"db AS (SELECT DISTINCT c_custkey // {DB_PER_CUSTOMER_DIV} AS schema_id FROM customer)"
#: Expected columns before the release: where (condition on the database), then the row.
COLUMNS_SQL = """
  SELECT schema_id, 'account' AS table_name, 0 AS column_pos, 'id' AS column_name, 'BIGINT' AS data_type, TRUE AS nullable,
         NULL AS default_value, TRUE AS is_primary_key, NULL AS "references" FROM db
  UNION ALL SELECT schema_id, 'account', 1, 'name', 'VARCHAR(' || (50 + schema_id % 7) || ')', FALSE, NULL, FALSE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'account', 1, 'name', 'TEXT', TRUE, NULL, FALSE, NULL FROM db WHERE schema_id % 4 = 0
  UNION ALL SELECT schema_id, 'account', 2, 'balance', 'NUMERIC(18, ' || (schema_id % 5) || ')', TRUE, '0.0', FALSE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'account', 3, 'note', 'TEXT', TRUE, '''a, b; (c''', FALSE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'Order Line', 0, 'id', 'BIGINT', FALSE, NULL, FALSE, NULL FROM db
  UNION ALL SELECT schema_id, 'Order Line', 1, 'account_id', 'BIGINT', TRUE, NULL, FALSE, 'account.id' FROM db
  UNION ALL SELECT schema_id, 'Order Line', 2, 'qty', 'INTEGER', TRUE, NULL, FALSE, NULL FROM db"""
CHANGES_SQL = """
  SELECT schema_id, 'account' AS table_name, 'name' AS column_name, 'type_changed' AS change_type,
         CASE WHEN schema_id % 4 = 0 THEN 'TEXT' ELSE 'VARCHAR(' || (50 + schema_id % 7) || ')' END AS before,
         'VARCHAR(' || (50 + (schema_id + 1) % 7) || ')' AS after, TRUE AS breaking, schema_id % 4 <> 0 AS same_family FROM db
  UNION ALL SELECT schema_id, 'account', 'name', 'nullable_changed', 'false', 'true', FALSE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'account', 'balance', 'removed', 'NUMERIC(18, ' || (schema_id % 5) || ')', NULL, TRUE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'account', 'note', 'default_changed', '''a, b; (c''', '''z''', FALSE, NULL FROM db WHERE schema_id % 4 <> 0
  UNION ALL SELECT schema_id, 'account', 'note', 'added', NULL, 'TEXT', FALSE, NULL FROM db WHERE schema_id % 4 = 0
  UNION ALL SELECT schema_id, 'account', 'email', 'added', NULL, 'TEXT', FALSE, NULL FROM db"""
