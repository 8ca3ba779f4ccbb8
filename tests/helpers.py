"""Small builders for unit tests: scripts and operations as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ddlscope.operators import extract

OPS_SCHEMA = (
    "migration_id long, stmt_pos int, action_pos int, op_class string, target_table string, "
    "target_column string, target_index string, dialect string, raw_sql string, parser_notes array<string>, "
    "has_not_null boolean, has_default boolean, is_concurrent boolean, db_version int"
)


def scripts(spark: SparkSession, *texts: str, dialect: str = "postgres") -> DataFrame:
    rows = [(i, t, dialect) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "migration_id long, text string, dialect string")


def parse(spark: SparkSession, sql: str, dialect: str = "postgres") -> list:
    """Operations of one script, in statement order, as Rows."""
    ops = extract.extract_operations(scripts(spark, sql, dialect=dialect))
    return ops.orderBy("stmt_pos", "action_pos").collect()


def make_ops(spark: SparkSession, specs, dialect: str = "postgres", db_version: int = 14,
             table: str = "users", column: str | None = "col") -> DataFrame:
    """specs: list of (op_class, notes) or op_class strings — one migration, in order."""
    rows = []
    for i, spec in enumerate(specs):
        cls, notes = (spec, []) if isinstance(spec, str) else spec
        rows.append((0, i, 0, cls, table, column, None, dialect, "", list(notes), False, False, False, db_version))
    return spark.createDataFrame(rows, OPS_SCHEMA)


def stats(spark: SparkSession, counts: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(list((counts or {}).items()), "table_name string, row_count long")


def migrations(spark: SparkSession, ids=(0,)) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "migration_id long")
