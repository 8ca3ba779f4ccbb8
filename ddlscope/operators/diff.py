"""Schema changes of each operation against the before-catalogue.

Every operation is compared with the original catalogue (changes are not
applied cumulatively), so the stage is row-parallel: left joins against the
catalogue on unique keys, then column expressions.  Output is one long
``changes`` DataFrame:

    migration_id, stmt_pos, action_pos, object_kind (table|column|index|constraint),
    change_type, table_name, column_name, index_name, index_columns,
    constraint_name, constraint_type, before, after, breaking
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ddlscope.operators.catalog import lookup_table
from ddlscope.session import broadcast_if_small

_COLUMN_CHANGE = {"ADD_COLUMN": "added", "DROP_COLUMN": "removed", "ALTER_COLUMN": "type_changed",
                  "RENAME_COLUMN": "renamed"}
_TABLE_CHANGE = {"RENAME_TABLE": "renamed", "CREATE_TABLE": "added", "DROP_TABLE": "removed",
                 "TRUNCATE_TABLE": "truncated"}


def _case(col, mapping):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def schema_changes(ops: DataFrame, catalog_columns: DataFrame, catalog_indexes: DataFrame) -> DataFrame:
    """D1-D6 against the before-snapshot of each row's schema (``schema_id``, where the operations name one)."""
    by = ["schema_id"] if "schema_id" in ops.columns else []
    tables = catalog_columns.select(*by, "table_name").distinct()
    o = ops.select("migration_id", "stmt_pos", "action_pos", *by, "op_class", "target_table", "target_column",
                   "target_index", "parser_notes")
    o = o.filter(F.col("op_class").isin(*_COLUMN_CHANGE, *_TABLE_CHANGE, "CREATE_INDEX", "DROP_INDEX",
                                        "ADD_CONSTRAINT", "ADD_FOREIGN_KEY"))
    o = lookup_table(o, "target_table", tables, "before_table")

    def same_schema(key):
        return F.col("schema_id") == F.col(key) if by else F.lit(True)

    # D3: type of a dropped column, exact column name within the found table (unique in the catalogue)
    cols = catalog_columns if by else catalog_columns.dropDuplicates(["table_name", "column_name"])
    cols = broadcast_if_small(cols.select(F.col("schema_id").alias("_cs"), F.col("table_name").alias("_ct"),
                                          F.col("column_name").alias("_cc"), F.col("data_type").alias("_ctype")))
    o = o.join(cols, (F.col("op_class") == "DROP_COLUMN") & (F.col("before_table") == F.col("_ct"))
               & (F.col("target_column") == F.col("_cc")) & same_schema("_cs"), "left")
    # Columns of a dropped index, exact index name within the found table
    idx = catalog_indexes if by else catalog_indexes.dropDuplicates(["table_name", "index_name"])
    idx = broadcast_if_small(idx.select(F.col("schema_id").alias("_is"), F.col("table_name").alias("_it"),
                                        F.col("index_name").alias("_in"), F.col("columns").alias("_icols")))
    o = o.join(idx, (F.col("op_class") == "DROP_INDEX") & (F.col("before_table") == F.col("_it"))
               & (F.col("target_index") == F.col("_in")) & same_schema("_is"), "left")

    cls = F.col("op_class")
    col_or_empty = F.coalesce(F.col("target_column"), F.lit(""))
    has_danger = F.array_join(F.coalesce("parser_notes", F.array().cast("array<string>")), "\u0001") \
        .contains("NOT NULL")
    kind = (F.when(cls.isin(*_COLUMN_CHANGE), "column").when(cls.isin(*_TABLE_CHANGE), "table")
            .when(cls.isin("CREATE_INDEX", "DROP_INDEX"), "index").otherwise("constraint"))
    change_type = F.coalesce(_case(cls, _COLUMN_CHANGE), _case(cls, _TABLE_CHANGE),
                             F.when(cls == "CREATE_INDEX", "added").when(cls == "DROP_INDEX", "removed"),
                             F.lit("added"))
    breaking = (F.when(cls == "ADD_COLUMN",
                       F.col("before_table").isNotNull() & (col_or_empty != "") & has_danger)
                .when(cls.isin("DROP_COLUMN", "ALTER_COLUMN", "RENAME_COLUMN"), F.lit(True))
                .otherwise(F.lit(False)))
    index_name = (F.when(cls == "CREATE_INDEX",
                         F.coalesce(F.col("target_index"), F.concat(F.lit("idx_"), F.col("target_table"), F.lit("_new"))))
                  .when(cls == "DROP_INDEX", F.coalesce(F.col("target_index"), F.lit(""))))
    return o.select(
        "migration_id", "stmt_pos", "action_pos", kind.alias("object_kind"), change_type.alias("change_type"),
        F.col("target_table").alias("table_name"),
        F.when(cls.isin(*_COLUMN_CHANGE), col_or_empty).alias("column_name"),
        index_name.alias("index_name"),
        F.when(cls == "DROP_INDEX", F.coalesce(F.col("_icols"), F.array().cast("array<string>")))
        .when(cls == "CREATE_INDEX", F.array().cast("array<string>")).alias("index_columns"),
        F.when(cls.isin("ADD_CONSTRAINT", "ADD_FOREIGN_KEY"), F.concat(F.lit("fk_"), F.col("target_table")))
        .alias("constraint_name"),
        F.when(cls == "ADD_FOREIGN_KEY", "FOREIGN KEY").when(cls == "ADD_CONSTRAINT", "CONSTRAINT")
        .alias("constraint_type"),
        F.when((cls == "DROP_COLUMN") & F.col("_ctype").isNotNull(),
               F.concat(F.col("target_column"), F.lit(" "), F.col("_ctype"))).alias("before"),
        F.when(cls == "ADD_COLUMN", F.col("target_column")).alias("after"),
        breaking.alias("breaking"),
    )


def diff_summary(changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """D7 + D8 per migration (partial aggregates; op-less migrations get zeros)."""
    is_col = F.col("object_kind") == "column"
    agg = changes.groupBy("migration_id").agg(
        F.count_if(F.col("object_kind") == "table").alias("table_changes"),
        F.count_if(is_col).alias("column_changes"),
        F.count_if(F.col("object_kind") == "index").alias("index_changes"),
        F.count_if(F.col("object_kind") == "constraint").alias("constraint_changes"),
        F.count_if(is_col & F.col("breaking")).alias("breaking_changes"),
        F.count_if(is_col & (F.col("change_type") == "removed")).alias("removed_columns"),
        F.count_if((F.col("object_kind") == "index") & (F.col("change_type") == "removed")).alias("removed_indexes"),
        F.count_if(is_col & (F.col("change_type") == "added") & F.col("breaking")).alias("added_not_null_columns"),
    )
    m = migrations.select("migration_id").join(agg.hint("merge"), "migration_id", "left")
    counts = ["table_changes", "column_changes", "index_changes", "constraint_changes", "breaking_changes",
              "removed_columns", "removed_indexes", "added_not_null_columns"]
    out = m.select("migration_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
    return out.withColumn("has_breaking_changes", F.col("breaking_changes") > 0)
