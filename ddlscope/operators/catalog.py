"""Catalogue (schema snapshot) from schema dumps.

A dump is split into statements; each CREATE TABLE body is split at
depth-0 commas into column definitions and table constraints; CREATE
INDEX statements give indexes.  Outputs are two long DataFrames:

* ``catalog_columns``: schema_id, table_name, column_pos, column_name,
  data_type, nullable, default_value, is_primary_key, references
* ``catalog_indexes``: schema_id, index_name, table_name, columns,
  is_unique, is_concurrent

Named constraints and column-level PRIMARY KEY / REFERENCES are not carried,
as in the tool.  Lookups (C4, C5) are joins on unique keys, so they never
fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ddlscope.functions import lexer, patterns
from ddlscope.functions.text import py_strip
from ddlscope.session import broadcast_if_small

_CREATE_TABLE = (r"(?is)^\s*CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+)?(?:UNLOGGED\s+)?TABLE\s+"
                 r"(?:IF\s+NOT\s+EXISTS\s+)?(" + lexer.NAME + r")\s*\((.*)\)[^()]*$")
_CREATE_INDEX = (r"(?is)^\s*CREATE\s+(UNIQUE\s+)?INDEX\s+(CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?"
                 + "(" + lexer.NAME + r")\s+ON\s+(?:ONLY\s+)?(" + lexer.NAME + ")"
                 + r"\s*(?:USING\s+\w+\s*)?\((.*)\)")
_CONSTRAINT_WORDS = r"(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|REFERENCES|UNIQUE|CHECK|CONSTRAINT|COLLATE|GENERATED)"
_COLUMN_DEF = r"(?is)^(" + lexer.PART + r")\s+(.*?)\s*(?:\b" + _CONSTRAINT_WORDS + r"\b.*)?$"
_DEFAULT = r"(?is)\bDEFAULT\s+(.*?)\s*(?:\b(?:NOT\s+NULL|NULL|PRIMARY\s+KEY|REFERENCES|UNIQUE|CHECK|CONSTRAINT|COLLATE)\b.*)?$"
_PK = r"(?is)^PRIMARY\s+KEY\s*\((.*)\)"
_FK = r"(?is)^FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+(" + lexer.NAME + r")\s*\(([^)]*)\)"


def _dump_statements(dumps: DataFrame) -> DataFrame:
    """(schema_id, stmt_pos, stmt); a schema may come in several dumps, ordered by a column ``part``."""
    part = F.col("part").cast("string") if "part" in dumps.columns else F.lit("")
    s = dumps.select("schema_id", part.alias("part"),
                     F.posexplode(F.expr(lexer.statements(lexer.strip_comments("text")))).alias("pos", "stmt"))
    return s.select("schema_id", F.struct("part", "pos").alias("stmt_pos"), py_strip(F.col("stmt")).alias("stmt")) \
        .filter(F.length("stmt") > 0)


def _name_list(c: Column) -> Column:
    """'a, "b" , c' -> [a, b, c]."""
    return F.transform(F.split(c, ","), lambda x: F.regexp_replace(py_strip(x), r'["`\[\]]', ""))


def _created(stmts: DataFrame) -> DataFrame:
    """(schema_id, table_name, stmt_pos, body), the last CREATE TABLE of each table."""
    t = stmts.filter(F.col("stmt").rlike(_CREATE_TABLE)).select(
        "schema_id", lexer.name_of(F.regexp_extract("stmt", _CREATE_TABLE, 1)).alias("table_name"),
        F.struct("stmt_pos", F.regexp_extract("stmt", _CREATE_TABLE, 2).alias("body")).alias("last"))
    return t.groupBy("schema_id", "table_name").agg(F.max("last").alias("last")).select("schema_id", "table_name", "last.*")


def _table_items(stmts: DataFrame) -> DataFrame:
    return _created(stmts).select("schema_id", "table_name", F.posexplode(F.expr(lexer.split_top("body"))).alias("item_pos", "item")) \
        .filter(F.length("item") > 0)


def catalog_tables(dumps: DataFrame) -> DataFrame:
    """(schema_id, table_name, stmt_pos) — one row per table, at its last CREATE TABLE."""
    return _created(_dump_statements(dumps)).select("schema_id", "table_name", "stmt_pos")


def catalog_columns(dumps: DataFrame) -> DataFrame:
    """C1 + C2: column rows with table-level PRIMARY KEY and FOREIGN KEY applied."""
    items = _table_items(_dump_statements(dumps))
    is_key = F.col("item").rlike(r"(?is)^(?:PRIMARY\s+KEY|FOREIGN\s+KEY|CONSTRAINT|UNIQUE|CHECK|EXCLUDE)\b")
    cols = items.filter(~is_key).select(
        "schema_id", "table_name", F.col("item_pos").alias("column_pos"),
        lexer.name_of(F.regexp_extract("item", _COLUMN_DEF, 1)).alias("column_name"),
        F.upper(F.regexp_replace(F.regexp_extract("item", _COLUMN_DEF, 2), r"\s+", " ")).alias("data_type"),
        (~F.expr(lexer.outside_parentheses("item")).rlike(patterns.NOT_NULL)).alias("nullable"),
        F.when(F.expr(lexer.outside_parentheses("item")).rlike(patterns.DEFAULT), F.regexp_extract("item", _DEFAULT, 1)).alias("default_value"),
    ).filter(F.col("column_name") != "")
    # a column named twice keeps its last definition
    rest = ["column_pos", "data_type", "nullable", "default_value"]
    cols = cols.groupBy("schema_id", "table_name", "column_name").agg(F.max(F.struct(*rest)).alias("last")) \
        .select("schema_id", "table_name", "column_name", "last.*")
    pk = items.filter(F.col("item").rlike(_PK)).select(
        "schema_id", "table_name", F.explode(_name_list(F.regexp_extract("item", _PK, 1))).alias("column_name"),
    ).distinct().withColumn("is_primary_key", F.lit(True))
    fk = items.filter(F.col("item").rlike(_FK)).select(
        "schema_id", "table_name", "item_pos",
        F.element_at(_name_list(F.regexp_extract("item", _FK, 1)), 1).alias("column_name"),
        F.concat(lexer.name_of(F.regexp_extract("item", _FK, 2)), F.lit("."),
                 F.element_at(_name_list(F.regexp_extract("item", _FK, 3)), 1)).alias("references"),
    )
    # the last FOREIGN KEY naming a column wins, as repeated assignment does
    fk = fk.groupBy("schema_id", "table_name", "column_name").agg(
        F.max_by("references", "item_pos").alias("references"))
    keys = ["schema_id", "table_name", "column_name"]
    out = cols.join(pk, keys, "left").join(fk, keys, "left")
    return out.select("schema_id", "table_name", "column_pos", "column_name", "data_type", "nullable",
                      "default_value", F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
                      "references")


def catalog_indexes(dumps: DataFrame) -> DataFrame:
    """CREATE INDEX rows whose table was created earlier in the same dump."""
    stmts = _dump_statements(dumps)
    idx = stmts.filter(F.col("stmt").rlike(_CREATE_INDEX)).select(
        "schema_id", F.col("stmt_pos").alias("idx_pos"),
        lexer.name_of(F.regexp_extract("stmt", _CREATE_INDEX, 3)).alias("index_name"),
        lexer.name_of(F.regexp_extract("stmt", _CREATE_INDEX, 4)).alias("table_name"),
        _name_list(F.regexp_extract("stmt", _CREATE_INDEX, 5)).alias("columns"),
        (F.regexp_extract("stmt", _CREATE_INDEX, 1) != "").alias("is_unique"),
        (F.regexp_extract("stmt", _CREATE_INDEX, 2) != "").alias("is_concurrent"),
    )
    tables = catalog_tables(dumps)
    kept = idx.join(tables, (idx.schema_id == tables.schema_id) & (idx.table_name == tables.table_name)
                    & (tables.stmt_pos < idx.idx_pos), "left_semi")
    rest = [F.transform("columns", lambda c: F.regexp_replace(c, r"\s+(?i:ASC|DESC)$", "")).alias("columns"), "is_unique", "is_concurrent"]
    # an index defined twice keeps its last definition
    return kept.groupBy("schema_id", "table_name", "index_name").agg(F.max(F.struct("idx_pos", *rest)).alias("last")) \
        .select("schema_id", "index_name", "table_name", "last.columns", "last.is_unique", "last.is_concurrent")


def _keys(df: DataFrame, lookup: DataFrame) -> list[str]:
    """A lookup is per schema where the rows name theirs; without, the catalogue must be of one schema."""
    return ["schema_id"] if "schema_id" in df.columns and "schema_id" in lookup.columns else []


def lookup_table(df: DataFrame, table_col: str, tables: DataFrame, out_col: str = "catalog_table") -> DataFrame:
    """C4: catalogue key of a table name in the row's schema — exact, else the lower-cased name.

    The lookup has one row per (schema, name), so neither join fans out.
    """
    by = _keys(df, tables)
    names = broadcast_if_small(tables.select(*by, "table_name").distinct())
    exact, lower = (names.select(*[F.col(k).alias(f"{p}_{k}") for k in by], F.col("table_name").alias(p)) for p in ("_exact", "_lower"))

    def same(p, value):
        cond = value == F.col(p)
        for k in by:
            cond = cond & (df[k] == F.col(f"{p}_{k}"))
        return cond

    j = df.join(exact, same("_exact", F.col(table_col)), "left").join(lower, same("_lower", F.lower(F.col(table_col))), "left")
    return j.withColumn(out_col, F.coalesce("_exact", "_lower")).drop("_exact", "_lower", *[f"{p}_{k}" for k in by for p in ("_exact", "_lower")])


def has_column(df: DataFrame, table_col: str, column_col: str, columns: DataFrame,
               out_col: str = "column_present") -> DataFrame:
    """The (already looked-up) table of the row's schema has the column, exact or lower-cased.

    Two left joins on unique keys: every row comes back once, nulls in any column included.
    """
    by = _keys(df, columns)
    names = columns.select(*by, "table_name", "column_name").distinct()
    out = df
    for p, value in (("_e", F.col(column_col)), ("_l", F.lower(F.col(column_col)))):
        hit = names.select(*[F.col(k).alias(f"{p}_{k}") for k in by], F.col("table_name").alias(f"{p}_t"),
                           F.col("column_name").alias(f"{p}_c"))
        cond = (F.col(table_col) == F.col(f"{p}_t")) & (value == F.col(f"{p}_c"))
        for k in by:
            cond = cond & (F.col(k) == F.col(f"{p}_{k}"))
        out = out.join(hit, cond, "left")
    found = F.col("_e_c").isNotNull() | F.col("_l_c").isNotNull()
    return out.withColumn(out_col, found).drop(*[f"{p}_{x}" for p in ("_e", "_l") for x in ("t", "c", *by)])


def base_type(t: Column) -> Column:
    """C6 helper: text before '(' trimmed and lower-cased."""
    return F.lower(py_strip(F.substring_index(t, "(", 1)))


def full_type(t: Column) -> Column:
    """A type with its length or precision, blanks and case aside."""
    return F.lower(F.regexp_replace(t, r"\s+", ""))


def type_compatible(a: Column, b: Column) -> Column:
    """Same base type family."""
    return base_type(a) == base_type(b)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added / removed / type_changed / nullable_changed / default_changed columns.

    Full outer join of two ``catalog_columns`` on (schema, table, column); equal
    rows drop out.  Types are compared in full: a narrower VARCHAR is a change
    (whether two types are of one family is C6).  One row per change kind.
    """
    keys = [*_keys(before, after), "table_name", "column_name"]
    b = before.select(*keys[:-2], "table_name", "column_name", F.col("data_type").alias("b_type"),
                      F.col("nullable").alias("b_null"), F.col("default_value").alias("b_default"))
    a = after.select(*keys, F.col("data_type").alias("a_type"),
                     F.col("nullable").alias("a_null"), F.col("default_value").alias("a_default"))
    j = b.join(a, keys, "full_outer")
    changes = F.filter(F.array(
        F.when(F.col("b_type").isNull(), F.struct(F.lit("added").alias("change_type"), F.lit(None).cast("string")
                                                   .alias("before"), F.col("a_type").alias("after"))),
        F.when(F.col("a_type").isNull(), F.struct(F.lit("removed").alias("change_type"), F.col("b_type").alias("before"),
                                                   F.lit(None).cast("string").alias("after"))),
        F.when(F.col("a_type").isNotNull() & F.col("b_type").isNotNull() & (full_type(F.col("a_type")) != full_type(F.col("b_type"))),
               F.struct(F.lit("type_changed").alias("change_type"), F.col("b_type").alias("before"),
                        F.col("a_type").alias("after"))),
        F.when(F.col("a_type").isNotNull() & F.col("b_type").isNotNull() & ~F.col("a_null").eqNullSafe(F.col("b_null")),
               F.struct(F.lit("nullable_changed").alias("change_type"), F.col("b_null").cast("string").alias("before"),
                        F.col("a_null").cast("string").alias("after"))),
        F.when(F.col("a_type").isNotNull() & F.col("b_type").isNotNull() & ~F.col("a_default").eqNullSafe(F.col("b_default")),
               F.struct(F.lit("default_changed").alias("change_type"), F.col("b_default").alias("before"),
                        F.col("a_default").alias("after"))),
    ), lambda x: x.isNotNull())
    out = j.select(*keys, F.explode(changes).alias("ch"))
    breaking = F.col("ch.change_type").isin("removed", "type_changed") | (
        (F.col("ch.change_type") == "nullable_changed") & (F.col("ch.after") == "false"))
    return out.select(*keys, "ch.change_type", "ch.before", "ch.after",
                      breaking.alias("breaking"))

