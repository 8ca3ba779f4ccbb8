"""Pre-flight data checks (V1-V4): what the lock notes only describe, run on the data.

* V1 ``fk_orphans``: child rows whose foreign key has no parent — counted
  per key, then a merge join of the distinct keys.
* V2 ``constraint_violations``: primary-key duplicates (``groupBy(key)``
  with map-side combined counts, so a hot key is reduced before the
  shuffle) and NOT NULL violations (``count_if``), one scan per table.
* V3 ``cast_audit``: values a column type change would alter — one scan per
  table with a ``count_if`` per column.
* V4 ``not_null_nonempty``: ADD COLUMN ... NOT NULL without DEFAULT on a
  table that has rows (turns the warning into a fact).

The lists of keys and columns come from the catalogue definition (schema
metadata, not data); every check reads whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.session import read_table

NUMERIC_TYPES = ("bigint", "int", "double", "float", "smallint", "tinyint")
# target types of the audit: NUMERIC(18,4) for numbers, VARCHAR(n) for text, DATE for timestamps
NUMERIC_PRECISION, NUMERIC_SCALE = 18, 4
VARCHAR_LENGTH = 100


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_orphans(spark: SparkSession, sf_dir: str, foreign_keys) -> DataFrame:
    """V1: (fk_name, child_table, child_column, parent_table, child_rows, orphan_rows) per foreign key.

    Child rows are counted per key first (map-side combined, so a hot or null
    key is one row per task), then the distinct keys meet the distinct parent keys.
    """
    parts = []
    for child, col, parent, pcol in foreign_keys:
        c = read_table(spark, sf_dir, child).groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        # distinct parent keys: the join cannot fan out; a missing parent leaves _hit null
        p = read_table(spark, sf_dir, parent).select(F.col(pcol).alias("_k")).distinct() \
            .withColumn("_hit", F.lit(True))
        j = c.join(p.hint("merge"), "_k", "left")   # parent keys grow with the data
        orphan = F.col("_k").isNotNull() & F.col("_hit").isNull()
        counts = j.groupBy().agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("child_rows"),
                                 F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).alias("orphan_rows"))
        parts.append(counts.select(F.lit(f"{child}.{col}->{parent}.{pcol}").alias("fk_name"),
                                   F.lit(child).alias("child_table"), F.lit(col).alias("child_column"),
                                   F.lit(parent).alias("parent_table"), "child_rows", "orphan_rows"))
    return _union(parts)


def constraint_violations(spark: SparkSession, sf_dir: str, primary_keys: dict, not_null: dict) -> DataFrame:
    """V2: (table_name, check_name, violating_rows, violating_keys) for PK uniqueness and NOT NULL."""
    parts = []
    for table, keys in primary_keys.items():
        df = read_table(spark, sf_dir, table)
        dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        parts.append(dup.groupBy().agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violating_rows"),
            F.count(F.lit(1)).alias("violating_keys"),
        ).select(F.lit(table).alias("table_name"), F.lit("primary_key(" + ",".join(keys) + ")").alias("check_name"),
                 "violating_rows", "violating_keys"))
    for table, cols in not_null.items():
        df = read_table(spark, sf_dir, table)
        agg = df.groupBy().agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(f"not_null({c})").alias("check_name"), F.col(c).cast("long").alias("violating_rows"))
            for c in cols])).alias("_v")).select(
            F.lit(table).alias("table_name"), "_v.check_name", "_v.violating_rows",
            F.col("_v.violating_rows").alias("violating_keys")))
    return _union(parts)


def lossy(value: Column, source: str, target: str) -> Column:
    """Does a non-null value change when its column becomes ``target``?

    VARCHAR(n) and CHAR(n): longer than n (a Spark cast would not truncate).
    Any other type: the cast fails, or casting back gives another value.
    """
    length = re.fullmatch(r"(?i)(?:VAR)?CHAR(?:ACTER)?(?: VARYING)?\((\d+)\)", target.strip())
    if length:
        return F.length(value.cast("string")) > int(length[1])
    name = re.sub(r"(?i)^NUMERIC", "DECIMAL", target.strip())
    there = value.try_cast(name)
    return value.isNotNull() & (there.isNull() | ~there.try_cast(source).eqNullSafe(value))


def cast_audit_to(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """V3 with the caller's targets: (column_name, target_type, non_null_rows, lossy_rows, first_lossy) of ``{column: type}``."""
    types = dict(df.dtypes)
    aggs = []
    for i, (c, target) in enumerate(targets.items()):
        bad = lossy(F.col(c), types[c], target)
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(bad).alias(f"l{i}"), F.min(F.when(bad, F.col(c))).cast("string").alias(f"f{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(target).alias("target_type"), F.col(f"n{i}").alias("non_null_rows"),
                     F.col(f"l{i}").alias("lossy_rows"), F.col(f"f{i}").alias("first_lossy")) for i, (c, target) in enumerate(targets.items())]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def check_violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """V2 for CHECK predicates: (check_name, violating_rows) of ``{name: SQL predicate}``; a null result does not violate."""
    aggs = [F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias(f"v{i}") for i, p in enumerate(checks.values())]
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(f"v{i}").alias("violating_rows")) for i, name in enumerate(checks)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str, limit: int = 10) -> DataFrame:
    """V1 sample: the ``limit`` most frequent foreign keys without a parent (key, child_rows); ties to the smaller key."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(F.col(parent_column).alias("key")).distinct()
    return keys.join(known.hint("merge"), "key", "left_anti").orderBy(F.col("child_rows").desc(), "key").limit(limit)


def cast_audit(spark: SparkSession, sf_dir: str, tables: dict) -> DataFrame:
    """V3: (table_name, column_name, target_type, non_null_rows, lossy_rows).

    Numbers -> NUMERIC(18,4): lossy if out of range or more than 4 decimals.
    Text -> VARCHAR(100): lossy if longer (a Spark cast to varchar would not
    truncate, so the length is tested explicitly).  Timestamps -> DATE: lossy
    if the time of day is not midnight.
    """
    parts = []
    limit = 10.0 ** (NUMERIC_PRECISION - NUMERIC_SCALE)
    for table, cols in tables.items():
        df = read_table(spark, sf_dir, table)
        types = dict(df.dtypes)
        entries = []
        for c in cols:
            t, v = types[c], F.col(c)
            if t in NUMERIC_TYPES:
                target = f"NUMERIC({NUMERIC_PRECISION},{NUMERIC_SCALE})"
                lossy = (F.abs(v.cast("double")) >= limit) | (F.round(v.cast("double"), NUMERIC_SCALE) != v.cast("double"))
            elif t == "string":
                target, lossy = f"VARCHAR({VARCHAR_LENGTH})", F.length(v) > VARCHAR_LENGTH
            elif t.startswith("timestamp"):
                target, lossy = "DATE", F.date_trunc("day", v) != v
            else:
                continue
            entries.append((c, t, target, F.count(v).alias(f"n__{c}"), F.count_if(v.isNotNull() & lossy).alias(f"l__{c}")))
        agg = df.groupBy().agg(*[x for e in entries for x in e[3:]])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(tg).alias("target_type"),
                     F.col(f"n__{c}").cast("long").alias("non_null_rows"),
                     F.col(f"l__{c}").cast("long").alias("lossy_rows"))
            for c, t, tg, *_ in entries])).alias("_a")).select(F.lit(table).alias("table_name"), "_a.*"))
    return _union(parts)


def not_null_nonempty(ops: DataFrame) -> DataFrame:
    """V4: ADD COLUMN NOT NULL without DEFAULT, with the table's real row count.

    ``ops`` must carry ``row_count`` (from the lock stage).
    """
    danger = F.coalesce(F.array_contains("parser_notes", fixed.NOTE_NOT_NULL_NO_DEFAULT), F.lit(False))
    return ops.filter((F.col("op_class") == "ADD_COLUMN") & danger).select(
        "migration_id", F.col("stmt_pos").cast("long").alias("stmt_pos"),
        F.col("action_pos").cast("long").alias("action_pos"), "target_table", "target_column", "row_count",
        F.coalesce(F.col("row_count") > 0, F.lit(False)).alias("will_fail"),
    )
