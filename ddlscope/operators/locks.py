"""Lock type and duration (L1-L4).

The lock rules are data: an 18-row DataFrame joined to the operations on
``op_class`` with a residual condition on dialect group, version and clause
flags.  The rule conditions are mutually exclusive, so the left join yields
exactly one row per operation; a miss takes the fallback row.  The rule
table has a fixed size and is broadcast explicitly; row counts come from a
left join with ``table_stats`` by exact table name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.functions.text import fill
from ddlscope.session import broadcast_if_small, written

LOCK_RULE_SCHEMA = (
    "rule_id int, rule_class string, dialects array<string>, min_v int, max_v int, "
    "need_default boolean, need_not_null boolean, need_concurrent boolean, lock_type string, "
    "risk_level string, rate long, fixed_min double, fixed_max double, rule_note string, "
    "size_note boolean, large_note boolean"
)


#: Rows a minute that the rules reckon with.
RATES = sorted({dict(zip((c.split()[0] for c in LOCK_RULE_SCHEMA.split(", ")), rule))["rate"] or 0 for rule in fixed.LOCK_RULES} - {0})


def lock_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.LOCK_RULES, LOCK_RULE_SCHEMA)


def dialect_group(dialect: Column) -> Column:
    d = F.lower(dialect)
    return F.when(d.isin("postgres", "postgresql"), "pg").when(d == "mysql", "mysql").otherwise("other")


def clause_flags(ops: DataFrame, flags: str = "notes") -> DataFrame:
    """DEFAULT / NOT NULL / CONCURRENTLY flags.

    ``flags='notes'`` (default) reads them off the notes the way the tool
    does: any note containing "default" (any case), any containing
    "NOT NULL", any containing "CONCURRENTLY FLAG" (any case).
    ``flags='clause'`` uses what the statement actually says.
    """
    notes = F.coalesce(F.col("parser_notes"), F.array().cast("array<string>"))
    if flags == "notes":
        # any note containing ...: the notes joined by a separator no pattern spans
        joined = F.array_join(notes, "\u0001")
        d = F.lower(joined).contains("default")
        n = joined.contains("NOT NULL")
        c = F.upper(joined).contains("CONCURRENTLY FLAG")
    elif flags == "clause":
        d, n, c = F.col("has_default"), F.col("has_not_null"), F.col("is_concurrent")
    else:
        raise ValueError(f"flags must be 'notes' or 'clause', not {flags!r}")
    return ops.withColumn("_d", d).withColumn("_n", n).withColumn("_c", c)


def duration_bounds(rows: Column, rate: Column) -> tuple[Column, Column]:
    """L2: (round(mid*0.7, 2), round(mid*1.8, 2)) with mid = rows / rate; null rows -> nulls."""
    mid = rows.cast("double") / rate.cast("double")
    return (F.round(mid * fixed.DURATION_LOW_FACTOR, 2), F.round(mid * fixed.DURATION_HIGH_FACTOR, 2))


def _py_float(c: Column) -> Column:
    """Text of a double as Python prints it for the values the model produces."""
    return F.when(c == F.floor(c), F.format_string("%.1f", c)).otherwise(c.cast("string"))


def table_sizes(table_stats: DataFrame, by: list[str] = []) -> DataFrame:
    """(_schema_id, _tn, _rate, row_count, _min, _max, _size, _large): bounds and note texts of every table under every rate of the rules, 0 for none.

    Numbers are turned to text here, once for a table, and not for each of its operations.
    """
    stats = table_stats.groupBy(*(F.col(k).alias(f"_{k}") for k in by), F.col("table_name").alias("_tn")).agg(F.max("row_count").alias("row_count"))
    rated = stats.select("*", F.explode(F.array(*(F.lit(r).cast("long") for r in (0, *RATES)))).alias("_rate"))
    low, high = duration_bounds(F.col("row_count"), F.when(F.col("_rate") != 0, F.col("_rate")))
    rated = rated.select("*", low.alias("_min"), high.alias("_max"))
    rows = F.col("row_count")
    told = F.format_number(rows, 0)
    size = F.when(F.coalesce(rows, F.lit(0)) != 0, fill(fixed.LOCK_NOTE_ESTIMATE, min=_py_float(F.col("_min")), max=_py_float(F.col("_max")), rows=told)) \
        .otherwise(F.lit(fixed.LOCK_NOTE_SIZE_UNKNOWN))
    return rated.select("*", size.alias("_size"), F.when(rows > fixed.LARGE_TABLE_ROWS, fill(fixed.LOCK_NOTE_LARGE_TABLE, rows=told)).alias("_large"))


def _one_or_none(note: Column) -> Column:
    return F.when(note.isNull(), F.array().cast("array<string>")).otherwise(F.array(note))


def apply_lock_analysis(ops: DataFrame, table_stats: DataFrame, spark: SparkSession | None = None,
                        db_version: Column | int | None = None, flags: str = "notes") -> DataFrame:
    """L4: attach row counts and the lock rule to every operation.

    ``ops`` needs op_class, target_table, dialect, parser_notes and either a
    ``db_version`` column or the ``db_version`` argument (default 14).
    ``table_stats`` has (table_name, row_count), or with a ``schema_id`` where
    databases hold tables of one name; operations then need theirs.
    Adds: row_count, lock_type, risk_level, duration_min, duration_max,
    lock_notes, notes (parser notes followed by lock notes).
    """
    spark = spark or ops.sparkSession
    if "db_version" not in ops.columns:
        ops = ops.withColumn("db_version", F.lit(14 if db_version is None else db_version).cast("int"))
    by = ["schema_id"] if "schema_id" in ops.columns and "schema_id" in table_stats.columns else []
    stats = broadcast_if_small(written(table_sizes(table_stats, by), "table-stats"))
    o = clause_flags(ops, flags).withColumn("_dg", dialect_group(F.col("dialect")))
    rules = F.broadcast(lock_rules(spark))   # fixed 20-row table
    cond = (
        (o.op_class == rules.rule_class)
        & F.array_contains(rules.dialects, o._dg)
        & (rules.min_v.isNull() | (o.db_version >= rules.min_v))
        & (rules.max_v.isNull() | (o.db_version < rules.max_v))
        & (rules.need_default.isNull() | (rules.need_default == o._d))
        & (rules.need_not_null.isNull() | (rules.need_not_null == o._n))
        & (rules.need_concurrent.isNull() | (rules.need_concurrent == o._c))
    )
    j = o.join(rules, cond, "left")
    # one row per (schema,) table and rate: the left join cannot fan out
    same = (F.col("target_table") == F.col("_tn")) & (F.coalesce("rate", F.lit(0)) == F.col("_rate"))
    for k in by:
        same = same & (F.col(k) == F.col(f"_{k}"))
    j = j.join(stats, same, "left")
    matched = F.col("rule_id").isNotNull()
    dmin = F.when(F.col("rate").isNotNull(), F.col("_min")).otherwise(F.col("fixed_min"))
    dmax = F.when(F.col("rate").isNotNull(), F.col("_max")).otherwise(F.col("fixed_max"))
    rule_note = F.replace(F.col("rule_note"), F.lit("{v}"), F.col("db_version").cast("string"))
    size_note = F.when(F.col("size_note"), F.when(F.col("row_count").isNull(), F.lit(fixed.LOCK_NOTE_SIZE_UNKNOWN)).otherwise(F.col("_size")))
    large_note = F.when(F.col("large_note"), F.col("_large"))
    lock_notes = F.when(matched, F.concat(*(_one_or_none(F.col(f"_{n}")) for n in range(3)))) \
        .otherwise(F.array(F.lit(fixed.LOCK_NOTE_FALLBACK)))
    # the notes are columns first and their list is put together without a lambda, which Spark wouldn't compile
    j = j.select("*", rule_note.alias("_0"), size_note.alias("_1"), large_note.alias("_2"))
    out = j.select(
        *[F.col(c) for c in o.columns if not c.startswith("_")], "row_count",
        F.when(matched, F.col("lock_type")).otherwise(F.lit(fixed.FALLBACK_LOCK[0])).alias("lock_type"),
        F.when(matched, F.col("risk_level")).otherwise(F.lit(fixed.FALLBACK_LOCK[1])).alias("risk_level"),
        F.when(matched, dmin).alias("duration_min"),
        F.when(matched, dmax).alias("duration_max"),
        lock_notes.alias("lock_notes"),
    )
    return out.withColumn("notes", F.concat(F.coalesce("parser_notes", F.array().cast("array<string>")),
                                            F.col("lock_notes")))
