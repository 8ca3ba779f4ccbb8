"""Rollback complexity.

R1 is a broadcast left join to the fixed 16-row rule table.  R2-R6 are
per-migration aggregates that Spark computes partially on the map side
(max, bool_or, count); the ordered step list is kept in long form
(one row per step with its order key) so no migration is ever collected
into a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.functions.text import null_if_empty

ROLLBACK_SCHEMA = "rb_class string, rollback_complexity string, rollback_description string, data_loss boolean"


def rollback_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.ROLLBACK_RULES, ROLLBACK_SCHEMA)


def complexity_rank(c: Column) -> Column:
    expr = None
    for name, rank in fixed.ROLLBACK_RANK.items():
        expr = F.when(c == name, rank) if expr is None else expr.when(c == name, rank)
    return expr


def rank_to_complexity(r: Column) -> Column:
    expr = None
    for name, rank in fixed.ROLLBACK_RANK.items():
        expr = F.when(r == rank, name) if expr is None else expr.when(r == rank, name)
    return expr


def classify_rollback(ops: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Add rollback_complexity, rollback_description, data_loss, rollback_rank."""
    spark = spark or ops.sparkSession
    rules = F.broadcast(rollback_rules(spark))   # fixed 16-row table
    j = ops.join(rules, ops.op_class == rules.rb_class, "left").drop("rb_class")
    d_cx, d_desc, d_loss = fixed.ROLLBACK_DEFAULT
    j = (j.withColumn("rollback_complexity", F.coalesce("rollback_complexity", F.lit(d_cx)))
          .withColumn("rollback_description", F.coalesce("rollback_description", F.lit(d_desc)))
          .withColumn("data_loss", F.coalesce("data_loss", F.lit(d_loss))))
    return j.withColumn("rollback_rank", complexity_rank(F.col("rollback_complexity")))


def rollback_step(ops: DataFrame) -> Column:
    """R4 text of one op: ``CLASS on `label`: description``; label = column, else index, else table."""
    label = F.coalesce(null_if_empty(F.col("target_column")), null_if_empty(F.col("target_index")),
                       F.col("target_table"))
    return F.concat(F.col("op_class"), F.lit(" on `"), label, F.lit("`: "), F.col("rollback_description"))


def rollback_steps(ops: DataFrame) -> DataFrame:
    """R4 in long form: (migration_id, stmt_pos, action_pos, step)."""
    return ops.select("migration_id", "stmt_pos", "action_pos", rollback_step(ops).alias("step"))


def rollback_summary(ops: DataFrame, migrations: DataFrame) -> DataFrame:
    """R2, R3, R5, R6 per migration; op-less migrations are safe / 5 minutes.

    ``migrations`` has one row per migration_id.
    """
    # both sides are partitioned by migration_id already: a merge join needs no exchange
    m = migrations.select("migration_id").join(ops.groupBy("migration_id").agg(*summary_parts()).hint("merge"), "migration_id", "left")
    return m.select("migration_id", *summary_of_parts())


def summary_parts() -> list[Column]:
    """Aggregates over the operations of a migration that its summary is worked out from."""
    return [F.max("rollback_rank").alias("_worst"), F.bool_or("data_loss").alias("_loss"), F.count(F.lit(1)).alias("n_steps")]


def summary_of_parts() -> list[Column]:
    """R2, R3, R5, R6 from ``summary_parts``, which are null for a migration without operations."""
    worst = rank_to_complexity(F.coalesce(F.col("_worst"), F.lit(0)))
    loss = F.coalesce(F.col("_loss"), F.lit(False))
    minutes = None
    for name, mins in fixed.ROLLBACK_MINUTES.items():
        if mins is None:
            continue
        minutes = F.when(worst == name, mins) if minutes is None else minutes.when(worst == name, mins)
    notes = F.regexp_replace(F.concat(
        F.when(loss, F.lit(fixed.ROLLBACK_NOTE_DATA_LOSS)).otherwise(F.lit("")),
        F.when(worst == "none", F.lit(fixed.ROLLBACK_NOTE_IRREVERSIBLE)).otherwise(F.lit("")),
    ), r"^\s+|\s+$", "")
    return [worst.alias("rollback_complexity"), minutes.cast("int").alias("rollback_minutes"), loss.alias("data_loss_risk"),
            notes.alias("rollback_notes"), F.coalesce(F.col("n_steps"), F.lit(0)).cast("long").alias("n_steps")]
