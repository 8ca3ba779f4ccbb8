"""Scores, levels and small report columns.

Per-migration scores are partial aggregates (max, count_if, count,
collect_set of distinct table names), so a migration with very many
operations is still reduced on the map side before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.session import broadcast_if_small


def op_score(risk_level: Column, duration_max: Column, rollback_complexity: Column) -> Column:
    """K1: base by risk, +10 for a lock over 5 minutes, +10 if irreversible, capped at 100."""
    base = None
    for lvl, s in fixed.RISK_BASE_SCORE.items():
        base = F.when(risk_level == lvl, s) if base is None else base.when(risk_level == lvl, s)
    base = base.otherwise(0)
    long_lock = F.coalesce(duration_max > fixed.LONG_LOCK_MINUTES, F.lit(False))
    s1 = F.when(long_lock, F.least(F.lit(100), base + fixed.SCORE_BOOST)).otherwise(base)
    s2 = F.when(rollback_complexity == "none", F.least(F.lit(100), s1 + fixed.SCORE_BOOST)).otherwise(s1)
    return s2.cast("int")


def level_of(score: Column) -> Column:
    """K3: score -> level."""
    expr = None
    for bound, lvl in fixed.LEVEL_BANDS:
        expr = F.when(score >= bound, lvl) if expr is None else expr.when(score >= bound, lvl)
    return expr.otherwise("safe")


def with_op_scores(ops: DataFrame) -> DataFrame:
    return ops.withColumn("risk_score", op_score(F.col("risk_level"), F.col("duration_max"),
                                                 F.col("rollback_complexity")))


def migration_scores(ops: DataFrame, migrations: DataFrame) -> DataFrame:
    """K2-K5 per migration: overall score and level, op count, affected tables, CI gate.

    Op-less migrations (left join) score 0 and are safe.  A migration whose
    ops all score 0 gets -5, as the tool computes it.
    """
    # both sides are partitioned by migration_id already: a merge join needs no exchange
    m = migrations.join(ops.groupBy("migration_id").agg(*score_parts()).hint("merge"), "migration_id", "left")
    return m.select(*migrations.columns, *scores_of_parts())


def score_parts() -> list[Column]:
    """Aggregates over the operations of a migration that its scores are worked out from."""
    return [F.max("risk_score").alias("_max"), F.count_if(F.col("risk_score") > 0).alias("_pos"), F.count(F.lit(1)).alias("_n"),
            F.array_sort(F.collect_set(F.when(F.col("target_table") != "", F.col("target_table")))).alias("affected_tables")]


def scores_of_parts() -> list[Column]:
    """K2-K5 from ``score_parts``, which are null for a migration without operations."""
    score = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(
        F.least(F.lit(100), F.col("_max") + (F.col("_pos") - 1) * fixed.EXTRA_OP_SCORE)).cast("int")
    level = level_of(score)
    return [score.alias("overall_score"), F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_ops"),
            F.coalesce(F.col("affected_tables"), F.array().cast("array<string>")).alias("affected_tables"),
            level.alias("overall_level"), level.isin(*fixed.BLOCKING_LEVELS).alias("blocked")]


def rewrite_worklist(ops: DataFrame, max_notes: int | None = None, max_sql: int | None = None) -> DataFrame:
    """K7: high/critical ops with the reason and SQL handed to a rewriter.

    Whole by default; a renderer may ask for the first ``max_notes`` notes and
    ``max_sql`` characters.
    """
    notes = F.col("notes") if max_notes is None else F.slice("notes", 1, max_notes)
    reason = F.when(F.size("notes") > 0, F.array_join(notes, "; ")).otherwise(F.col("risk_level"))
    sql = F.col("raw_sql") if max_sql is None else F.substring("raw_sql", 1, max_sql)
    return ops.filter(F.col("risk_level").isin(*fixed.BLOCKING_LEVELS)).select(
        "migration_id", "stmt_pos", "action_pos", "op_class", "target_table",
        F.coalesce("target_column", F.lit("N/A")).alias("target_column"),
        sql.alias("raw_sql"), reason.alias("risk_reason"),
    )


def duration_label(dmin: Column, dmax: Column) -> Column:
    """Instant text below 0.1 minutes, else 'a–b minutes' with one decimal."""
    return F.when(
        dmin.isNotNull() & dmax.isNotNull(),
        F.when(dmax < fixed.INSTANT_BELOW_MINUTES, F.lit(fixed.INSTANT_DURATION))
        .otherwise(F.format_string("%.1f–%.1f minutes", dmin, dmax)),
    )


def score_bar(score: Column) -> Column:
    """20-cell bar of floor(score/5) full cells, then ' s/100'."""
    full = F.floor(score / 5).cast("int")
    return F.concat(
        F.lit("["), F.repeat(F.lit(fixed.SCORE_BAR_FULL), F.greatest(full, F.lit(0))),
        F.repeat(F.lit(fixed.SCORE_BAR_EMPTY), F.greatest(F.lit(fixed.SCORE_BAR_WIDTH) - full, F.lit(0))),
        F.lit("] "), score.cast("string"), F.lit("/100"),
    )


def badge(c: Column, table: dict[str, str]) -> Column:
    """Level / complexity -> emoji, unknown -> question mark."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], F.lit(fixed.UNKNOWN_EMOJI))


@dataclass(frozen=True)
class CatalogRule:
    """A rule that asks the catalogue: ``when`` an operation's keys are (or aren't) in ``lookup``.

    ``keys`` gives an expression over the operations for each column of the lookup;
    nulls are in no lookup.  Rules of the same lookup and keys share one join.
    """

    name: str
    when: Column
    lookup: DataFrame
    keys: dict[str, str]
    exists: bool
    level: str
    message: str
    suggestion: str


def catalog_rules(ops: DataFrame, rules: list[CatalogRule]) -> DataFrame:
    """K9 with the catalogue: one row per operation and rule it matches, as ``custom_rules`` gives them."""
    joined, flags = ops, {}
    for r in rules:
        key = id(r.lookup), tuple(r.keys.items())
        if key in flags:
            continue
        flag = flags[key] = f"_in{len(flags)}"
        # distinct keys: the join cannot fan out; a catalogue of many schemas is joined by shuffling
        known = r.lookup.select(*(F.col(c).alias(f"{flag}_{c}") for c in r.keys)).distinct().withColumn(flag, F.lit(True))
        same = F.lit(True)
        for c, expr in r.keys.items():
            same = same & (F.expr(expr) == F.col(f"{flag}_{c}"))
        joined = joined.join(broadcast_if_small(known), same, "left").drop(*(f"{flag}_{c}" for c in r.keys))
    found = [(r.name, r.when & (F.coalesce(F.col(flags[id(r.lookup), tuple(r.keys.items())]), F.lit(False)) == r.exists), r.level, r.message, r.suggestion)
             for r in rules]
    return custom_rules(joined, found).drop(*flags.values())


def custom_rules(ops: DataFrame, rules) -> DataFrame:
    """K9: user rules as data.

    ``rules`` is a list of ``(name, predicate Column, risk_level, message,
    suggestion)``; each op gets one row per rule it matches.  Catalogue or
    row-count columns a predicate needs are joined onto ``ops`` first.
    """
    hits = F.filter(F.array(*[
        F.when(pred, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("rule_risk_level"),
                              F.lit(msg).alias("message"), F.lit(sugg).alias("suggestion")))
        for name, pred, level, msg, sugg in rules
    ]), lambda x: x.isNotNull())
    return ops.select("*", F.explode(hits).alias("_hit")).select("*", "_hit.*").drop("_hit")
