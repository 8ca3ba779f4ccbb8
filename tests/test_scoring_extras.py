"""K7 worklist, K9 custom rules, K10-K12 labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.operators import locks, rollback, scoring
from helpers import make_ops, stats


def test_duration_label(spark):
    df = spark.createDataFrame([(0.0, 0.01), (1.26, 3.24), (None, None), (0.0, None)], "a double, b double")
    got = [r[0] for r in df.select(scoring.duration_label(F.col("a"), F.col("b"))).collect()]
    assert got == [fixed.INSTANT_DURATION, "1.3–3.2 minutes", None, None]


def test_score_bar_and_negative_score(spark):
    df = spark.createDataFrame([(100,), (20,), (-5,)], "s int")
    got = [r[0] for r in df.select(scoring.score_bar(F.col("s"))).collect()]
    assert got[0] == "[" + "█" * 20 + "] 100/100"
    assert got[1] == "[" + "█" * 4 + "░" * 16 + "] 20/100"
    assert got[2] == "[" + "░" * 21 + "] -5/100"       # floor(-5/5) = -1 full cells


def test_badges(spark):
    df = spark.createDataFrame([("high",), ("nope",)], "l string")
    got = [r[0] for r in df.select(scoring.badge(F.col("l"), fixed.RISK_EMOJI)).collect()]
    assert got == ["🔴", fixed.UNKNOWN_EMOJI]


def _ops(spark, specs):
    o = locks.apply_lock_analysis(make_ops(spark, specs), stats(spark, {"users": 3_000_000}), spark)
    return rollback.classify_rollback(o, spark)


def test_rewrite_worklist(spark):
    w = scoring.rewrite_worklist(_ops(spark, ["DROP_COLUMN", "CREATE_TABLE"])).collect()
    assert len(w) == 1
    assert w[0].op_class == "DROP_COLUMN" and w[0].target_column == "col"
    assert w[0].risk_reason == fixed.LOCK_NOTE_PG_DROP_COLUMN + "; " + "⚠ Large table (3,000,000 rows) — consider using a maintenance window."


def test_custom_rules(spark):
    ops = _ops(spark, ["DROP_COLUMN", "CREATE_INDEX", "CREATE_TABLE"])
    rules = [
        ("big-table-rewrite", (F.col("row_count") > 1_000_000) & F.col("op_class").isin("DROP_COLUMN", "ALTER_COLUMN"),
         "high", "Rewrites a large table", "Use a maintenance window"),
        ("blocking-index", (F.col("op_class") == "CREATE_INDEX") & (F.col("lock_type") == "share"),
         "medium", "Index build blocks writes", "Use CONCURRENTLY"),
    ]
    hits = scoring.custom_rules(ops, rules).select("op_class", "rule", "rule_risk_level").orderBy("rule").collect()
    assert [(h.op_class, h.rule, h.rule_risk_level) for h in hits] == [
        ("DROP_COLUMN", "big-table-rewrite", "high"), ("CREATE_INDEX", "blocking-index", "medium")]
