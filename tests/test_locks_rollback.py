"""Lock rules (L1-L4), rollback (R1-R6) and scores (K1-K3)."""

from __future__ import annotations

import pytest

from ddlscope.functions import fixed
from ddlscope.operators import locks, rollback, scoring
from helpers import make_ops, migrations, stats


def lock_of(spark, spec, dialect="postgres", db_version=14, rows=None, flags="notes"):
    ops = make_ops(spark, [spec], dialect=dialect, db_version=db_version)
    st = stats(spark, {"users": rows} if rows is not None else None)
    return locks.apply_lock_analysis(ops, st, spark, flags=flags).collect()[0]


def test_nullable_no_default_is_safe(spark):
    assert lock_of(spark, "ADD_COLUMN").risk_level == "safe"


def test_pg11_with_default_is_low(spark):
    r = lock_of(spark, ("ADD_COLUMN", ["some DEFAULT note"]), db_version=11)
    assert r.risk_level == "low" and r.duration_max <= 0.1


def test_pg10_with_default_is_high(spark):
    r = lock_of(spark, ("ADD_COLUMN", ["DEFAULT NOW()"]), db_version=10)
    assert r.risk_level == "high" and r.lock_type == "access_exclusive"
    assert r.notes[-1] == fixed.LOCK_NOTE_SIZE_UNKNOWN


def test_not_null_without_default_is_critical(spark):
    assert lock_of(spark, ("ADD_COLUMN", ["NOT NULL column added without DEFAULT"])).risk_level == "critical"


def test_duration_estimate_with_row_count(spark):
    r = lock_of(spark, ("ADD_COLUMN", ["DEFAULT NOW()"]), db_version=10, rows=4_000_000)
    assert r.duration_min is not None and r.duration_max > r.duration_min
    assert (r.duration_min, r.duration_max) == (1.4, 3.6)
    assert r.notes[-1] == "Estimated lock: 1.4–3.6 min (4,000,000 rows)."


def test_drop_column_is_high(spark):
    r = lock_of(spark, "DROP_COLUMN")
    assert (r.risk_level, r.lock_type) == ("high", "access_exclusive")


def test_drop_column_large_table_note(spark):
    r = lock_of(spark, "DROP_COLUMN", rows=10_000_000)
    assert r.duration_max is not None
    assert r.notes[-1].startswith("⚠ Large table (10,000,000 rows)")


@pytest.mark.parametrize("dialect,lock,risk", [("mysql", "exclusive", "medium"), ("sqlite", "none", "low"),
                                               ("tsql", "none", "low")])
def test_add_column_by_dialect(spark, dialect, lock, risk):
    r = lock_of(spark, "ADD_COLUMN", dialect=dialect)
    assert (r.lock_type, r.risk_level) == (lock, risk)


def test_concurrent_index_is_low(spark):
    r = lock_of(spark, ("CREATE_INDEX", ["CONCURRENTLY flag detected"]))
    assert (r.risk_level, r.lock_type) == ("low", "share_update_exclusive")


def test_blocking_index_is_medium(spark):
    r = lock_of(spark, ("CREATE_INDEX", ["No CONCURRENTLY"]))
    assert (r.risk_level, r.lock_type) == ("medium", "share")


@pytest.mark.parametrize("cls,risk,lock", [("DROP_TABLE", "critical", "access_exclusive"),
                                           ("TRUNCATE_TABLE", "critical", "access_exclusive"),
                                           ("CREATE_TABLE", "safe", "none"),
                                           ("UNKNOWN", "low", "none")])
def test_table_level_locks(spark, cls, risk, lock):
    r = lock_of(spark, cls)
    assert (r.risk_level, r.lock_type) == (risk, lock)


def test_fallback_has_null_durations(spark):
    r = lock_of(spark, "DROP_VIEW")
    assert r.duration_min is None and r.notes == [fixed.LOCK_NOTE_FALLBACK]


def test_clause_flags_mode(spark):
    ops = make_ops(spark, ["ADD_COLUMN"], db_version=10).withColumn("has_default", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit(True))
    r = locks.apply_lock_analysis(ops, stats(spark), spark, flags="clause").collect()[0]
    assert r.risk_level == "high"     # a real DEFAULT on PG 10 rewrites the table


def test_enriches_every_operation(spark):
    ops = make_ops(spark, ["CREATE_TABLE", "DROP_TABLE"])
    r = locks.apply_lock_analysis(ops, stats(spark), spark).orderBy("stmt_pos").collect()
    assert [x.risk_level for x in r] == ["safe", "critical"]


def rb(spark, classes):
    return rollback.classify_rollback(make_ops(spark, classes, column=None), spark)


@pytest.mark.parametrize("cls,cx,loss", [("ADD_COLUMN", "safe", False), ("DROP_COLUMN", "manual", True),
                                         ("DROP_TABLE", "none", True), ("TRUNCATE_TABLE", "none", True),
                                         ("RENAME_COLUMN", "complex", False), ("CREATE_INDEX", "safe", False),
                                         ("UNKNOWN", "manual", False)])
def test_classify_rollback(spark, cls, cx, loss):
    r = rb(spark, [cls]).collect()[0]
    assert (r.rollback_complexity, r.data_loss) == (cx, loss)
    assert r.rollback_description != ""


def summary(spark, classes):
    return rollback.rollback_summary(rb(spark, classes), migrations(spark)).collect()[0]


def test_all_safe_ops_returns_safe(spark):
    r = summary(spark, ["ADD_COLUMN", "CREATE_TABLE", "CREATE_INDEX"])
    assert (r.rollback_complexity, r.data_loss_risk, r.rollback_minutes) == ("safe", False, 5)


def test_drop_table_escalates_to_none(spark):
    r = summary(spark, ["ADD_COLUMN", "DROP_TABLE"])
    assert (r.rollback_complexity, r.data_loss_risk, r.rollback_minutes) == ("none", True, None)
    assert r.rollback_notes == (fixed.ROLLBACK_NOTE_DATA_LOSS + fixed.ROLLBACK_NOTE_IRREVERSIBLE).strip()


def test_steps_in_order_with_labels(spark):
    ops = rb(spark, ["ADD_COLUMN", "DROP_TABLE"])
    steps = rollback.rollback_steps(ops).orderBy("stmt_pos").collect()
    assert [s.step for s in steps] == [
        "ADD_COLUMN on `users`: DROP the added column — instant and safe.",
        "DROP_TABLE on `users`: Cannot roll back a DROP TABLE without a full backup restore."]


def test_opless_migration_is_safe(spark):
    r = rollback.rollback_summary(rb(spark, ["ADD_COLUMN"]), migrations(spark, (0, 1))) \
        .filter("migration_id = 1").collect()[0]
    assert (r.rollback_complexity, r.rollback_minutes, r.n_steps) == ("safe", 5, 0)


def scored(spark, specs, rows=None):
    ops = make_ops(spark, specs)
    o = locks.apply_lock_analysis(ops, stats(spark, {"users": rows} if rows else None), spark)
    return scoring.with_op_scores(rollback.classify_rollback(o, spark))


def test_op_scores_and_caps(spark):
    r = scored(spark, ["DROP_TABLE", "CREATE_TABLE", "DROP_COLUMN"], rows=20_000_000).orderBy("stmt_pos").collect()
    # critical 90 + irreversible 10; safe 0; high 70 + long lock 10
    assert [x.risk_score for x in r] == [100, 0, 80]


def test_overall_score_level_and_gate(spark):
    ops = scored(spark, ["DROP_TABLE", "CREATE_TABLE", "DROP_COLUMN"])
    m = scoring.migration_scores(ops, migrations(spark, (0, 1))).orderBy("migration_id").collect()
    assert (m[0].overall_score, m[0].overall_level, m[0].blocked, m[0].n_ops) == (100, "critical", True, 3)
    assert (m[1].overall_score, m[1].overall_level, m[1].blocked, m[1].n_ops) == (0, "safe", False, 0)
    assert m[0].affected_tables == ["users"]


def test_all_zero_scores_give_minus_five(spark):
    m = scoring.migration_scores(scored(spark, ["CREATE_TABLE"]), migrations(spark)).collect()[0]
    assert (m.overall_score, m.overall_level) == (-5, "safe")


def test_level_bands(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(s,) for s in (80, 79, 60, 35, 34, 10, 9, -5)], "s int")
    got = [r[0] for r in df.select(scoring.level_of(F.col("s"))).collect()]
    assert got == ["critical", "high", "high", "medium", "low", "low", "safe", "safe"]
