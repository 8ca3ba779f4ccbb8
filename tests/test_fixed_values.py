"""The fixed numbers and classes of the model, spelled out once more: the oracle reads them from fixed.py, so this test holds them."""

from __future__ import annotations

from ddlscope.functions import fixed


def test_rates_and_durations():
    assert (fixed.RATE_TABLE_REWRITE, fixed.RATE_FK_SCAN, fixed.RATE_INDEX_CONCURRENT, fixed.RATE_INDEX_BLOCKING) == (
        2_000_000, 5_000_000, 1_000_000, 1_500_000)
    assert (fixed.DURATION_LOW_FACTOR, fixed.DURATION_HIGH_FACTOR, fixed.LARGE_TABLE_ROWS) == (0.7, 1.8, 1_000_000)
    assert fixed.INSTANT_BELOW_MINUTES == 0.1


def test_scores_and_bands():
    assert fixed.RISK_BASE_SCORE == {"safe": 0, "low": 20, "medium": 40, "high": 70, "critical": 90}
    assert (fixed.LONG_LOCK_MINUTES, fixed.SCORE_BOOST, fixed.EXTRA_OP_SCORE) == (5, 10, 5)
    assert fixed.LEVEL_BANDS == [(80, "critical"), (60, "high"), (35, "medium"), (10, "low")]
    assert list(fixed.BLOCKING_LEVELS) == ["high", "critical"]


def test_rollback_classes():
    assert fixed.ROLLBACK_RANK == {"safe": 0, "manual": 1, "complex": 2, "none": 3}
    assert fixed.ROLLBACK_MINUTES == {"safe": 5, "manual": 30, "complex": 60, "none": None}
    by_class = {c: (x, loss) for c, x, _, loss in fixed.ROLLBACK_RULES}
    unsafe = {"DROP_COLUMN": ("manual", True), "ALTER_COLUMN": ("manual", True), "RENAME_COLUMN": ("complex", False),
              "RENAME_TABLE": ("complex", False), "DROP_TABLE": ("none", True), "TRUNCATE_TABLE": ("none", True)}
    assert {c: v for c, v in by_class.items() if v != ("safe", False)} == unsafe
    assert len(by_class) == 16 and fixed.ROLLBACK_DEFAULT[0] == "manual" and fixed.ROLLBACK_DEFAULT[2] is False


def test_dialects_and_file_names():
    assert fixed.DIALECT_BY_NAME == [("mysql", "mysql"), ("sqlite", "sqlite"), ("mssql", "tsql"), ("sqlserver", "tsql")]
    assert fixed.DEFAULT_DIALECT == "postgres"
    assert fixed.MIGRATION_NAME_HINTS == ["migrat", "schema", "alter", "create", "drop", "ddl"]
