"""Fixed values.

Everything in this module is a value that has to be exactly what the
analysed tool prints or keys on (note texts, rule rows, thresholds,
descriptions, badges), otherwise the reports differ.  They are written out
plainly and in their natural order; the logic that uses them lives in the
operators.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Rollback classes
# --------------------------------------------------------------------------
ROLLBACK_RANK = {"safe": 0, "manual": 1, "complex": 2, "none": 3}

# --------------------------------------------------------------------------
# Parser notes
# --------------------------------------------------------------------------
NOTE_NOT_NULL_NO_DEFAULT = (
    "NOT NULL column added without DEFAULT — will fail on non-empty tables unless backfilled first."
)
NOTE_INDEX_CONCURRENT = "CONCURRENTLY flag detected — no table lock in PostgreSQL."
NOTE_INDEX_BLOCKING = "No CONCURRENTLY — will acquire ShareLock and block writes in MySQL."
NOTE_DROP_TABLE = "DROP TABLE is irreversible without a backup."
NOTE_TRUNCATE = "TRUNCATE is irreversible — all rows permanently deleted."

# --------------------------------------------------------------------------
# Lock model
# --------------------------------------------------------------------------
RATE_TABLE_REWRITE = 2_000_000   # rows per minute
RATE_FK_SCAN = 5_000_000
RATE_INDEX_CONCURRENT = 1_000_000
RATE_INDEX_BLOCKING = 1_500_000
DURATION_LOW_FACTOR = 0.7
DURATION_HIGH_FACTOR = 1.8
LARGE_TABLE_ROWS = 1_000_000

LOCK_NOTE_PG11_DEFAULT = "PostgreSQL 11+: ADD COLUMN with DEFAULT is instant (metadata-only)."
LOCK_NOTE_PG_OLD_DEFAULT = "PostgreSQL {v}: ADD COLUMN with DEFAULT triggers full table rewrite."
LOCK_NOTE_ESTIMATE = "Estimated lock: {min}–{max} min ({rows} rows)."
LOCK_NOTE_SIZE_UNKNOWN = "Table size unknown — lock duration unpredictable (could be minutes)."
LOCK_NOTE_NOT_NULL = "NOT NULL column without DEFAULT — will fail on non-empty tables."
LOCK_NOTE_NULLABLE = "Nullable ADD COLUMN with no DEFAULT — instant, safe."
LOCK_NOTE_MYSQL_ADD = (
    "MySQL: ADD COLUMN typically rebuilds the table. "
    "Use ALGORITHM=INSTANT if MySQL 8.0.29+ for zero-lock."
)
LOCK_NOTE_PG_DROP_COLUMN = (
    "DROP COLUMN acquires AccessExclusiveLock — blocks all reads and writes. "
    "Space is not reclaimed until VACUUM runs."
)
LOCK_NOTE_LARGE_TABLE = "⚠ Large table ({rows} rows) — consider using a maintenance window."
LOCK_NOTE_MYSQL_DROP_COLUMN = "MySQL DROP COLUMN triggers full table rebuild."
LOCK_NOTE_ALTER_COLUMN = (
    "ALTER COLUMN type change requires a full table rewrite in most cases. "
    "Implicit casts may silently truncate data."
)
LOCK_NOTE_RENAME = (
    "RENAME is a metadata-only operation — very fast. "
    "⚠ Application code referencing the old name will break immediately."
)
LOCK_NOTE_INDEX_CONCURRENT = (
    "CREATE INDEX CONCURRENTLY — no table lock, reads and writes proceed normally. "
    "Takes ~2× longer than blocking index build."
)
LOCK_NOTE_INDEX_BLOCKING = (
    "CREATE INDEX without CONCURRENTLY acquires ShareLock — "
    "blocks writes for the duration of the index build."
)
LOCK_NOTE_DROP_INDEX = (
    "DROP INDEX acquires AccessExclusiveLock briefly. "
    "In PostgreSQL, use DROP INDEX CONCURRENTLY to avoid blocking."
)
LOCK_NOTE_ADD_FK = (
    "ADD FOREIGN KEY scans the entire table to validate existing rows. "
    "Duration is proportional to row count. "
    "In PostgreSQL, use NOT VALID + VALIDATE CONSTRAINT to reduce lock time."
)
LOCK_NOTE_CREATE_TABLE = "CREATE TABLE — no lock on existing objects. Safe."
LOCK_NOTE_DROP_TABLE = (
    "DROP TABLE is immediate but irreversible. "
    "Acquires AccessExclusiveLock and removes all data permanently."
)
LOCK_NOTE_TRUNCATE = (
    "TRUNCATE acquires AccessExclusiveLock and removes all rows instantly. Irreversible."
)
LOCK_NOTE_ADD_CONSTRAINT = (
    "ADD CONSTRAINT scans existing rows for violations. "
    "Duration proportional to table size."
)
LOCK_NOTE_FALLBACK = "Unknown operation — unable to classify lock type."

# Lock rules.  Conditions are written so that exactly one row can match an
# operation (the first-match order of the tool is folded into the
# conditions); an operation no row matches gets the fallback.
#   dialects: dialect groups the row applies to ('pg', 'mysql', 'other')
#   min_v / max_v: db_version >= min_v, db_version < max_v (None = open)
#   d / n / c: required value of the DEFAULT / NOT NULL / CONCURRENTLY flag
#   rate: rows per minute for the duration estimate, or None for fixed bounds
#   size_note: add the estimate / size-unknown note
#   large_note: add the large-table note when rows > LARGE_TABLE_ROWS
# Columns: rule_id, op_class, dialects, min_v, max_v, d, n, c,
#          lock_type, risk_level, rate, fixed_min, fixed_max, note, size_note, large_note
ALL_DIALECTS = ["pg", "mysql", "other"]
LOCK_RULES = [
    (1, "ADD_COLUMN", ["pg"], 11, None, True, False, None,
     "access_exclusive", "low", None, 0.0, 0.01, LOCK_NOTE_PG11_DEFAULT, False, False),
    (2, "ADD_COLUMN", ["pg"], None, 11, True, None, None,
     "access_exclusive", "high", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_PG_OLD_DEFAULT, True, False),
    (3, "ADD_COLUMN", ["pg"], 11, None, None, True, None,
     "access_exclusive", "critical", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_NOT_NULL, False, False),
    (3, "ADD_COLUMN", ["pg"], None, 11, False, True, None,
     "access_exclusive", "critical", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_NOT_NULL, False, False),
    (4, "ADD_COLUMN", ["pg"], None, None, False, False, None,
     "access_exclusive", "safe", None, 0.0, 0.01, LOCK_NOTE_NULLABLE, False, False),
    (5, "ADD_COLUMN", ["mysql"], None, None, None, None, None,
     "exclusive", "medium", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_MYSQL_ADD, False, False),
    (6, "DROP_COLUMN", ["pg"], None, None, None, None, None,
     "access_exclusive", "high", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_PG_DROP_COLUMN, False, True),
    (7, "DROP_COLUMN", ["mysql"], None, None, None, None, None,
     "exclusive", "high", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_MYSQL_DROP_COLUMN, False, False),
    (8, "ALTER_COLUMN", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "high", RATE_TABLE_REWRITE, None, None, LOCK_NOTE_ALTER_COLUMN, False, False),
    (9, "RENAME_COLUMN", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "medium", None, 0.0, 0.01, LOCK_NOTE_RENAME, False, False),
    (9, "RENAME_TABLE", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "medium", None, 0.0, 0.01, LOCK_NOTE_RENAME, False, False),
    (10, "CREATE_INDEX", ["pg"], None, None, None, None, True,
     "share_update_exclusive", "low", RATE_INDEX_CONCURRENT, None, None, LOCK_NOTE_INDEX_CONCURRENT, False, False),
    (11, "CREATE_INDEX", ["pg"], None, None, None, None, False,
     "share", "medium", RATE_INDEX_BLOCKING, None, None, LOCK_NOTE_INDEX_BLOCKING, False, False),
    (11, "CREATE_INDEX", ["mysql", "other"], None, None, None, None, None,
     "share", "medium", RATE_INDEX_BLOCKING, None, None, LOCK_NOTE_INDEX_BLOCKING, False, False),
    (12, "DROP_INDEX", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "low", None, 0.0, 0.05, LOCK_NOTE_DROP_INDEX, False, False),
    (13, "ADD_FOREIGN_KEY", ALL_DIALECTS, None, None, None, None, None,
     "share_row_exclusive", "medium", RATE_FK_SCAN, None, None, LOCK_NOTE_ADD_FK, False, False),
    (14, "CREATE_TABLE", ALL_DIALECTS, None, None, None, None, None,
     "none", "safe", None, 0.0, 0.0, LOCK_NOTE_CREATE_TABLE, False, False),
    (15, "DROP_TABLE", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "critical", None, 0.0, 0.05, LOCK_NOTE_DROP_TABLE, False, False),
    (16, "TRUNCATE_TABLE", ALL_DIALECTS, None, None, None, None, None,
     "access_exclusive", "critical", None, 0.0, 0.01, LOCK_NOTE_TRUNCATE, False, False),
    (17, "ADD_CONSTRAINT", ALL_DIALECTS, None, None, None, None, None,
     "share_row_exclusive", "medium", RATE_FK_SCAN, None, None, LOCK_NOTE_ADD_CONSTRAINT, False, False),
]
FALLBACK_LOCK = ("none", "low")   # lock_type, risk_level; durations null

# --------------------------------------------------------------------------
# Rollback rules (op_class, complexity, description, data_loss)
# --------------------------------------------------------------------------
ROLLBACK_RULES = [
    ("ADD_COLUMN", "safe", "DROP the added column — instant and safe.", False),
    ("DROP_COLUMN", "manual", "Restore column from backup. Any data written to it after drop is lost.", True),
    ("ALTER_COLUMN", "manual",
     "Revert type change. Data may have been truncated or cast — verify before rollback.", True),
    ("RENAME_COLUMN", "complex",
     "Rename column back AND revert all application code referencing the new name.", False),
    ("RENAME_TABLE", "complex",
     "Rename table back AND revert all application code referencing the new name.", False),
    ("CREATE_TABLE", "safe", "DROP the created table — safe if no data was inserted.", False),
    ("DROP_TABLE", "none", "Cannot roll back a DROP TABLE without a full backup restore.", True),
    ("TRUNCATE_TABLE", "none", "TRUNCATE is irreversible — all row data is permanently deleted.", True),
    ("CREATE_INDEX", "safe", "DROP the created index — instant and safe.", False),
    ("DROP_INDEX", "safe", "Recreate the index (may require downtime or CONCURRENTLY flag).", False),
    ("ADD_CONSTRAINT", "safe", "DROP the constraint — safe, but may require re-validation on re-add.", False),
    ("DROP_CONSTRAINT", "safe", "Recreate the constraint — will validate all existing rows.", False),
    ("ADD_FOREIGN_KEY", "safe",
     "DROP CONSTRAINT — safe, but any orphaned rows inserted during the migration remain.", False),
    ("DROP_FOREIGN_KEY", "safe", "Re-add the foreign key — will scan the entire table for validation.", False),
    ("CREATE_VIEW", "safe", "DROP the view — instant and safe.", False),
    ("DROP_VIEW", "safe", "Recreate the view from the original definition.", False),
]
ROLLBACK_DEFAULT = ("manual", "Unknown operation — manual rollback assessment required.", False)
ROLLBACK_MINUTES = {"safe": 5, "manual": 30, "complex": 60, "none": None}
ROLLBACK_NOTE_DATA_LOSS = (
    "⚠ This migration has operations with DATA LOSS risk. "
    "Ensure you have a verified backup before proceeding."
)
ROLLBACK_NOTE_IRREVERSIBLE = (
    " One or more operations are IRREVERSIBLE — "
    "rollback requires a full database restore from backup."
)

# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------
RISK_BASE_SCORE = {"safe": 0, "low": 20, "medium": 40, "high": 70, "critical": 90}
LONG_LOCK_MINUTES = 5
SCORE_BOOST = 10
EXTRA_OP_SCORE = 5
# overall level bands: score >= bound -> level (checked top down)
LEVEL_BANDS = [(80, "critical"), (60, "high"), (35, "medium"), (10, "low")]
BLOCKING_LEVELS = ["high", "critical"]

# --------------------------------------------------------------------------
# Query impact descriptions
# --------------------------------------------------------------------------
IMPACT_COLUMN_MISSING = (
    "Column `{col}` on table `{table}` is being dropped. "
    "This query will raise a column-not-found error."
)
IMPACT_COLUMN_RENAMED = "Column `{col}` on `{table}` is being renamed. This query will fail after migration."
IMPACT_TYPE_MISMATCH = (
    "Column `{col}` on `{table}` has a type change. "
    "Implicit cast may fail or cause data truncation."
)
IMPACT_INDEX_MISSING = (
    "Index `{index}` on `{table}` is being dropped. "
    "Queries using these columns may experience 10–200× slowdowns."
)

# --------------------------------------------------------------------------
# Report rendering
# --------------------------------------------------------------------------
RISK_EMOJI = {"safe": "✅", "low": "🟢", "medium": "🟡", "high": "🔴", "critical": "🚨"}
ROLLBACK_EMOJI = {"safe": "✅", "manual": "⚠️", "complex": "🔧", "none": "🚫"}
UNKNOWN_EMOJI = "❓"
RISK_SYMBOL = {"safe": "✓", "low": "✓", "medium": "⚠", "high": "✗", "critical": "✗✗"}
INSTANT_DURATION = "instant (<1 second)"
INSTANT_BELOW_MINUTES = 0.1
SCORE_BAR_FULL = "█"
SCORE_BAR_EMPTY = "░"
SCORE_BAR_WIDTH = 20
IMPACT_DESCRIPTION_LIMIT = 120
REWRITE_HEADING = "**💡 Suggested safe rewrite:**"
REWRITE_LIMIT = 800
SUMMARY_BLOCK = "<details><summary>🤖 AI Risk Analysis (click to expand)</summary>"
STAKEHOLDER_BLOCK = "<details><summary>📊 Stakeholder Summary</summary>"
DATA_LOSS_LINE = "- 🚨 **DATA LOSS RISK** — ensure you have a verified backup before running this migration"

# --------------------------------------------------------------------------
# File names
# --------------------------------------------------------------------------
# dialect inference: first substring found in the lower-cased name wins
DIALECT_BY_NAME = [("mysql", "mysql"), ("sqlite", "sqlite"), ("mssql", "tsql"), ("sqlserver", "tsql")]
DEFAULT_DIALECT = "postgres"
MIGRATION_NAME_HINTS = ["migrat", "schema", "alter", "create", "drop", "ddl"]
