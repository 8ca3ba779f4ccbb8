"""Expected results as DuckDB SQL over the driver's tables.

The oracle does not re-run the lexical extraction: the expected class,
table, column and index of every operation come from the corpus generator
parameters (``l_partkey % 17``, ``l_suppkey``), and the lock, rollback and
score logic is written as the tool's first-match ``CASE`` order rather than
the rule join the Spark side uses.  Lists are compared as joined strings.
"""

from __future__ import annotations

from ddlscope.functions import fixed
from ddlscope.sources import corpus, databases


def _q(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + str(s).replace("'", "''") + "'"


def _render(col: str) -> str:
    return (f"replace(replace(replace(replace({col}, '{{t}}', s.t), '{{c}}', s.c), '{{i}}', s.i), "
            f"'{{p}}', s.p)")


def _stats_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, count(*) AS row_count FROM {t}" for t in corpus.CATALOG_TABLES)


def _dialects_sql() -> str:
    names = []
    for f in corpus.DIALECT_FILES:
        d = fixed.DEFAULT_DIALECT
        for hint, dialect in fixed.DIALECT_BY_NAME:
            if hint in f:
                d = dialect
                break
        names.append(_q(d))
    return "[" + ", ".join(names) + "]"


def _pyfloat(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN printf('%.1f', {x}) ELSE CAST({x} AS VARCHAR) END"


def base_ctes(clause: bool = False, scaled: bool = False) -> str:
    """CTEs: stm (statements), eops (expected ops), mig (migrations), stats, lk (locks), rb, sc.

    ``clause``: NOT NULL and DEFAULT as the templates have them instead of the
    notes; ``scaled``: row counts times 1,000, and an empty region.
    """
    notes = "lower(parser_notes) LIKE '%default%' AS d, parser_notes LIKE '%NOT NULL%' AS n"
    clauses = ("(tid = 2 OR tid = 15 AND action_pos = 0 OR tid = 16 AND (variant = 9 AND action_pos = 1 "
               "OR variant IN (10, 16) AND action_pos = 0)) AS d, "
               "(tid IN (1, 2) OR tid = 16 AND variant = 9 AND action_pos = 0) AS n")
    stats = "SELECT table_name, CASE WHEN table_name = 'region' THEN 0 ELSE row_count * 1000 END AS row_count FROM (" if scaled else "SELECT * FROM ("
    rb_vals = ", ".join(f"({_q(c)}, {_q(x)}, {_q(d)}, {_q(l)})" for c, x, d, l in fixed.ROLLBACK_RULES)
    rank = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in fixed.ROLLBACK_RANK.items())
    base = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in fixed.RISK_BASE_SCORE.items())
    # rule attributes by rule number (the fixed values of the lock model)
    rule_vals = [
        (1, "access_exclusive", "low", None, 0.0, 0.01, fixed.LOCK_NOTE_PG11_DEFAULT),
        (2, "access_exclusive", "high", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_PG_OLD_DEFAULT),
        (3, "access_exclusive", "critical", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_NOT_NULL),
        (4, "access_exclusive", "safe", None, 0.0, 0.01, fixed.LOCK_NOTE_NULLABLE),
        (5, "exclusive", "medium", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_MYSQL_ADD),
        (6, "access_exclusive", "high", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_PG_DROP_COLUMN),
        (7, "exclusive", "high", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_MYSQL_DROP_COLUMN),
        (8, "access_exclusive", "high", fixed.RATE_TABLE_REWRITE, None, None, fixed.LOCK_NOTE_ALTER_COLUMN),
        (9, "access_exclusive", "medium", None, 0.0, 0.01, fixed.LOCK_NOTE_RENAME),
        (10, "share_update_exclusive", "low", fixed.RATE_INDEX_CONCURRENT, None, None, fixed.LOCK_NOTE_INDEX_CONCURRENT),
        (11, "share", "medium", fixed.RATE_INDEX_BLOCKING, None, None, fixed.LOCK_NOTE_INDEX_BLOCKING),
        (12, "access_exclusive", "low", None, 0.0, 0.05, fixed.LOCK_NOTE_DROP_INDEX),
        (13, "share_row_exclusive", "medium", fixed.RATE_FK_SCAN, None, None, fixed.LOCK_NOTE_ADD_FK),
        (14, "none", "safe", None, 0.0, 0.0, fixed.LOCK_NOTE_CREATE_TABLE),
        (15, "access_exclusive", "critical", None, 0.0, 0.05, fixed.LOCK_NOTE_DROP_TABLE),
        (16, "access_exclusive", "critical", None, 0.0, 0.01, fixed.LOCK_NOTE_TRUNCATE),
        (17, "share_row_exclusive", "medium", fixed.RATE_FK_SCAN, None, None, fixed.LOCK_NOTE_ADD_CONSTRAINT),
        (18, "none", "low", None, None, None, fixed.LOCK_NOTE_FALLBACK),
    ]
    rv = ", ".join(
        f"({n}, {_q(lt)}, {_q(rk)}, CAST({_q(rate)} AS DOUBLE), CAST({_q(a)} AS DOUBLE), "
        f"CAST({_q(b)} AS DOUBLE), {_q(note)})" for n, lt, rk, rate, a, b, note in rule_vals)
    est_note = (f"replace(replace(replace({_q(fixed.LOCK_NOTE_ESTIMATE)}, '{{min}}', {_pyfloat('dmin')}), "
                f"'{{max}}', {_pyfloat('dmax')}), '{{rows}}', format('{{:,}}', row_count))")
    large_note = f"replace({_q(fixed.LOCK_NOTE_LARGE_TABLE)}, '{{rows}}', format('{{:,}}', row_count))"
    return f"""
stm AS ({corpus.expected_statements_sql()}),
xo AS (SELECT * FROM {corpus.expected_ops_values_sql()}),
mig AS (
  SELECT o_orderkey AS migration_id, o_custkey // {corpus.DB_PER_CUSTOMER_DIV} AS db_id,
         CAST(9 + o_custkey % 6 AS INTEGER) AS db_version,
         list_extract({_dialects_sql()}, CAST(o_orderkey % {len(corpus.DIALECT_FILES)} AS INTEGER) + 1) AS dialect
  FROM orders),
eops AS (
  SELECT s.migration_id, s.stmt_pos + x.stmt_off AS stmt_pos, CAST(x.action_pos AS BIGINT) AS action_pos, x.op_class,
         {_render('x.tbl')} AS target_table, {_render('x.col')} AS target_column,
         {_render('x.idx')} AS target_index, x.notes AS parser_notes, s.tid, s.variant, s.t AS base_t, s.c AS base_c,
         s.i AS base_i, s.p AS base_p, s.k AS base_k, s.did AS base_did, x.stmt_off
  FROM stm s JOIN xo x ON x.tid = s.tid AND (x.tid < 16 OR x.variant = s.variant)),
stats AS ({stats}{_stats_sql()})),
lk0 AS (
  SELECT e.*, m.dialect, m.db_version, st.row_count,
    CASE
      WHEN e.op_class = 'ADD_COLUMN' AND pg AND m.db_version >= 11 AND d AND NOT n THEN 1
      WHEN e.op_class = 'ADD_COLUMN' AND pg AND m.db_version < 11 AND d THEN 2
      WHEN e.op_class = 'ADD_COLUMN' AND pg AND n THEN 3
      WHEN e.op_class = 'ADD_COLUMN' AND pg THEN 4
      WHEN e.op_class = 'ADD_COLUMN' AND m.dialect = 'mysql' THEN 5
      WHEN e.op_class = 'DROP_COLUMN' AND pg THEN 6
      WHEN e.op_class = 'DROP_COLUMN' AND m.dialect = 'mysql' THEN 7
      WHEN e.op_class = 'ALTER_COLUMN' THEN 8
      WHEN e.op_class IN ('RENAME_COLUMN', 'RENAME_TABLE') THEN 9
      WHEN e.op_class = 'CREATE_INDEX' AND pg AND c THEN 10
      WHEN e.op_class = 'CREATE_INDEX' THEN 11
      WHEN e.op_class = 'DROP_INDEX' THEN 12
      WHEN e.op_class = 'ADD_FOREIGN_KEY' THEN 13
      WHEN e.op_class = 'CREATE_TABLE' THEN 14
      WHEN e.op_class = 'DROP_TABLE' THEN 15
      WHEN e.op_class = 'TRUNCATE_TABLE' THEN 16
      WHEN e.op_class = 'ADD_CONSTRAINT' THEN 17
      ELSE 18 END AS rule_no
  FROM (SELECT *, {clauses if clause else notes},
               upper(parser_notes) LIKE '%CONCURRENTLY FLAG%' AS c FROM eops) e
  JOIN (SELECT *, dialect IN ('postgres', 'postgresql') AS pg FROM mig) m USING (migration_id)
  LEFT JOIN stats st ON st.table_name = e.target_table),
rules AS (SELECT * FROM (VALUES {rv}) AS r(rule_no, lock_type, risk_level, rate, fmin, fmax, note)),
lk1 AS (
  SELECT l.*, r.lock_type, r.risk_level, r.note AS rule_note, r.rate,
    CASE WHEN r.rate IS NOT NULL THEN round(l.row_count / r.rate * {fixed.DURATION_LOW_FACTOR}, 2) ELSE r.fmin END AS dmin,
    CASE WHEN r.rate IS NOT NULL THEN round(l.row_count / r.rate * {fixed.DURATION_HIGH_FACTOR}, 2) ELSE r.fmax END AS dmax
  FROM lk0 l JOIN rules r USING (rule_no)),
lk AS (
  SELECT *,
    concat_ws(' | ', nullif(parser_notes, ''),
      CASE WHEN rule_no = 2 THEN replace(rule_note, '{{v}}', CAST(db_version AS VARCHAR)) ELSE rule_note END,
      CASE WHEN rule_no = 2 THEN CASE WHEN coalesce(row_count, 0) <> 0 THEN {est_note}
                                      ELSE {_q(fixed.LOCK_NOTE_SIZE_UNKNOWN)} END END,
      CASE WHEN rule_no = 6 AND row_count > {fixed.LARGE_TABLE_ROWS} THEN {large_note} END) AS all_notes
  FROM lk1),
rbr AS (SELECT * FROM (VALUES {rb_vals}) AS r(op_class, rollback_complexity, rollback_description, data_loss)),
rb AS (
  SELECT lk.*,
    coalesce(rbr.rollback_complexity, {_q(fixed.ROLLBACK_DEFAULT[0])}) AS rollback_complexity,
    coalesce(rbr.rollback_description, {_q(fixed.ROLLBACK_DEFAULT[1])}) AS rollback_description,
    coalesce(rbr.data_loss, {_q(fixed.ROLLBACK_DEFAULT[2])}) AS data_loss
  FROM lk LEFT JOIN rbr USING (op_class)),
sc AS (
  SELECT *, CASE rollback_complexity {rank} END AS rollback_rank,
    CAST(least(100, s1 + CASE WHEN rollback_complexity = 'none' THEN {fixed.SCORE_BOOST} ELSE 0 END) AS INTEGER) AS risk_score
  FROM (SELECT *, CASE WHEN coalesce(dmax > {fixed.LONG_LOCK_MINUTES}, FALSE)
                       THEN least(100, b0 + {fixed.SCORE_BOOST}) ELSE b0 END AS s1
        FROM (SELECT *, CASE risk_level {base} ELSE 0 END AS b0 FROM rb))),
magg AS (
  SELECT migration_id, max(risk_score) AS mx, count(*) FILTER (WHERE risk_score > 0) AS pos, count(*) AS n,
         array_to_string(list_sort(list_distinct(list(target_table) FILTER (WHERE target_table <> ''))), ',') AS tabs,
         max(rollback_rank) AS worst, bool_or(data_loss) AS loss
  FROM sc GROUP BY migration_id),
ms AS (
  SELECT m.migration_id,
    CAST(CASE WHEN a.n IS NULL THEN 0 ELSE least(100, a.mx + (a.pos - 1) * {fixed.EXTRA_OP_SCORE}) END AS INTEGER) AS overall_score,
    CAST(coalesce(a.n, 0) AS BIGINT) AS n_ops, coalesce(a.tabs, '') AS affected_tables,
    coalesce(a.worst, 0) AS worst, coalesce(a.loss, FALSE) AS loss
  FROM mig m LEFT JOIN magg a USING (migration_id))
"""


def _level(score: str) -> str:
    bands = " ".join(f"WHEN {score} >= {b} THEN {_q(lv)}" for b, lv in fixed.LEVEL_BANDS)
    return f"CASE {bands} ELSE 'safe' END"


def extract_ops_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT e.migration_id, e.stmt_pos, e.action_pos, e.op_class, e.target_table, e.target_column,
       e.target_index, m.dialect, e.parser_notes AS notes
FROM eops e JOIN mig m USING (migration_id)"""


def lock_lookup_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, op_class, row_count, lock_type, risk_level,
       dmin AS duration_min, dmax AS duration_max, all_notes AS notes FROM lk"""


def lock_scaled_sql() -> str:
    return f"""WITH {base_ctes(clause=True, scaled=True)}
SELECT migration_id, stmt_pos, action_pos, op_class, row_count, lock_type, risk_level,
       dmin AS duration_min, dmax AS duration_max, all_notes AS notes, risk_score FROM sc"""


def rollback_ops_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, op_class, rollback_complexity, rollback_description, data_loss FROM rb"""


def op_scores_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, op_class, risk_level, risk_score FROM sc"""


def migration_scores_sql() -> str:
    gate = ", ".join(_q(x) for x in fixed.BLOCKING_LEVELS)
    return f"""WITH {base_ctes()}
SELECT migration_id, overall_score, {_level('overall_score')} AS overall_level, n_ops, affected_tables,
       {_level('overall_score')} IN ({gate}) AS blocked FROM ms"""


def rollback_summary_sql() -> str:
    names = {v: k for k, v in fixed.ROLLBACK_RANK.items()}
    to_name = " ".join(f"WHEN {r} THEN {_q(n)}" for r, n in names.items())
    mins = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in fixed.ROLLBACK_MINUTES.items() if v is not None)
    return f"""WITH {base_ctes()}
SELECT migration_id, cx AS rollback_complexity, CAST(CASE cx {mins} END AS INTEGER) AS rollback_minutes,
       loss AS data_loss_risk,
       trim(concat(CASE WHEN loss THEN {_q(fixed.ROLLBACK_NOTE_DATA_LOSS)} ELSE '' END,
                   CASE WHEN cx = 'none' THEN {_q(fixed.ROLLBACK_NOTE_IRREVERSIBLE)} ELSE '' END)) AS rollback_notes,
       n_ops AS n_steps
FROM (SELECT *, CASE worst {to_name} END AS cx FROM ms)"""


def rollback_steps_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos,
       op_class || ' on `' || coalesce(nullif(target_column, ''), nullif(target_index, ''), target_table)
       || '`: ' || rollback_description AS step
FROM rb"""


def rewrite_worklist_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, op_class, target_table, coalesce(target_column, 'N/A') AS target_column,
       CASE WHEN all_notes = '' THEN risk_level
            ELSE array_to_string(string_split(all_notes, ' | '), '; ')
       END AS risk_reason, {corpus.expected_raw_sql()} AS raw_sql
FROM lk WHERE risk_level IN ({', '.join(_q(x) for x in fixed.BLOCKING_LEVELS)})"""


def _catalog_types_sql() -> str:
    m = ("CASE column_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'INTEGER' THEN 'INTEGER' "
         "WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN 'VARCHAR' THEN 'VARCHAR(255)' "
         "WHEN 'TIMESTAMP' THEN 'TIMESTAMP' WHEN 'DATE' THEN 'DATE' WHEN 'BOOLEAN' THEN 'BOOLEAN' "
         "WHEN 'FLOAT' THEN 'REAL' ELSE 'TEXT' END")
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, column_name, {m} AS data_type FROM (DESCRIBE {t})"
        for t in corpus.CATALOG_TABLES)


def _index_values_sql() -> str:
    vals = ", ".join(f"({_q(t)}, {_q(n)}, {_q(','.join(cols))})"
                     for t, idx in corpus.INDEXES.items() for n, cols in idx)
    return f"(VALUES {vals}) AS ic(table_name, index_name, cols)"


def schema_changes_sql() -> str:
    col_cls = "('ADD_COLUMN', 'DROP_COLUMN', 'ALTER_COLUMN', 'RENAME_COLUMN')"
    tab_cls = "('RENAME_TABLE', 'CREATE_TABLE', 'DROP_TABLE', 'TRUNCATE_TABLE')"
    cat = ", ".join(_q(t) for t in corpus.CATALOG_TABLES)
    return f"""WITH {base_ctes()}, ct AS ({_catalog_types_sql()})
SELECT e.migration_id, e.stmt_pos, e.action_pos,
  CASE WHEN e.op_class IN {col_cls} THEN 'column' WHEN e.op_class IN {tab_cls} THEN 'table'
       WHEN e.op_class IN ('CREATE_INDEX', 'DROP_INDEX') THEN 'index' ELSE 'constraint' END AS object_kind,
  CASE e.op_class WHEN 'ADD_COLUMN' THEN 'added' WHEN 'DROP_COLUMN' THEN 'removed'
       WHEN 'ALTER_COLUMN' THEN 'type_changed' WHEN 'RENAME_COLUMN' THEN 'renamed'
       WHEN 'RENAME_TABLE' THEN 'renamed' WHEN 'CREATE_TABLE' THEN 'added' WHEN 'DROP_TABLE' THEN 'removed'
       WHEN 'TRUNCATE_TABLE' THEN 'truncated' WHEN 'CREATE_INDEX' THEN 'added' WHEN 'DROP_INDEX' THEN 'removed'
       ELSE 'added' END AS change_type,
  e.target_table AS table_name,
  CASE WHEN e.op_class IN {col_cls} THEN coalesce(e.target_column, '') END AS column_name,
  CASE WHEN e.op_class = 'CREATE_INDEX' THEN coalesce(e.target_index, 'idx_' || e.target_table || '_new')
       WHEN e.op_class = 'DROP_INDEX' THEN coalesce(e.target_index, '') END AS index_name,
  CASE WHEN e.op_class = 'DROP_INDEX' THEN coalesce(ic.cols, '') WHEN e.op_class = 'CREATE_INDEX' THEN '' END
    AS index_columns,
  CASE WHEN e.op_class IN ('ADD_CONSTRAINT', 'ADD_FOREIGN_KEY') THEN 'fk_' || e.target_table END AS constraint_name,
  CASE e.op_class WHEN 'ADD_FOREIGN_KEY' THEN 'FOREIGN KEY' WHEN 'ADD_CONSTRAINT' THEN 'CONSTRAINT' END
    AS constraint_type,
  CASE WHEN e.op_class = 'DROP_COLUMN' AND ct.data_type IS NOT NULL THEN e.target_column || ' ' || ct.data_type END
    AS "before",
  CASE WHEN e.op_class = 'ADD_COLUMN' THEN e.target_column END AS "after",
  CASE WHEN e.op_class = 'ADD_COLUMN' THEN e.target_table IN ({cat}) AND coalesce(e.target_column, '') <> ''
                                           AND e.parser_notes LIKE '%NOT NULL%'
       WHEN e.op_class IN ('DROP_COLUMN', 'ALTER_COLUMN', 'RENAME_COLUMN') THEN TRUE ELSE FALSE END AS breaking
FROM eops e
LEFT JOIN ct ON e.op_class = 'DROP_COLUMN' AND ct.table_name = e.target_table AND ct.column_name = e.target_column
LEFT JOIN {_index_values_sql()} ON e.op_class = 'DROP_INDEX' AND ic.table_name = e.target_table
                                 AND ic.index_name = e.target_index
WHERE e.op_class IN ('ADD_COLUMN', 'DROP_COLUMN', 'ALTER_COLUMN', 'RENAME_COLUMN', 'RENAME_TABLE', 'CREATE_TABLE',
                     'DROP_TABLE', 'TRUNCATE_TABLE', 'CREATE_INDEX', 'DROP_INDEX', 'ADD_CONSTRAINT', 'ADD_FOREIGN_KEY')"""


def diff_summary_sql() -> str:
    return f"""WITH ch AS ({schema_changes_sql()}),
agg AS (
  SELECT migration_id,
    count(*) FILTER (WHERE object_kind = 'table') AS table_changes,
    count(*) FILTER (WHERE object_kind = 'column') AS column_changes,
    count(*) FILTER (WHERE object_kind = 'index') AS index_changes,
    count(*) FILTER (WHERE object_kind = 'constraint') AS constraint_changes,
    count(*) FILTER (WHERE object_kind = 'column' AND breaking) AS breaking_changes,
    count(*) FILTER (WHERE object_kind = 'column' AND change_type = 'removed') AS removed_columns,
    count(*) FILTER (WHERE object_kind = 'index' AND change_type = 'removed') AS removed_indexes,
    count(*) FILTER (WHERE object_kind = 'column' AND change_type = 'added' AND breaking) AS added_not_null_columns
  FROM ch GROUP BY migration_id)
SELECT o.o_orderkey AS migration_id,
  CAST(coalesce(table_changes, 0) AS BIGINT) AS table_changes,
  CAST(coalesce(column_changes, 0) AS BIGINT) AS column_changes,
  CAST(coalesce(index_changes, 0) AS BIGINT) AS index_changes,
  CAST(coalesce(constraint_changes, 0) AS BIGINT) AS constraint_changes,
  CAST(coalesce(breaking_changes, 0) AS BIGINT) AS breaking_changes,
  CAST(coalesce(removed_columns, 0) AS BIGINT) AS removed_columns,
  CAST(coalesce(removed_indexes, 0) AS BIGINT) AS removed_indexes,
  CAST(coalesce(added_not_null_columns, 0) AS BIGINT) AS added_not_null_columns,
  coalesce(breaking_changes, 0) > 0 AS has_breaking_changes
FROM orders o LEFT JOIN agg a ON a.migration_id = o.o_orderkey"""


def _query_ctes() -> str:
    return f"""
eq AS ({corpus.expected_queries_sql()}),
dq AS (
  SELECT log_id, query, any_value(event_type) AS event_type,
         arg_min(chunk_id, chunk_id * 1000000 + pos) AS first_chunk,
         arg_min(pos, chunk_id * 1000000 + pos) AS first_pos, count(*) AS frequency
  FROM eq GROUP BY log_id, query),
rq AS (SELECT dq.log_id, dq.query, rv.table_key, rv.column_name
       FROM dq JOIN (SELECT * FROM {corpus.expected_refs_values_sql()}) AS rv USING (event_type))"""


def query_log_sql() -> str:
    return f"""WITH {_query_ctes()}
SELECT log_id, query, first_chunk, first_pos, frequency FROM dq"""


def query_refs_sql() -> str:
    return f"""WITH {_query_ctes()}
SELECT log_id, query, table_key, column_name FROM rq"""


def _impacts_cte() -> str:
    def desc(tpl, col, table):
        return f"replace(replace({_q(tpl)}, '{{col}}', {col}), '{{table}}', {table})"

    idx_desc = f"replace(replace({_q(fixed.IMPACT_INDEX_MISSING)}, '{{index}}', i.index_name), '{{table}}', k.key)"
    return f"""
keys AS (SELECT DISTINCT log_id, query, table_key FROM rq WHERE table_key <> '*'),
colref AS (
  SELECT log_id, query, lower(table_key) AS tkey, column_name AS col FROM rq
  WHERE table_key <> '*' AND column_name IS NOT NULL
  UNION ALL
  SELECT s.log_id, s.query, lower(k.table_key) AS tkey, s.column_name AS col
  FROM rq s JOIN keys k USING (log_id, query) WHERE s.table_key = '*'),
chg AS (
  SELECT DISTINCT e.migration_id, m.db_id,
    CASE e.op_class WHEN 'DROP_COLUMN' THEN 'removed' WHEN 'RENAME_COLUMN' THEN 'renamed' ELSE 'type_changed' END
      AS change_type,
    lower(e.target_table) AS ctable, lower(coalesce(e.target_column, '')) AS ccol
  FROM eops e JOIN mig m USING (migration_id)
  WHERE e.op_class IN ('DROP_COLUMN', 'RENAME_COLUMN', 'ALTER_COLUMN')),
ci AS (
  SELECT c.migration_id, r.log_id, r.query,
    CASE c.change_type WHEN 'removed' THEN 'column_missing' WHEN 'renamed' THEN 'column_renamed'
         ELSE 'type_mismatch' END AS impact_type,
    CASE c.change_type WHEN 'removed' THEN 'critical' WHEN 'renamed' THEN 'high' ELSE 'medium' END AS severity,
    CASE c.change_type WHEN 'removed' THEN {desc(fixed.IMPACT_COLUMN_MISSING, 'r.col', 'r.tkey')}
         WHEN 'renamed' THEN {desc(fixed.IMPACT_COLUMN_RENAMED, 'r.col', 'r.tkey')}
         ELSE {desc(fixed.IMPACT_TYPE_MISMATCH, 'r.col', 'r.tkey')} END AS description,
    r.tkey AS affected_table, r.col AS affected_column
  FROM colref r JOIN chg c ON c.db_id = r.log_id AND c.ctable = r.tkey AND c.ccol = lower(r.col)),
idx AS (
  SELECT e.migration_id, m.db_id, lower(e.target_table) AS itable, coalesce(e.target_index, '') AS index_name,
         coalesce(lower(ic.cols), '') AS icols
  FROM eops e JOIN mig m USING (migration_id)
  LEFT JOIN {_index_values_sql()} ON ic.table_name = e.target_table AND ic.index_name = e.target_index
  WHERE e.op_class = 'DROP_INDEX'),
kc AS (
  SELECT log_id, query, table_key AS key,
         coalesce(list(column_name) FILTER (WHERE column_name IS NOT NULL), []) AS cols
  FROM rq WHERE table_key <> '*' GROUP BY log_id, query, table_key),
ii AS (
  SELECT i.migration_id, k.log_id, k.query, 'index_missing' AS impact_type,
         'medium' AS severity, {idx_desc} AS description, k.key AS affected_table,
         CAST(NULL AS VARCHAR) AS affected_column
  FROM kc k JOIN idx i ON i.db_id = k.log_id AND i.itable = lower(k.key)
  WHERE i.icols = '' OR len(k.cols) = 0 OR len(list_intersect(k.cols, string_split(i.icols, ','))) > 0),
imp AS (SELECT * FROM ci UNION ALL SELECT * FROM ii)"""


def query_impacts_sql() -> str:
    return f"""WITH {base_ctes()}, {_query_ctes()}, {_impacts_cte()}
SELECT * FROM imp"""


def impact_summary_sql() -> str:
    return f"""WITH {base_ctes()}, {_query_ctes()}, {_impacts_cte()},
agg AS (
  SELECT migration_id, count(*) AS n,
    count(*) FILTER (WHERE impact_type = 'column_missing') AS column_missing,
    count(*) FILTER (WHERE impact_type = 'column_renamed') AS column_renamed,
    count(*) FILTER (WHERE impact_type = 'type_mismatch') AS type_mismatch,
    count(*) FILTER (WHERE impact_type = 'index_missing') AS index_missing,
    max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
      AS worst
  FROM imp GROUP BY migration_id)
SELECT m.migration_id, CAST(coalesce(n, 0) AS BIGINT) AS n_impacts,
  CAST(coalesce(column_missing, 0) AS BIGINT) AS column_missing,
  CAST(coalesce(column_renamed, 0) AS BIGINT) AS column_renamed,
  CAST(coalesce(type_mismatch, 0) AS BIGINT) AS type_mismatch,
  CAST(coalesce(index_missing, 0) AS BIGINT) AS index_missing,
  CASE worst WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS worst_impact
FROM mig m LEFT JOIN agg a USING (migration_id)"""


def fk_orphans_sql() -> str:
    parts = []
    for child, col, parent, pcol in corpus.FOREIGN_KEYS:
        parts.append(
            f"SELECT '{child}.{col}->{parent}.{pcol}' AS fk_name, '{child}' AS child_table, '{col}' AS child_column, "
            f"'{parent}' AS parent_table, count(*) AS child_rows, "
            f"count(*) FILTER (WHERE c.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})) AS orphan_rows FROM {child} c")
    return " UNION ALL ".join(parts)


def constraint_violations_sql() -> str:
    parts = []
    for t, keys in corpus.PRIMARY_KEYS.items():
        k = ", ".join(keys)
        parts.append(
            f"SELECT '{t}' AS table_name, 'primary_key({','.join(keys)})' AS check_name, "
            f"CAST(coalesce(sum(n), 0) AS BIGINT) AS violating_rows, count(*) AS violating_keys "
            f"FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)")
    for t, cols in corpus.NOT_NULL_COLUMNS.items():
        for c in cols:
            parts.append(
                f"SELECT '{t}' AS table_name, 'not_null({c})' AS check_name, "
                f"count(*) FILTER (WHERE {c} IS NULL) AS violating_rows, "
                f"count(*) FILTER (WHERE {c} IS NULL) AS violating_keys FROM {t}")
    return " UNION ALL ".join(parts)


def cast_audit_sql() -> str:
    parts = []
    for t, cols in corpus.CATALOG_COLUMNS.items():
        for c, cls in zip(cols, corpus.TYPE_CLASS[t]):
            if cls == "num":
                target = "NUMERIC(18,4)"
                lossy = f"abs(CAST({c} AS DOUBLE)) >= 1e14 OR round(CAST({c} AS DOUBLE), 4) <> CAST({c} AS DOUBLE)"
            elif cls == "str":
                target, lossy = "VARCHAR(100)", f"length({c}) > 100"
            else:
                target, lossy = "DATE", f"date_trunc('day', {c}) <> {c}"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{target}' AS target_type, "
                f"count({c}) AS non_null_rows, count(*) FILTER (WHERE {c} IS NOT NULL AND ({lossy})) AS lossy_rows "
                f"FROM {t}")
    return " UNION ALL ".join(parts)


def not_null_nonempty_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, target_table, target_column, row_count,
       coalesce(row_count > 0, FALSE) AS will_fail
FROM lk WHERE op_class = 'ADD_COLUMN' AND parser_notes = {_q(fixed.NOTE_NOT_NULL_NO_DEFAULT)}"""


def planned_checks_sql() -> str:
    """Facts of every column (type, CHECK) and of every column against its table's parent, met by the templates that ask for them."""
    facts, keys = [], []
    for t, cols in corpus.CATALOG_COLUMNS.items():
        p = corpus.FK_PARENT[t]
        k = corpus.PRIMARY_KEYS[p][0]
        for c, kind in zip(cols, corpus.TYPE_CLASS[t]):
            there = f"TRY_CAST({c} AS DECIMAL(18, 4))"
            back = f"CAST({there} AS VARCHAR) <> {c}" if kind == "str" else f"CAST({there} AS DOUBLE) <> CAST({c} AS DOUBLE)"
            lossy = "NULL" if kind == "ts" else f"count(*) FILTER (WHERE {c} IS NOT NULL AND ({there} IS NULL OR {back}))"
            facts.append(f"SELECT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, count(*) AS n, count({c}) AS filled, {lossy} AS lossy FROM {t}")
            if kind == "num":
                keys.append(f"SELECT '{t}' AS t, '{c}' AS c, count(*) FILTER (WHERE x.{c} IS NOT NULL AND y.k IS NULL) AS orphans "
                            f"FROM {t} x LEFT JOIN (SELECT DISTINCT CAST({k} AS DOUBLE) AS k FROM {p}) y ON y.k = CAST(x.{c} AS DOUBLE)")
    return f"""WITH stm AS ({corpus.expected_statements_sql()}),
f AS ({' UNION ALL '.join(facts)}), o AS ({' UNION ALL '.join(keys)}),
d AS (
  SELECT s.migration_id, s.stmt_pos, CAST(0 AS BIGINT) AS action_pos, s.tid, s.t AS table_name, s.c, s.p || '.' || s.k AS parent,
         f.kind, f.n, f.filled, f.lossy, o.orphans
  FROM stm s JOIN f ON f.t = s.t AND f.c = s.c LEFT JOIN o ON o.t = s.t AND o.c = s.c WHERE s.tid IN (4, 13, 14)),
r AS (
  SELECT *, CASE tid WHEN 4 THEN CASE WHEN kind = 'ts' THEN NULL ELSE filled END WHEN 13 THEN CASE WHEN kind = 'num' THEN n END ELSE n END AS checked_rows,
         CASE tid WHEN 4 THEN lossy WHEN 13 THEN orphans ELSE n - filled END AS violating_rows FROM d)
SELECT migration_id, stmt_pos, action_pos, CASE tid WHEN 4 THEN 'ALTER_COLUMN' WHEN 13 THEN 'ADD_FOREIGN_KEY' ELSE 'ADD_CONSTRAINT' END AS op_class,
       CASE tid WHEN 4 THEN 'type' WHEN 13 THEN 'foreign_key' ELSE 'check' END AS check_kind, table_name,
       CASE WHEN tid = 14 THEN '' ELSE c END AS column_name,
       CASE tid WHEN 4 THEN 'NUMERIC(18,4)' WHEN 13 THEN parent ELSE c || ' IS NOT NULL' END AS argument,
       CASE WHEN checked_rows IS NULL THEN 'type_mismatch' WHEN violating_rows > 0 THEN 'violated' ELSE 'ok' END AS status,
       CAST(checked_rows AS BIGINT) AS checked_rows, CAST(violating_rows AS BIGINT) AS violating_rows
FROM r"""


def file_names_sql() -> str:
    names = "[" + ", ".join(_q(n) for n in corpus.DIALECT_FILES) + "]"
    hints = " OR ".join(f"contains(lower(file_name), {_q(h)})" for h in fixed.MIGRATION_NAME_HINTS)

    def infer(x):
        whens = " ".join(f"WHEN contains(lower({x}), {_q(h)}) THEN {_q(d)}" for h, d in fixed.DIALECT_BY_NAME)
        return f"CASE {whens} ELSE {_q(fixed.DEFAULT_DIALECT)} END"

    return f"""WITH f AS (
  SELECT o_orderkey AS migration_id, o_custkey // {corpus.DB_PER_CUSTOMER_DIV} AS db_id,
         'V' || CAST(o_orderkey AS VARCHAR) || '__'
           || list_extract({names}, CAST(o_orderkey % {len(corpus.DIALECT_FILES)} AS INTEGER) + 1) || '.sql' AS file_name
  FROM orders)
SELECT migration_id, 'db/' || CAST(db_id AS VARCHAR) || '/' || file_name AS path, file_name,
       {infer('file_name')} AS dialect, {infer("'db/' || CAST(db_id AS VARCHAR) || '/' || file_name")} AS dialect_by_path,
       ({hints}) AS is_migration_file
FROM f"""


def report_columns_sql() -> str:
    risk = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fixed.RISK_EMOJI.items())
    rbk = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fixed.ROLLBACK_EMOJI.items())
    full = "CAST(floor(overall_score / 5) AS INTEGER)"
    return f"""WITH {base_ctes()}
SELECT sc.migration_id, stmt_pos, action_pos,
  CASE WHEN dmin IS NOT NULL AND dmax IS NOT NULL THEN
    CASE WHEN dmax < {fixed.INSTANT_BELOW_MINUTES} THEN {_q(fixed.INSTANT_DURATION)}
         ELSE printf('%.1f–%.1f minutes', dmin, dmax) END END AS duration_label,
  CASE risk_level {risk} ELSE {_q(fixed.UNKNOWN_EMOJI)} END AS risk_badge,
  CASE risk_level WHEN 'safe' THEN '✓' WHEN 'low' THEN '✓' WHEN 'medium' THEN '⚠' WHEN 'high' THEN '✗' WHEN 'critical' THEN '✗✗' END AS risk_symbol,
  CASE rollback_complexity {rbk} ELSE {_q(fixed.UNKNOWN_EMOJI)} END AS rollback_badge,
  '[' || repeat({_q(fixed.SCORE_BAR_FULL)}, greatest({full}, 0))
      || repeat({_q(fixed.SCORE_BAR_EMPTY)}, greatest({fixed.SCORE_BAR_WIDTH} - {full}, 0))
      || '] ' || CAST(overall_score AS VARCHAR) || '/100' AS score_bar
FROM sc JOIN ms USING (migration_id)"""


def report_header_sql() -> str:
    names = "[" + ", ".join(_q(n) for n in corpus.DIALECT_FILES) + "]"
    gate = ", ".join(_q(x) for x in fixed.BLOCKING_LEVELS)
    return f"""WITH h AS ({migration_scores_sql()}),
r AS ({rollback_summary_sql()}),
d AS ({diff_summary_sql()}),
i AS ({impact_summary_sql()}),
f AS (
  SELECT o_orderkey AS migration_id, CAST(9 + o_custkey % 6 AS INTEGER) AS db_version,
         list_extract({_dialects_sql()}, CAST(o_orderkey % {len(corpus.DIALECT_FILES)} AS INTEGER) + 1) AS dialect,
         'V' || CAST(o_orderkey AS VARCHAR) || '__'
           || list_extract({names}, CAST(o_orderkey % {len(corpus.DIALECT_FILES)} AS INTEGER) + 1) || '.sql' AS file_name
  FROM orders)
SELECT f.migration_id, f.file_name, f.dialect, f.db_version, h.overall_score, h.overall_level, h.n_ops,
       h.affected_tables, h.overall_level IN ({gate}) AS blocked, r.rollback_complexity, r.rollback_minutes,
       r.data_loss_risk, d.breaking_changes, i.n_impacts, i.worst_impact
FROM f JOIN h USING (migration_id) JOIN r USING (migration_id) JOIN d USING (migration_id)
JOIN i USING (migration_id)"""


def catalog_columns_sql() -> str:
    return f"WITH {databases.DATABASES_SQL} {databases.COLUMNS_SQL}"


def catalog_lookup_sql() -> str:
    tables, columns = ("[" + ", ".join(map(_q, names)) + "]" for names in (databases.LOOKUP_TABLES, databases.LOOKUP_COLUMNS))
    return f"""WITH wanted AS (
  SELECT o_orderkey AS migration_id, o_custkey // {corpus.DB_PER_CUSTOMER_DIV} AS schema_id,
         {tables}[o_orderkey % {len(databases.LOOKUP_TABLES)} + 1] AS table_name,
         {columns}[o_orderkey % {len(databases.LOOKUP_COLUMNS)} + 1] AS column_name
  FROM orders),
found AS (SELECT *, CASE WHEN table_name IN ('account', 'ACCOUNT') THEN 'account' WHEN table_name = 'Order Line' THEN table_name END
          AS catalog_table FROM wanted)
SELECT *, coalesce(catalog_table = 'account' AND (column_name = 'name' OR column_name = 'balance' AND schema_id % 4 <> 0)
                   OR catalog_table = 'Order Line' AND column_name = 'QTY', FALSE) AS column_present
FROM found"""


def snapshot_diff_sql() -> str:
    return f"WITH {databases.DATABASES_SQL} {databases.CHANGES_SQL}"


def custom_rules_sql() -> str:
    led = ", ".join(f"({_q(t)}, {_q(cols[0])})" for t, some in corpus.INDEXES.items() for _, cols in some)
    referred = ", ".join(f"({_q(p)}, {_q(k)})" for _, _, p, k in corpus.FOREIGN_KEYS)
    return f"""WITH {base_ctes()}
SELECT migration_id, stmt_pos, action_pos, op_class, target_table, 'fk-without-index' AS rule, 'medium' AS rule_risk_level,
       'No index leads with the foreign key''s column' AS message, 'Create the index first' AS suggestion
FROM lk WHERE op_class = 'ADD_FOREIGN_KEY' AND (base_t, base_c) NOT IN (VALUES {led})
UNION ALL
SELECT migration_id, stmt_pos, action_pos, op_class, target_table, 'referenced-column', 'critical', 'Another table refers to this column', 'Drop the reference first'
FROM lk WHERE op_class = 'DROP_COLUMN' AND (target_table, target_column) IN (VALUES {referred})
UNION ALL
SELECT migration_id, stmt_pos, action_pos, op_class, target_table, 'no-drop' AS rule, 'critical' AS rule_risk_level,
       'Removes data' AS message, 'Archive it first' AS suggestion
FROM lk WHERE op_class IN ('DROP_TABLE', 'DROP_COLUMN')
UNION ALL
SELECT migration_id, stmt_pos, action_pos, op_class, target_table, 'large-rewrite', 'high', 'Rewrites a large table', 'Use a shadow column'
FROM lk WHERE op_class = 'ALTER_COLUMN' AND row_count >= 1000"""


def markdown_report_sql() -> str:
    """Every line of every report, spelled out from the header, operation, impact and rollback rows."""
    def pick(col, table):
        return f"(CASE {col} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {_q(fixed.UNKNOWN_EMOJI)} END)"

    risk, back = lambda c: pick(c, fixed.RISK_EMOJI), lambda c: pick(c, fixed.ROLLBACK_EMOJI)
    duration = (f"CASE WHEN dmax < {fixed.INSTANT_BELOW_MINUTES} THEN {_q(fixed.INSTANT_DURATION)} "
                "ELSE printf('%.1f–%.1f minutes', dmin, dmax) END")
    return f"""WITH {base_ctes()},
h AS ({report_header_sql()}), rs AS ({rollback_summary_sql()}), im AS ({query_impacts_sql()}),
texts AS (
  SELECT h.migration_id, 0 AS section, 0 AS k1, 0 AS k2, '' AS k4, [
    '## Migration Risk Report — `' || file_name || '`', '',
    '**Risk Score:** ' || {risk('overall_level')} || ' **' || upper(overall_level) || '** (' || overall_score || '/100)  |  **Dialect:** '
      || dialect || ' ' || db_version || '  |  **Operations:** ' || n_ops, '', '### Operations Detected', ''] AS lines FROM h
  UNION ALL
  SELECT migration_id, 1, stmt_pos, action_pos, '', list_filter([
    '<details><summary>' || {risk('risk_level')} || ' **' || op_class || '** on `' || target_table || '`'
      || coalesce('.`' || target_column || '`', '') || ' — ' || upper(risk_level) || '</summary>', '',
    '**Lock type:** `' || lock_type || '`',
    CASE WHEN dmin IS NOT NULL AND dmax IS NOT NULL THEN '  ' || chr(10) || '**Estimated duration:** ' || {duration} END,
    '  ' || chr(10) || '**Rollback:** ' || {back('rollback_complexity')} || ' `' || upper(rollback_complexity) || '`',
    CASE WHEN rollback_description <> '' THEN ' — ' || rollback_description END]
    || CASE WHEN all_notes = '' THEN [] ELSE ['', '**Notes:**'] || list_transform(string_split(all_notes, ' | '), lambda n: '- ' || n) END
    || ['', '</details>', ''], lambda x: x IS NOT NULL) FROM sc
  UNION ALL
  SELECT migration_id, 2, 0, 0, '', ['### ⚡ Affected Queries (' || n_impacts || ')', '',
    '| Severity | Impact Type | Affected Table | Description |', '|----------|-------------|----------------|-------------|']
  FROM h WHERE n_impacts > 0
  UNION ALL
  SELECT migration_id, 3, 0, 0,
    concat_ws(chr(1), impact_type, affected_table, coalesce(affected_column, ''), description, query),
    ['| ' || {risk('severity')} || ' ' || upper(severity) || ' | `' || impact_type || '` | `' || affected_table || '` | '
      || left(description, {fixed.IMPACT_DESCRIPTION_LIMIT}) || ' |'] FROM im
  UNION ALL
  SELECT migration_id, 4, 0, 0, '', [''] FROM h WHERE n_impacts > 0
  UNION ALL
  SELECT migration_id, 5, 0, 0, '', list_filter([
    '### Rollback Complexity: ' || {back('rollback_complexity')} || ' ' || upper(rollback_complexity),
    CASE WHEN rollback_minutes <> 0 THEN '- Estimated rollback window: **~' || rollback_minutes || ' minutes**' END,
    CASE WHEN data_loss_risk THEN {_q(fixed.DATA_LOSS_LINE)} END,
    CASE WHEN rollback_notes <> '' THEN '- ' || rollback_notes END,
    '', '---', '*Generated • 1970-01-01 00:00 UTC*'], lambda x: x IS NOT NULL) FROM rs)
SELECT migration_id, section, k1, k2, generate_subscripts(lines, 1) - 1 AS k3, k4, unnest(lines) AS line FROM texts"""


def _array(text: str, separator: str) -> str:
    return f"CASE WHEN {text} = '' THEN [] ELSE string_split({text}, {_q(separator)}) END"


def _json(**fields) -> str:
    """The text of an object with these fields, in order."""
    return "CAST(json_object(" + ", ".join(f"{_q(k)}, {v}" for k, v in fields.items()) + ") AS VARCHAR)"


_IMPACT_KEY = "concat_ws(chr(1), impact_type, affected_table, coalesce(affected_column, ''), description, query)"


def _report_ctes() -> str:
    """h (one row per migration), o (operations with their text), im (impacts), st (rollback steps)."""
    return f"""{base_ctes()},
h AS (SELECT * FROM ({report_header_sql()}) JOIN (SELECT migration_id, rollback_notes, n_steps FROM ({rollback_summary_sql()})) USING (migration_id)),
o AS (SELECT *, {corpus.expected_raw_sql()} AS raw_sql, {_array('all_notes', ' | ')} AS notes FROM sc),
im AS (SELECT *, {_IMPACT_KEY} AS k FROM ({query_impacts_sql()})), st AS ({rollback_steps_sql()})"""


def json_report_sql() -> str:
    report = _json(
        record="'report'", migration_id="migration_id", migration_file="file_name", generated_at="'1970-01-01T00:00:00Z'", dialect="dialect",
        db_version="db_version", overall_risk_score="overall_score", overall_risk_level="overall_level", n_ops="n_ops",
        affected_tables=_array("affected_tables", ","), blocked="blocked",
        rollback="json_object('complexity', rollback_complexity, 'estimated_minutes', rollback_minutes, 'data_loss_risk', data_loss_risk, "
                 "'notes', rollback_notes, 'n_steps', n_steps)",
        diff_summary="json_object('table_changes', table_changes, 'column_changes', column_changes, 'index_changes', index_changes, "
                     "'constraint_changes', constraint_changes, 'breaking_changes', breaking_changes)",
        impact_summary="json_object('n_impacts', n_impacts, 'column_missing', column_missing, 'column_renamed', column_renamed, "
                       "'type_mismatch', type_mismatch, 'index_missing', index_missing, 'worst_impact', worst_impact)")
    operation = _json(
        record="'operation'", migration_id="migration_id", stmt_pos="stmt_pos", action_pos="action_pos", operation_class="op_class",
        target_table="target_table", target_column="target_column", target_index="target_index", dialect="dialect", raw_sql="raw_sql",
        risk_level="risk_level", lock_type="lock_type", estimated_duration_min="dmin", estimated_duration_max="dmax",
        rollback_complexity="rollback_complexity", rollback_description="rollback_description", risk_score="risk_score", notes="notes")
    impact = _json(record="'impact'", migration_id="migration_id", query="query", impact_type="impact_type", severity="severity",
                   description="description", affected_table="affected_table", affected_column="affected_column")
    step = _json(record="'rollback_step'", migration_id="migration_id", stmt_pos="stmt_pos", action_pos="action_pos", step="step")
    return f"""WITH {_report_ctes()},
d AS (SELECT migration_id, table_changes, column_changes, index_changes, constraint_changes FROM ({diff_summary_sql()})),
i AS (SELECT migration_id, column_missing, column_renamed, type_mismatch, index_missing FROM ({impact_summary_sql()}))
SELECT migration_id, 0 AS section, 0 AS k1, 0 AS k2, 0 AS k3, '' AS k4, {report} AS json FROM h JOIN d USING (migration_id) JOIN i USING (migration_id)
UNION ALL SELECT migration_id, 1, stmt_pos, action_pos, 0, '', {operation} FROM o
UNION ALL SELECT migration_id, 2, 0, 0, 0, k, {impact} FROM im
UNION ALL SELECT migration_id, 3, stmt_pos, action_pos, 0, '', {step} FROM st"""


def analysis_payload_sql() -> str:
    summary = _json(
        record="'summary'", migration_file="file_name", dialect="dialect", db_version="db_version", overall_risk_score="overall_score",
        overall_risk_level="overall_level",
        rollback="json_object('complexity', rollback_complexity, 'estimated_minutes', rollback_minutes, 'data_loss_risk', data_loss_risk, 'notes', rollback_notes)")
    operation = _json(
        record="'operation'", stmt_pos="stmt_pos", action_pos="action_pos", op="op_class", table="target_table", column="target_column",
        index="target_index", risk_level="risk_level", risk_score="risk_score", lock_type="lock_type", duration_min="dmin", duration_max="dmax",
        rollback_complexity="rollback_complexity", rollback_description="rollback_description", notes="notes", raw_sql="raw_sql")
    impact = _json(record="'impact'", impact_type="impact_type", severity="severity", affected_table="affected_table",
                   affected_column="affected_column", description="description", query="query")
    return f"""WITH {_report_ctes()}
SELECT migration_id, 0 AS section, {summary} AS json FROM h
UNION ALL SELECT migration_id, 1, {operation} FROM o
UNION ALL SELECT migration_id, 2, {impact} FROM im"""


def report_documents_sql() -> str:
    """Nested documents: every list aggregated in its order, then the objects around them."""
    def listed(name, source, order, value):
        return f"{name} AS (SELECT migration_id, list({value} ORDER BY {order}) AS items FROM {source} GROUP BY migration_id)"

    def obj(**fields):
        return "json_object(" + ", ".join(f"{_q(k)}, {v}" for k, v in fields.items()) + ")"

    nothing = "CAST([] AS VARCHAR[])"
    operation = obj(
        operation_class="op_class", target_table="target_table", target_column="target_column", target_index="target_index", dialect="dialect",
        raw_sql="raw_sql", risk_level="risk_level", lock_type="lock_type", estimated_duration_min="dmin", estimated_duration_max="dmax",
        rollback_complexity="rollback_complexity", rollback_description="rollback_description", affected_queries=nothing, notes="notes",
        llm_summary="NULL", safe_rewrite="NULL")
    told = obj(operation="op_class", table="target_table", column="target_column", risk_level="risk_level", lock_type="lock_type",
               duration_min_minutes="dmin", duration_max_minutes="dmax", rollback_complexity="rollback_complexity",
               rollback_description="rollback_description", notes="notes", affected_queries=nothing)
    impact = obj(query="query", impact_type="impact_type", severity="severity", description="description", affected_table="affected_table",
                 affected_column="affected_column")
    met = obj(query="query", impact_type="impact_type", severity="severity", description="description")

    def items(name):
        return f"coalesce({name}.items, [])"

    report = _json(
        migration_file="file_name", schema_file="NULL", query_log_file="NULL", generated_at="'1970-01-01T00:00:00Z'", dialect="dialect",
        db_version="db_version", operations=items("op"), query_impacts=items("hit"),
        rollback=obj(complexity="rollback_complexity", estimated_minutes="rollback_minutes", steps=items("todo"), data_loss_risk="data_loss_risk",
                     notes="rollback_notes"),
        plain_english_summary="NULL", stakeholder_summary="NULL", safe_rewrite_sql="NULL")
    payload = _json(
        migration_file="file_name", dialect="dialect", db_version="db_version", overall_risk_score="overall_score", overall_risk_level="overall_level",
        operations=items("told"), query_impacts=items("met"),
        rollback=obj(complexity="rollback_complexity", estimated_minutes="rollback_minutes", data_loss_risk="data_loss_risk", notes="rollback_notes"))
    at = "stmt_pos, action_pos"
    return f"""WITH {_report_ctes()},
{listed('op', 'o', at, operation)}, {listed('told', 'o', at, told)},
{listed('found', 'o', at, obj(op='op_class', table='target_table', notes='notes'))},
{listed('hit', 'im', 'k', impact)}, {listed('met', 'im', 'k', met)}, {listed('todo', 'st', at, 'step')}
SELECT migration_id, 'report' AS kind, {report} AS document
FROM h LEFT JOIN op USING (migration_id) LEFT JOIN hit USING (migration_id) LEFT JOIN todo USING (migration_id)
UNION ALL
SELECT migration_id, 'payload', {payload} FROM h LEFT JOIN told USING (migration_id) LEFT JOIN met USING (migration_id)
UNION ALL
SELECT migration_id, 'findings', {_json(operations=items('found'))} FROM h LEFT JOIN found USING (migration_id)"""


def report_counts_sql() -> str:
    return f"""WITH h AS ({report_header_sql()}), im AS (SELECT migration_id, count(*) AS n FROM ({query_impacts_sql()}) GROUP BY migration_id),
ops AS (SELECT migration_id, count(*) AS n FROM ({op_scores_sql()}) GROUP BY migration_id),
md AS (SELECT migration_id, 'markdown.' || section AS part, count(*) AS n FROM ({markdown_report_sql()}) GROUP BY migration_id, section)
SELECT migration_id, part, n FROM md
UNION ALL SELECT migration_id, unnest(['json.report', 'payload.summary']), 1 FROM h
UNION ALL SELECT migration_id, unnest(['json.operation', 'json.rollback_step', 'payload.operation']), n FROM ops
UNION ALL SELECT migration_id, unnest(['json.impact', 'payload.impact']), n FROM im"""
