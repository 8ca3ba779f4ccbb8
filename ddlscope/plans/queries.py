"""Registered queries: one per operator group, each (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the corpus derivation) in
full; lists are returned joined with ' | ' or ',' so they compare as
scalars against the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions.lexer import lit
from ddlscope.operators import catalog, scoring
from ddlscope.plans.analysis import Analysis
from ddlscope.sources import databases



def _key():
    return ["migration_id", F.col("stmt_pos").cast("long").alias("stmt_pos"),
            F.col("action_pos").cast("long").alias("action_pos")]


def _a(spark: SparkSession, sf_dir: str) -> Analysis:
    """A lazily built Analysis of the query's own: no query reads what another has left."""
    return Analysis.from_tables(spark, sf_dir)


def q_extract_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P7 + S2: classified operations of every script."""
    o = _a(spark, sf_dir).extracted
    return o.select(*_key(), "op_class", "target_table", "target_column", "target_index", "dialect",
                    F.array_join("parser_notes", " | ").alias("notes"))


def q_lock_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L4: lock type, risk, duration bounds and notes with real row counts."""
    o = _a(spark, sf_dir).ops
    return o.select(*_key(), "op_class", "row_count", "lock_type", "risk_level", "duration_min", "duration_max",
                    F.array_join("notes", " | ").alias("notes"))


def q_lock_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L4 + K1 by the clauses themselves, with 1,000 times the rows and an unknown size: the rules that notes and small tables don't reach."""
    a = Analysis.from_tables(spark, sf_dir, flags="clause")
    a.table_stats = a.table_stats.withColumn("row_count", F.when(F.col("table_name") == "region", 0).otherwise(F.col("row_count") * 1000))
    return a.ops.select(*_key(), "op_class", "row_count", "lock_type", "risk_level", "duration_min", "duration_max",
                        F.array_join("notes", " | ").alias("notes"), "risk_score")


def q_rollback_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollback class of every operation."""
    o = _a(spark, sf_dir).ops
    return o.select(*_key(), "op_class", "rollback_complexity", "rollback_description", "data_loss")


def q_op_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: risk score of every operation."""
    o = _a(spark, sf_dir).ops
    return o.select(*_key(), "op_class", "risk_level", "risk_score")


def q_migration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2-K5: overall score, level, op count, affected tables, CI gate per migration."""
    s = _a(spark, sf_dir).scores
    return s.select("migration_id", "overall_score", "overall_level", "n_ops",
                    F.array_join("affected_tables", ",").alias("affected_tables"), "blocked")


def q_rollback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, R3, R5, R6 per migration."""
    return _a(spark, sf_dir).rollback_summary


def q_rollback_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollback steps in long form."""
    r = _a(spark, sf_dir).rollback_steps
    return r.select(*_key(), "step")


def q_rewrite_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: high/critical operations with their reason."""
    w = scoring.rewrite_worklist(_a(spark, sf_dir).ops)
    return w.select(*_key(), "op_class", "target_table", "target_column", "risk_reason", "raw_sql")


def q_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D6 (+ C1-C4 lookups): schema changes against the before-catalogue."""
    c = _a(spark, sf_dir).changes
    return c.select(*_key(), "object_kind", "change_type", "table_name", "column_name", "index_name",
                    F.array_join("index_columns", ",").alias("index_columns"), "constraint_name",
                    "constraint_type", "before", "after", "breaking")


def q_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 + D8 per migration."""
    return _a(spark, sf_dir).diff_summary


def q_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q4: distinct logged queries per log with first position and frequency."""
    return _a(spark, sf_dir).logged_queries


def q_query_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: table / column references of every distinct logged query."""
    from ddlscope.operators.querylog import references_long

    return references_long(_a(spark, sf_dir).query_refs, ["log_id", "query"])


def q_query_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6-Q11: queries each migration breaks or slows down."""
    return _a(spark, sf_dir).impacts


def q_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact counts and worst severity per migration."""
    return _a(spark, sf_dir).impact_summary


def q_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: child rows without a parent for every declared foreign key."""
    from ddlscope.operators.checks import fk_orphans
    from ddlscope.sources.corpus import FOREIGN_KEYS

    return fk_orphans(spark, sf_dir, FOREIGN_KEYS)


def q_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: primary-key duplicates and NOT NULL violations of the catalogue tables."""
    from ddlscope.operators.checks import constraint_violations
    from ddlscope.sources.corpus import NOT_NULL_COLUMNS, PRIMARY_KEYS

    return constraint_violations(spark, sf_dir, PRIMARY_KEYS, NOT_NULL_COLUMNS)


def q_cast_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: values a type change would alter, per catalogue column."""
    from ddlscope.operators.checks import cast_audit
    from ddlscope.sources.corpus import CATALOG_COLUMNS

    return cast_audit(spark, sf_dir, CATALOG_COLUMNS)


def q_not_null_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: NOT NULL additions without DEFAULT on tables that have rows."""
    from ddlscope.operators.checks import not_null_nonempty

    return not_null_nonempty(_a(spark, sf_dir).ops)


def q_planned_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V3 as the scripts demand them: what every foreign key, CHECK and new type meets in the data."""
    from ddlscope.operators.planned import planned_checks, settle_checks
    from ddlscope.session import read_table, written
    from ddlscope.sources.corpus import CATALOG_TABLES

    # read twice, for the distinct demands and for the results: only what demands something is written
    planned = written(planned_checks(_a(spark, sf_dir).extracted), "planned")
    found = settle_checks(planned, lambda t: read_table(spark, sf_dir, t) if t in CATALOG_TABLES else None)
    return found.select(*_key(), "op_class", "check_kind", "table_name", "column_name", "argument", "status", "checked_rows", "violating_rows")


def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S3: dialect from the base name and from the whole path; migration-file test."""
    from ddlscope.sources.files import infer_dialect, is_migration_file

    s = _a(spark, sf_dir).scripts
    return s.select("migration_id", "path", "file_name",
                    infer_dialect(F.col("path"), scope="name").alias("dialect"),
                    infer_dialect(F.col("path"), scope="path").alias("dialect_by_path"),
                    is_migration_file(F.col("path")).alias("is_migration_file"))


def q_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration label, badges and score bar of every operation."""
    from ddlscope.plans.report import report_columns

    return report_columns(_a(spark, sf_dir))


def q_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown report lines of every migration, with their order key."""
    from ddlscope.plans.report import markdown_lines

    return markdown_lines(_a(spark, sf_dir))


def q_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records (report, operation, impact) of every migration, with their order key."""
    from ddlscope.plans.report import json_records

    return json_records(_a(spark, sf_dir))


def q_report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: one header row per migration — scores, rollback, diff and impact counts."""
    a = _a(spark, sf_dir).shared(texts=False)
    h = a.heads.join(a.diff_summary, "migration_id", "left").join(a.impact_summary, "migration_id", "left")
    return h.select("migration_id", "file_name", "dialect", "db_version", "overall_score", "overall_level",
                    "n_ops", F.array_join("affected_tables", ",").alias("affected_tables"), "blocked",
                    "rollback_complexity", "rollback_minutes", "data_loss_risk", "breaking_changes",
                    "n_impacts", "worst_impact")


def q_analysis_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: per-migration summary and per-operation findings as JSON (narration inputs)."""
    from ddlscope.plans.report import analysis_payload

    return analysis_payload(_a(spark, sf_dir))


def q_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + K6 + K8 nested: the JSON report, the narrator's payload and the findings of every migration, a document each."""
    from ddlscope.plans import documents

    return documents.all_documents(_a(spark, sf_dir))


def q_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7 + K8: records and lines per migration and kind."""
    from ddlscope.plans.report import report_counts

    return report_counts(_a(spark, sf_dir))


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every migration (the minimum end-to-end slice)."""
    s = _a(spark, sf_dir).scores
    return s.select("migration_id", "overall_score", "overall_level", "n_ops", "blocked")


def q_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2: columns, defaults and keys of every database's dump."""
    cols = catalog.catalog_columns(databases.dumps_before(spark, sf_dir))
    return cols.withColumn("column_pos", F.col("column_pos").cast("int"))


def q_catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C5: a table and column name per order, looked up in its database."""
    cols = catalog.catalog_columns(databases.dumps_before(spark, sf_dir))
    found = catalog.lookup_table(databases.lookups(spark, sf_dir), "table_name", cols.select("schema_id", "table_name").distinct())
    return catalog.has_column(found, "catalog_table", "column_name", cols)


def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 + C6: what a release changes in every database, and whether changed types are of one family."""
    before, after = (catalog.catalog_columns(f(spark, sf_dir)) for f in (databases.dumps_before, databases.dumps_after))
    ch = catalog.snapshot_diff(before, after)
    same = F.when(F.col("change_type") == "type_changed", catalog.type_compatible(F.col("before"), F.col("after")))
    return ch.withColumn("same_family", same)


def custom_rule_list() -> list[tuple]:
    """K9: (name, predicate, level, message, suggestion)."""
    return [
        ("no-drop", F.col("op_class").isin("DROP_TABLE", "DROP_COLUMN"), "critical", "Removes data", "Archive it first"),
        ("large-rewrite", (F.col("op_class") == "ALTER_COLUMN") & (F.col("row_count") >= 1000), "high", "Rewrites a large table",
         "Use a shadow column"),
    ]


def catalog_rule_list(a: Analysis) -> list[scoring.CatalogRule]:
    """K9 with the catalogue: foreign keys without an index, and dropped columns that another table refers to."""
    from ddlscope.operators.planned import FOREIGN_KEY

    led = a.catalog_indexes.select("table_name", F.col("columns")[0].alias("column_name"))
    referred = a.catalog_columns.filter("references IS NOT NULL").select(F.col("references").alias("name"))
    column = f"regexp_extract(raw_sql, {lit(FOREIGN_KEY)}, 1)"
    return [
        scoring.CatalogRule("fk-without-index", F.col("op_class") == "ADD_FOREIGN_KEY", led, {"table_name": "target_table", "column_name": column},
                            False, "medium", "No index leads with the foreign key's column", "Create the index first"),
        scoring.CatalogRule("referenced-column", F.col("op_class") == "DROP_COLUMN", referred, {"name": "concat(target_table, '.', target_column)"},
                            True, "critical", "Another table refers to this column", "Drop the reference first"),
    ]


def q_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a caller's rules over every operation, by its own columns and by the catalogue."""
    a = _a(spark, sf_dir).shared()
    hits = scoring.custom_rules(a.ops, custom_rule_list()).unionByName(scoring.catalog_rules(a.ops, catalog_rule_list(a)))
    return hits.select(*_key(), "op_class", "target_table", "rule", "rule_risk_level", "message", "suggestion")


QUERIES = {
    "q_extract_ops": q_extract_ops,
    "q_lock_lookup": q_lock_lookup,
    "q_lock_scaled": q_lock_scaled,
    "q_rollback_ops": q_rollback_ops,
    "q_op_scores": q_op_scores,
    "q_migration_scores": q_migration_scores,
    "q_rollback_summary": q_rollback_summary,
    "q_rollback_steps": q_rollback_steps,
    "q_rewrite_worklist": q_rewrite_worklist,
    "q_schema_changes": q_schema_changes,
    "q_diff_summary": q_diff_summary,
    "q_query_log": q_query_log,
    "q_query_refs": q_query_refs,
    "q_query_impacts": q_query_impacts,
    "q_impact_summary": q_impact_summary,
    "q_fk_orphans": q_fk_orphans,
    "q_constraint_violations": q_constraint_violations,
    "q_cast_audit": q_cast_audit,
    "q_not_null_nonempty": q_not_null_nonempty,
    "q_planned_checks": q_planned_checks,
    "q_file_names": q_file_names,
    "q_report_columns": q_report_columns,
    "q_markdown_report": q_markdown_report,
    "q_json_report": q_json_report,
    "q_report_header": q_report_header,
    "q_analysis_payload": q_analysis_payload,
    "q_report_documents": q_report_documents,
    "q_report_counts": q_report_counts,
    "q_catalog_columns": q_catalog_columns,
    "q_catalog_lookup": q_catalog_lookup,
    "q_snapshot_diff": q_snapshot_diff,
    "q_custom_rules": q_custom_rules,
}


def oracle_sql() -> dict[str, str]:
    from ddlscope.plans import oracle

    return {
        "q_extract_ops": oracle.extract_ops_sql(),
        "q_lock_lookup": oracle.lock_lookup_sql(),
        "q_lock_scaled": oracle.lock_scaled_sql(),
        "q_rollback_ops": oracle.rollback_ops_sql(),
        "q_op_scores": oracle.op_scores_sql(),
        "q_migration_scores": oracle.migration_scores_sql(),
        "q_rollback_summary": oracle.rollback_summary_sql(),
        "q_rollback_steps": oracle.rollback_steps_sql(),
        "q_rewrite_worklist": oracle.rewrite_worklist_sql(),
        "q_schema_changes": oracle.schema_changes_sql(),
        "q_diff_summary": oracle.diff_summary_sql(),
        "q_query_log": oracle.query_log_sql(),
        "q_query_refs": oracle.query_refs_sql(),
        "q_query_impacts": oracle.query_impacts_sql(),
        "q_impact_summary": oracle.impact_summary_sql(),
        "q_fk_orphans": oracle.fk_orphans_sql(),
        "q_constraint_violations": oracle.constraint_violations_sql(),
        "q_cast_audit": oracle.cast_audit_sql(),
        "q_not_null_nonempty": oracle.not_null_nonempty_sql(),
        "q_planned_checks": oracle.planned_checks_sql(),
        "q_file_names": oracle.file_names_sql(),
        "q_report_columns": oracle.report_columns_sql(),
        "q_report_header": oracle.report_header_sql(),
        "q_markdown_report": oracle.markdown_report_sql(),
        "q_json_report": oracle.json_report_sql(),
        "q_analysis_payload": oracle.analysis_payload_sql(),
        "q_report_documents": oracle.report_documents_sql(),
        "q_report_counts": oracle.report_counts_sql(),
        "q_catalog_columns": oracle.catalog_columns_sql(),
        "q_catalog_lookup": oracle.catalog_lookup_sql(),
        "q_snapshot_diff": oracle.snapshot_diff_sql(),
        "q_custom_rules": oracle.custom_rules_sql(),
    }
