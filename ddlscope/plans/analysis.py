"""End-to-end analysis: scripts -> operations -> locks, rollback, diff -> scores.

``Analysis`` builds the lazy DataFrames of every stage once; nothing runs
until a sink or ``collect`` asks for a result.  The plan shape at scale:

* extraction is row-local on the scripts (no shuffle);
* lock and rollback rules are fixed-size broadcast joins;
* row counts and catalogue lookups are left joins on unique keys (the
  planner broadcasts them when their measured size is small, AQE re-plans
  at run time otherwise);
* per-migration results are partial aggregates grouped by migration_id;
  the ops keep the partitioning of the scripts, so the aggregate and the
  left join back to the migrations reuse it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.operators import catalog, diff, extract, locks, querylog, rollback, scoring
from ddlscope.sources import corpus
from ddlscope.session import keep_methods_compiled, written
from ddlscope.sources.files import infer_dialect


@dataclass
class Analysis:
    spark: SparkSession
    scripts: DataFrame            # migration_id, db_id, db_version, path, file_name, text[, schema_id]
    table_stats: DataFrame        # table_name, row_count[, schema_id]
    schema_dumps: DataFrame       # schema_id, text
    query_logs: DataFrame | None = None   # log_id, chunk_id, text[, db_id]
    flags: str = "notes"
    with_diff: bool = True        # the tool computes no diff (hence no impacts) without a schema
    migration_rows: DataFrame | None = None   # one row per migration without its text (optional)

    def __post_init__(self) -> None:
        keep_methods_compiled(self.spark)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, flags: str = "notes") -> "Analysis":
        return cls(
            spark=spark,
            scripts=corpus.migration_scripts(spark, sf_dir),
            table_stats=corpus.table_stats(spark, sf_dir),
            schema_dumps=corpus.schema_dumps(spark, sf_dir),
            query_logs=corpus.query_log_chunks(spark, sf_dir),
            flags=flags,
            migration_rows=corpus.migration_rows(spark, sf_dir),
        )

    @classmethod
    def from_files(cls, spark: SparkSession, scripts: str | list[str], schema: str | list[str] | None = None,
                   query_logs: str | list[str] | None = None, row_counts: dict[str, int] | None = None,
                   db_version: int = 14, flags: str = "notes") -> "Analysis":
        """The tool's own inputs: migration script files, a schema dump, query logs.

        Every script is checked against every given log (one database);
        dialects come from the script names; ``row_counts`` feeds the
        duration estimates (none by default, as the tool's pipeline).
        """
        from ddlscope.sources import files

        s = files.read_scripts(spark, scripts).withColumn("db_id", F.lit(0).cast("long")) \
            .withColumn("db_version", F.lit(db_version).cast("int"))
        # several dumps are parts of one schema, in the order of their paths
        dumps = (files.read_schema_dumps(spark, schema).select(F.lit("main").alias("schema_id"), F.col("schema_id").alias("part"), "text")
                 if schema is not None else spark.createDataFrame([], "schema_id string, text string"))
        # each file is a log of its own, with its own mode; all belong to the one database
        logs = (files.read_query_logs(spark, query_logs).withColumn("db_id", F.lit(0).cast("long"))
                if query_logs is not None else spark.createDataFrame([], "log_id string, db_id long, chunk_id long, text string"))
        stats = spark.createDataFrame(list((row_counts or {}).items()), "table_name string, row_count long")
        return cls(spark=spark, scripts=s, table_stats=stats, schema_dumps=dumps, query_logs=logs, flags=flags,
                   with_diff=schema is not None)

    # ---- catalogue -----------------------------------------------------
    @cached_property
    def catalog_columns(self) -> DataFrame:
        return catalog.catalog_columns(self.schema_dumps)

    @cached_property
    def catalog_indexes(self) -> DataFrame:
        return catalog.catalog_indexes(self.schema_dumps)

    # ---- operations ----------------------------------------------------
    @cached_property
    def migrations(self) -> DataFrame:
        src = self.migration_rows if self.migration_rows is not None else self.scripts
        keep = [c for c in ("db_id", "db_version", "file_name", "dialect") if c in src.columns]
        m = src.select("migration_id", *keep)
        if "dialect" not in m.columns and "file_name" in m.columns:
            m = m.withColumn("dialect", infer_dialect(F.col("file_name")))
        return m

    @cached_property
    def extracted(self) -> DataFrame:
        keep = [c for c in ("db_id", "db_version", "schema_id") if c in self.scripts.columns]
        ops = extract.extract_operations(self.scripts, keep=keep)
        return extract.resolve_index_tables(ops, self.catalog_indexes)

    @cached_property
    def ops(self) -> DataFrame:
        """Operations with lock, rollback and score columns."""
        o = locks.apply_lock_analysis(self.extracted, self.table_stats, self.spark, flags=self.flags)
        o = rollback.classify_rollback(o, self.spark)
        return scoring.with_op_scores(o)

    # ---- per migration -------------------------------------------------
    @cached_property
    def scores(self) -> DataFrame:
        return scoring.migration_scores(self.ops, self.migrations)

    @cached_property
    def rollback_summary(self) -> DataFrame:
        return rollback.rollback_summary(self.ops, self.migrations)

    @cached_property
    def heads(self) -> DataFrame:
        """``scores`` with ``rollback_summary``, out of one aggregation."""
        agg = self.ops.groupBy("migration_id").agg(*scoring.score_parts(), *rollback.summary_parts())
        return self.migrations.join(agg.hint("merge"), "migration_id", "left") \
            .select(*self.migrations.columns, *scoring.scores_of_parts(), *rollback.summary_of_parts())

    @cached_property
    def rollback_steps(self) -> DataFrame:
        return rollback.rollback_steps(self.ops)

    @cached_property
    def changes(self) -> DataFrame:
        ch = diff.schema_changes(self.extracted, self.catalog_columns, self.catalog_indexes)
        return ch if self.with_diff else ch.filter(F.lit(False))

    @cached_property
    def diff_summary(self) -> DataFrame:
        return diff.diff_summary(self.changes, self.migrations)

    # ---- query logs ------------------------------------------------------
    @cached_property
    def logged_queries(self) -> DataFrame:
        return querylog.extract_queries(self.query_logs)

    @cached_property
    def query_refs(self) -> DataFrame:
        return querylog.with_references(self.logged_queries)

    @cached_property
    def impact_refs(self) -> DataFrame:
        """The references that changes can meet, worked out once for the column and the index join and for the counts."""
        ids = [c for c in ("log_id", "db_id") if c in self.query_refs.columns]
        return written(self.query_refs.select(*ids, "query", "ref_keys", "key_cols", "star_cols",
                                              F.monotonically_increasing_id().alias("query_id")), "references")

    @cached_property
    def impact_changes(self) -> DataFrame:
        """The changes that queries can meet, computed once for the column and the index join."""
        return written(self.changes.filter(F.col("object_kind").isin("column", "index")).select(
            "migration_id", "object_kind", "change_type", "table_name", "column_name", "index_name", "index_columns"), "changes")

    @cached_property
    def impacts(self) -> DataFrame:
        return querylog.match_impacts(self.impact_refs, self.impact_changes, self.migrations)

    @cached_property
    def impact_hits(self) -> DataFrame:
        """The impacts with ``query`` (its number in ``impact_refs``, its bytes and its database) in place of the text; written once."""
        refs = self.impact_refs
        database = F.col("db_id" if "db_id" in refs.columns else "log_id")
        told = F.struct("query_id", F.octet_length("query").alias("bytes"), database.alias("db"))
        return written(querylog.match_impacts(refs.withColumn("query", told), self.impact_changes, self.migrations), "impacts")

    @cached_property
    def impact_summary(self) -> DataFrame:
        return querylog.impact_summary(self.impact_refs, self.impact_changes, self.migrations)

    def shared(self, texts: bool = True) -> "Analysis":
        """The same analysis over operations that are extracted once and written to the shared folder.

        For outputs that read the operations in several branches (reports join
        scores, rollback, diff and impacts).  Locks, rollback and scores come from
        rule tables: working them out again for the columns that a branch reads
        takes less than writing them.  ``texts=False`` leaves the statements' text out.  This analysis itself stays as it is; one that
        is shared already is returned, with what it has written.
        """
        if self.__dict__.get("_is_shared"):
            return self
        found = self.extracted if texts else self.extracted.withColumn("raw_sql", F.lit(None).cast("string"))
        other = replace(self)
        other.__dict__.update(_is_shared=True, extracted=written(found, "operations"))
        return other

    def over(self, **stages: DataFrame) -> "Analysis":
        """This shared analysis with other rows of some stages."""
        other = replace(self)
        other.__dict__.update(_is_shared=True, **stages)
        return other

    def summary(self) -> DataFrame:
        """One row per migration: scores, rollback and diff counts (K6 header)."""
        return self.heads.join(self.diff_summary, "migration_id", "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(migration_id, overall_score, overall_level, n_ops, blocked) for every migration."""
    a = Analysis.from_tables(spark, sf_dir)
    return a.scores.select("migration_id", "overall_score", "overall_level", "n_ops", "blocked")

