"""File sources and sinks: scripts, query logs, schema dumps.

Each reader returns one row per file with the whole text (``wholetext``),
the path from ``_metadata.file_path`` and the base name.  A missing path
raises ``AnalysisException`` as the tool raises on a missing file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.functions.text import basename


def infer_dialect(name: Column, scope: str = "name") -> Column:
    """First dialect hint found in the lower-cased name (``scope='name'``:
    base name, as the extraction does; ``scope='path'``: whole path)."""
    s = F.lower(basename(name) if scope == "name" else name)
    expr = None
    for hint, dialect in fixed.DIALECT_BY_NAME:
        expr = F.when(s.contains(hint), F.lit(dialect)) if expr is None else expr.when(s.contains(hint), F.lit(dialect))
    return expr.otherwise(F.lit(fixed.DEFAULT_DIALECT))


def is_migration_file(name: Column) -> Column:
    """S3: base name contains one of the migration hints."""
    s = F.lower(basename(name))
    out = F.lit(False)
    for hint in fixed.MIGRATION_NAME_HINTS:
        out = out | s.contains(hint)
    return out


def _read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_scripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(migration_id, path, file_name, dialect, text) — one row per script file."""
    df = _read_whole(spark, paths)
    return df.select(
        F.col("path").alias("migration_id"), "path", basename(F.col("path")).alias("file_name"),
        infer_dialect(F.col("path")).alias("dialect"), "text",
    )


def read_query_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(log_id, chunk_id, text) — one chunk per log file.

    Java decoding turns invalid UTF-8 into U+FFFD; the tool drops such bytes,
    so the replacement character is removed.
    """
    df = _read_whole(spark, paths)
    return df.select(F.col("path").alias("log_id"), F.xxhash64("path").alias("chunk_id"),
                     F.regexp_replace("text", "�", "").alias("text"))


def read_schema_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(schema_id, text) — one row per schema dump file."""
    df = _read_whole(spark, paths)
    return df.select(F.col("path").alias("schema_id"), "text")
