"""Streamed query logs: impacts of pending migrations on newly arriving logs.

The analysed tool is batch only; its query-log stages (Q1-Q11) are
stateless per log file, so a log directory can be followed with Structured
Streaming and every micro-batch of new files is matched against the static
schema changes of the migrations under review (a stream-static join).  Each
file is a whole log, so per-file extraction and dedupe are exactly the batch
semantics.  Progress lives in the checkpoint folder that the caller names
(shared, and the same one on a restart, which then resumes where the query
stopped); each batch writes its own partition of the parquet table and
overwrites it when the batch is tried again, so no impact is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ddlscope.operators import querylog
from ddlscope.session import ensure_checkpoint_dir


def log_stream(spark: SparkSession, log_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """(log_id, chunk_id, text) rows for every new file in ``log_dir`` (one row per file)."""
    raw = (spark.readStream.format("text").option("wholetext", "true")
           .option("maxFilesPerTrigger", max_files_per_trigger).load(log_dir))
    return raw.select(F.col("_metadata.file_path").alias("log_id"), F.lit(0).cast("long").alias("chunk_id"),
                      F.regexp_replace("value", "�", "").alias("text"))


def start_impact_stream(spark: SparkSession, log_dir: str, changes: DataFrame, migrations: DataFrame,
                        out_path: str, checkpoint: str,
                        available_now: bool = False) -> StreamingQuery:
    """Follow ``log_dir`` and add impacts to the parquet table at ``out_path``.

    ``changes`` and ``migrations`` are static DataFrames (schema changes of
    the migrations under review and their ``db_id``); a log file's
    ``log_id`` is its path, and it is matched against every migration whose
    ``db_id`` equals the path's parent folder name.
    """
    ensure_checkpoint_dir(spark)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        logs = batch.withColumn("db_id", F.element_at(F.split("log_id", "/"), -2))
        refs = querylog.with_references(querylog.extract_queries(logs))
        m = migrations.select("migration_id", F.col("db_id").cast("string").alias("db_id"))
        # a folder for each batch, overwritten when a batch is tried again
        querylog.match_impacts(refs, changes, m).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    writer = (log_stream(spark, log_dir).writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
