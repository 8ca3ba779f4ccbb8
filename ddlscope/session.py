"""Spark session and run-time settings shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ddlscope") -> SparkSession:
    """Session for local runs and tests.

    On a cluster the session comes from the launcher; only the settings that
    matter for these jobs are set here (AQE with skew-join splitting and
    partition coalescing, UI off).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DDLSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JIT does not compile methods over 8 KB of bytecode; a whole-stage
        # method that large (the wide CASE projections of the classifier) runs
        # interpreted.  Past this limit Spark falls back to split expression code.
        .config("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as is.  Only when it
    is unset (local runs, tests) a scratch folder is created.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="ddlscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


#: Bytes of a method from which the JIT leaves it uncompiled.
METHOD_LIMIT = 8000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Sessions from a launcher have Spark's limit of 65,535 bytes: the wide CASE projections then run interpreted, at half the speed."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_LIMIT:
        spark.conf.set(name, str(METHOD_LIMIT))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_READS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Parquet table as a DataFrame; one relation per (session, path) is reused.

    Listing files and reading footers is driver work that every derived
    input would otherwise repeat; the DataFrame itself is lazy.
    """
    key = (spark.sparkContext.applicationId, table_path(sf_dir, name))
    if key not in _READS:
        _READS[key] = spark.read.parquet(table_path(sf_dir, name))
    return _READS[key]


#: Rows of a lookup that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df):
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, which is counted first (to the limit only)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def written(df, name: str):
    """``df`` as a Parquet table in the shared checkpoint folder: what reads it several times computes it once.

    Shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ddlscope-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files at their end; else these stay until the driver's JVM collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
