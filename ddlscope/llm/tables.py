"""Reading the input tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.session import ensure_checkpoint_dir, shuffles_freed, table_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


#: Rows of a narrow table that make one file.
ROWS_PER_FILE = 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    Cuts the lineage: what follows restarts from the table when an executor
    is lost, and a result that several branches read is computed once.  Where the
    number of rows is known within a factor, a table gets no more files than it
    needs; ``rows`` may be given larger, for rows that are wide or dear to make.
    Shuffle files behind the table go as soon as it is written.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def inner(docs: DataFrame) -> DataFrame:
    """(doc_id, text, others): other columns of any name, put together so that none can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_row"), *others).alias("others"))


def outer(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again from ``inner`` ones; ``n_chars`` is counted anew from the text."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return found.select(*(F.col(c) if c in ("doc_id", "text") else n_chars.alias(c) if c == "n_chars" else F.col(f"others.`{c}`").alias(c)
                          for c in docs.columns))
