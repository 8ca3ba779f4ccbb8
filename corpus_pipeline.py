"""Corpus pipeline over ``documents``: filter, deduplicate at three grains, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared checkpoint folder as Parquet and the next one
reads it, so a lost executor costs one stage's tasks at most.  All stages but the
last return the columns of ``documents``; where a text changes, ``n_chars`` follows.
Null texts stay null and are kept; a document that loses all its text stays as an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import line_dedup, minhash, packing, suffix_dedup, tables, toxicity

#: Near duplicates: words of a shingle, least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Repeated passages: bytes of a repeated string (about 35 words) and of its anchor.
REPEAT, GRAM = 200, 32


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by ``labels``, doesn't take for toxic."""
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return tables.outer(toxicity.scored(tables.inner(docs), model).filter(F.col("score") < toxicity.THRESHOLD), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one document only."""
    found = line_dedup.with_kept_lines(tables.inner(docs), line_dedup.MIN_CHARS, line_dedup.MIN_DOCS)
    text = F.when(F.col("text").isNotNull(), F.array_join("kept_lines", "\n"))
    return tables.outer(found.withColumn("text", text), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, of rows that repeat it the one with the smallest text.

    Each row is a node of its own, also where a doc_id stands for several texts; a null doc_id is linked with nothing.
    """
    # written, so that a row has the same number wherever it is read again
    rows = tables.written(tables.inner(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    named = rows.filter(F.col("doc_id").isNotNull())
    found = minhash.near_duplicates(named.select(F.col("row").alias("doc_id"), "text"), SHINGLE, PERCENT, unique_ids=True)
    groups = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    nodes = tables.written(groups.join(named.select("row", "doc_id"), "row"), "nodes")
    of_id = nodes.groupBy("component", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    first = tables.written(of_id.groupBy("component").agg(F.min(F.struct("doc_id", "row", "n")).alias("first")).select("component", "first.*"), "firsts")
    # only where the smallest doc_id of a group is repeated in it are texts compared; the rows are shuffled once for both
    alone = rows.join(first.filter("n = 1").select("row", "component"), "row").select("doc_id", "text", "others")
    tied = rows.join(nodes.join(first.filter("n > 1").select("component", "doc_id"), ["component", "doc_id"]).select("row", "component"), "row")
    smallest = tied.groupBy("component").agg(F.min_by(F.struct("doc_id", "text", "others"), F.struct("text", "row")).alias("least")).select("least.*")
    return tables.outer(alone.union(smallest).union(rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", "others")), docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once."""
    return suffix_dedup.remove_repeats(docs, REPEAT, GRAM)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bin, the bin's length and its place there."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the suffix arrays or the packing; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
