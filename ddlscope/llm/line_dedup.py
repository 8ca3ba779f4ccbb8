"""Line dedup with DataFrame functions only.

Lines that many documents share are dropped from all but one of them.  Each
line has a key: the line without ASCII white space at its ends, A-Z in lower
case.  Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents lose all their lines except those in the document with
the largest id among their holders (its repeats of the line stay as well).

Plan: the digests of long keys are exploded with their places; documents are
counted per digest with map-side aggregation, so a line that a third of all
documents share costs one partial row per task.  The places to drop go back
to their texts through a join that adaptive execution may split, and each
text is taken apart and put together again by position inside its own row, in
time that grows as its lines: a very long text costs no more per line.

Defined results: a null or empty text is one empty line; rows that repeat a
doc_id are the same document when documents are counted, and each row is
returned; a null doc_id is one document, smaller than every other; other input
columns do not matter and may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables

MIN_CHARS, MIN_DOCS = 40, 5
#: Fixed value: the characters [\x20\x09-\x0D] that are stripped from both ends.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _digest(line: Column) -> Column:
    """16 bytes for a line's key."""
    return F.unhex(F.md5(line_key(line)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _print(text: Column) -> Column:
    """Names a text: rows of one doc_id may hold several."""
    return F.md5(F.coalesce(text, F.lit("")))


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, print, drop): per text the places of the lines that it loses."""
    long_key = F.transform(lines_of(F.col("text")), lambda x: F.when(F.length(F.btrim(x, F.lit(BLANKS))) >= min_chars, _digest(x)))
    # a generator first, so that the print of a text isn't taken again for each of its lines
    texts = docs.select(F.col("doc_id").alias("doc"), F.inline(F.array(F.struct(_print(F.col("text")).alias("print"), long_key.alias("keys")))))
    held = texts.select("doc", "print", F.posexplode("keys").alias("pos", "line")).filter(F.col("line").isNotNull())
    # rows that repeat a doc_id count once: distinct (line, doc) first, then documents per line
    many = (held.select("line", "doc").distinct().groupBy("line")
            .agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
            .filter(F.col("n_docs") >= min_docs).select("line", "keeper"))
    # written, so that the join is one of two tables and adaptive execution can split a frequent line
    many = tables.written(many, "shared-lines", docs.count())
    return (held.join(many, "line").filter(~F.col("doc").eqNullSafe(F.col("keeper")))
            .groupBy("doc", "print").agg(F.collect_set("pos").alias("drop")))


def with_kept_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``docs`` with a column kept_lines: the lines of each text that stay."""
    drops = shared_lines(docs, min_chars, min_docs).toDF("dropped_doc", "dropped_print", "dropped_lines")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("dropped_doc")) & (_print(F.col("text")) == F.col("dropped_print")), "left")
    # a generator, so that the text is split once and not for each line put back
    split = joined.withColumn("all_lines", F.explode(F.array(lines_of(F.col("text")))))
    lines, gone = F.col("all_lines"), F.col("dropped_lines")
    # places left by a set difference (hashed, in order), then the line at each: time in proportion to the lines
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    stays = F.transform(places, lambda p: F.get(lines, p))
    return split.withColumn("kept_lines", F.when(gone.isNull(), lines).otherwise(stays)).drop("dropped_doc", "dropped_print", "dropped_lines", "all_lines")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without its shared lines."""
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return (with_kept_lines(docs.select("doc_id", "text"), min_chars, min_docs)
            .select("doc_id", F.array_join("kept_lines", "\n").alias("text"), n_lines.alias("n_lines"),
                    (n_lines - F.size("kept_lines")).alias("n_dropped")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(tables.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPLIT_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), many AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
"""

ORACLE_SQL = _SPLIT_SQL + """
SELECT y.doc_id, count(*) AS n_lines, count(many.k) FILTER (WHERE many.keeper <> y.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(y.line, chr(10) ORDER BY y.pos)
              FILTER (WHERE many.k IS NULL OR many.keeper = y.doc_id), '')) AS kept_sha256
FROM keyed y LEFT JOIN many ON many.k = y.k
GROUP BY y.doc_id
"""
