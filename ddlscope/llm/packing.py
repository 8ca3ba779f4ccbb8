"""Best-fit packing of documents into sequences of several permitted lengths.

A document of n bytes has n byte-level tokens and an end token; what exceeds the
longest permitted length is cut into pieces of that length, so a piece always
fits.  Pieces are dealt out by a hash and handled in rounds of ROUND pieces, in
the order of the hash.  A round packs its pieces from the largest down: a piece
goes into the open bin that it leaves the least room in; where none has room, a
bin opens in the permitted length of least cost, which is the length's price less
the value of the room that the pieces still to come can fill, at the lowest price
a token of any length.  At the end every bin takes the shortest permitted length
that holds its contents.

The price of a length L is L + L * L / DENSE + EACH: tokens, attention over the
whole sequence, and a fixed part for each sequence.

Only lengths move between tasks, never texts; a round bounds a task's memory,
and rows that repeat one id only make more rounds in one task.

Defined results: null text counts as empty (one token); rows that repeat a doc_id
are packed one by one and can't be told apart in the result; a null doc_id stays
null; no documents give no rows; other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables

LENGTHS = (2048, 4096, 8192, 16384, 32768)
DENSE, EACH = 65536, 256
ROUND = 1 << 15


def price(length: int) -> float:
    return length + length * length / DENSE + EACH


def opened(size: int, rest: int, lengths: Sequence[int]) -> int:
    """The permitted length to open for a piece, with ``rest`` tokens still to come; ties go to the shorter."""
    value = min(price(n) / n for n in lengths)
    return min((n for n in lengths if n >= size), key=lambda n: (price(n) - value * min(n - size, rest), n))


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its place in the bin, length of each bin); sizes in any order, ties by position."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rest = sum(sizes)
    which, at = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in order:
        size = sizes[i]
        rest -= size
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            b = len(used)
            used.append(0)
            left = opened(size, rest, lengths)
        which[i], at[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return which, at, [lengths[bisect_left(lengths, n)] for n in used]


def _rows(lengths: tuple[int, ...], most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for table in _rounds(batches, most):
            which, at, length = pack(table.column("n_tokens").to_pylist(), lengths)
            first = part << 40 | number << 16
            number += 1
            out = pa.table([*table.columns, pa.array([first + b for b in which], pa.int64()),
                            pa.array([length[b] for b in which], pa.int32()), pa.array(at, pa.int32())],
                           names=[*table.column_names, "bin_id", "bin_length", "at"])
            yield from out.to_batches()
    return rows


def _rounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, most - n)
            held.append(some)
            n += some.num_rows
            batch = batch.slice(some.num_rows)
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, most: int = ROUND) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_length, at): each piece of a document and its place in a bin.

    ``start`` is the piece's first token in its document, ``at`` its first in the bin.
    """
    longest = max(lengths)
    tokens = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    pieces = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n"))
              .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))).alias("piece"))
              .select("doc_id", "piece", (F.col("piece") * longest).alias("start"),
                      F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).cast("int").alias("n_tokens")))
    n = tables.shuffle_partitions(docs.sparkSession)
    dealt = pieces.withColumn("key", F.xxhash64("doc_id", "piece", "n_tokens")).repartition(n, "key").sortWithinPartitions("key", "doc_id", "piece")
    return dealt.drop("key").mapInArrow(
        _rows(tuple(lengths), most), "doc_id long, piece long, start long, n_tokens int, bin_id long, bin_length int, at int")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(tables.documents(spark, sf_dir).select("doc_id", "text"))
