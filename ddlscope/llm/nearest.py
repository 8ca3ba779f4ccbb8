"""Nearest vectors by a block matrix join over int8 products with error bounds.

Queries and candidates are dealt into blocks by a hash of their id; each pair of
a query block and a candidate block is one tile, settled by one task:

* every vector v is stored as a scale times an int8 vector plus a residual r;
  the tile's int8 products (exact in float arithmetic) give each inner product
  up to |q|*|r_c| + |r_q|*|scale_c * int8_c| (Cauchy-Schwarz);
* a candidate whose upper bound lies below the k-th largest lower bound of its
  query in the tile can't be among the k nearest and is dropped;
* the survivors' products are recomputed in double precision, added in the order
  of the components, and the k best of the tile are kept in a heap.

The tiles' heaps of a query are merged by rank.  Nothing is lost by the bounds,
so the result is exact.  A tile holds two blocks at most, whatever the input.

Defined results: vectors that are null, all zero, empty, or hold null or
non-finite components take no part, nor does a null vec_id; rows that repeat id
and vector count once, different vectors of one id are rows of their own: each is
a candidate, and a query where its id says so, and a query's list names an id once,
with its best score; ties go to the smaller vec_id; a query meets all other rows of
its own length.  Where bounds overflow (components around 1e150) nothing is dropped
by them.  An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ddlscope.llm import tables

BLOCK_ROWS = 4096
FOUND = "query_row long, query_id long, vec_id long, score double"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the residuals); the residual norm is rounded up a little."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(v / scale[:, None]).astype(np.int8)
    residual = np.linalg.norm(v - q * scale[:, None], axis=1)
    return q, scale, residual * (1 + 1e-9) + 1e-300


def tile(query_row: np.ndarray, queries: np.ndarray, row: np.ndarray, vec_id: np.ndarray, vectors: np.ndarray, k: int):
    """(place of the query, vec_id, score) of each query's k nearest ids in the tile, its own row left out."""
    by_id = np.argsort(vec_id, kind="stable")
    row, vec_id, vectors = row[by_id], vec_id[by_id], vectors[by_id]
    first = np.flatnonzero(np.concatenate([[True], vec_id[1:] != vec_id[:-1]]))  # of the rows of each id
    q8, q_scale, q_rest = quantised(queries)
    c8, c_scale, c_rest = quantised(vectors)
    q_norm = np.linalg.norm(queries, axis=1)
    c_part = np.linalg.norm(c8 * c_scale[:, None], axis=1)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    by_component = np.ascontiguousarray(vectors.T)
    found = []
    for at in range(0, len(queries), 256):
        rows = slice(at, at + 256)
        rough = (q8[rows].astype(exact) @ c8.astype(exact).T).astype(np.float64) * q_scale[rows, None] * c_scale
        error = q_norm[rows, None] * c_rest + q_rest[rows, None] * c_part
        error = error * (1 + 1e-9) + 1e-12 * (1 + np.abs(rough))
        own = row[None, :] == query_row[rows, None]
        sure = np.isfinite(rough) & np.isfinite(error)  # a bound that overflows drops nothing
        low = np.where(own | ~sure, -np.inf, rough - error)
        if len(first) > k:
            of_id = np.maximum.reduceat(low, first, axis=1)
            least = np.partition(of_id, len(first) - k, axis=1)[:, len(first) - k]
        else:
            least = np.full(len(low), -np.inf)
        alive = (~sure | (rough + error >= least[:, None])) & ~own
        for i in range(len(low)):
            some = np.flatnonzero(alive[i])
            # accumulate adds in the order of the components, so that a pair's score is alike in every tile
            score = np.add.accumulate(by_component[:, some] * queries[at + i][:, None], axis=0)[-1]
            if not len(some):
                continue
            start = np.flatnonzero(np.concatenate([[True], vec_id[some][1:] != vec_id[some][:-1]]))
            score = np.maximum.reduceat(score, start)
            best = heapq.nsmallest(k, zip((-score).tolist(), vec_id[some][start].tolist()))
            found.extend((at + i, v, -s) for s, v in best)
    return found


def _settle(k: int):
    def settle(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and vectors.num_rows:
            q, v = (_matrix(x.column("embedding")) for x in (queries, vectors))
            rows, ids = ([x.column(c).to_numpy() for x in (queries, vectors)] for c in ("row", "vec_id"))
            found = [(rows[0][i], ids[0][i], c, s) for i, c, s in tile(rows[0], q, rows[1], ids[1], v, k)]
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())],
                        names=["query_row", "query_id", "vec_id", "score"])
    return settle


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding): only vectors that take part, repeated rows once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite).filter(some)
    return rows.distinct()


def nearest(embeddings: DataFrame, is_query, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other vectors."""
    # written, so that a row keeps its number
    vectors = tables.written(usable(embeddings).withColumn("length", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = vectors.filter(is_query)
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks, query_blocks = (max(1, -(-n // block_rows)) for n in (n_vectors, n_queries))

    def dealt(df, own, own_n, other, other_n):
        return (df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)).cast("array<long>"))))

    # dealt by row: a third of all rows with one vector or one id is spread over all blocks
    q = dealt(queries, "qb", query_blocks, "vb", blocks)
    v = dealt(vectors, "vb", blocks, "qb", query_blocks)
    keys = ["length", "qb", "vb"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_settle(k), FOUND)
    # rows of one id may lie in several tiles
    found = found.groupBy("query_row", "query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(tables.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, e FROM (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e)) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 GROUP BY q.r, q.vec_id, c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""
