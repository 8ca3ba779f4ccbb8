"""Clustering of integer vectors with a vantage-point tree over the centroids.

Components become integers, floor(scale * x), so that distances, sums and centroids
are exact and do not depend on the order in which tasks end.  Each round

1. builds a vantage-point tree over the centroids on the driver and broadcasts it
   (as many rows as there are clusters, a parameter);
2. searches it for every vector, nearest subtree first: a node is entered if the
   least distance possible there is not greater than the best one found.  The bound
   is inclusive, so an equally near centroid is met and the smaller number wins;
   it is computed in floating point and lowered by more than its error, while every
   distance that is compared or returned is an exact integer;
3. adds up the vectors of each cluster inside its task, then over tasks in Spark.

A portion of vectors is searched together; each keeps a frontier of its own, and
vectors that enter the same node in the same step share one subtraction.  Sums
travel as 32-bit limbs, so they can't overflow, whatever the rows or their size.
A third of all rows alike only adds to a sum inside its tasks.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part.  Start centroids are the vectors with the
least sha256 of "<salt>:<vec_id>", equal hashes (repeated ids) by the smallest
vector; vectors with a null vec_id take part but start no centroid unless there are
too few others.  Every row counts, repeated ones too.  Fewer vectors than clusters:
as many clusters as vectors; none: an empty result.  A distance or inertia that is
too large for a long is null, its cluster is right all the same.  Other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables

SCALE, LENGTH, CLUSTERS, ROUNDS, SALT = 1024, 64, 8, 10, "3"
#: Centroids of a leaf at the most.
LEAF = 2
#: Components that a tree may hold: what is broadcast each round is no more than 64 MB.
TREE_COMPONENTS = 8 << 20
LIMB = 32


def usable(embeddings: DataFrame, length: int = LENGTH) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter((F.size("v") == length) & finite)


def plain_below(length: int) -> int:
    """Integers under this size can be subtracted, squared and added up in 64 bits; a portion with larger ones goes by Python's integers."""
    return math.isqrt((1 << 60) // max(1, length))


def integers(column: pa.ChunkedArray | pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) row by row, as 64-bit integers or, where one is too large for them to be multiplied, as Python's."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    if not x.size or np.abs(x).max() * scale + 1 < plain_below(length):
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    for i, value in enumerate(x.flat):
        top, bottom = float(value).as_integer_ratio()
        out.flat[i] = top * scale // bottom
    return out


def build_tree(centroids: list[list[int]], leaf: int = LEAF) -> dict:
    """Flat arrays: node i holds centroids ``member[first[i]:first[i] + n[i]]``, of which the first is its vantage point if it has children.

    A child is entered through ``near`` or ``far``; ``low`` and ``high`` are the least and
    greatest distance of the child's centroids from the vantage point of its parent.
    """
    points = [tuple(c) for c in centroids]
    member, first, n, near, far, low, high = [], [], [], [], [], [], []

    def squared(a: int, b: int) -> int:
        return sum((x - y) ** 2 for x, y in zip(points[a], points[b]))

    def node(some: list[int], bounds: tuple[float, float]) -> int:
        i = len(first)
        first.append(len(member))
        low.append(bounds[0])
        high.append(bounds[1])
        near.append(-1)
        far.append(-1)
        if len(some) <= leaf:
            n.append(len(some))
            member.extend(some)
            return i
        # the vantage point is the one furthest from the first: a corner of the set
        vantage = max(some, key=lambda c: (squared(some[0], c), -c))
        rest = sorted((squared(vantage, c), c) for c in some if c != vantage)
        n.append(1)
        member.append(vantage)
        half = len(rest) // 2
        for part, child in ((rest[:half], near), (rest[half:], far)):
            if part:
                child[i] = node([c for _, c in part], (_root(part[0][0]), _root(part[-1][0])))
        return i

    if points:
        node(list(range(len(points))), (0.0, 0.0))
    plain = all(abs(x) < plain_below(len(p)) for p in points for x in p)
    table = np.array(points, np.int64 if plain else object) if points else np.zeros((0, 0), np.int64)
    return {"points": table, "member": member, "first": first, "n": n, "near": near, "far": far, "low": low, "high": high}


def _root(squared: int) -> float:
    try:
        return float(squared) ** 0.5
    except OverflowError:
        return float("inf")


def search(tree: dict, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of every row of ``v``, ties to the smaller number."""
    plain = v.dtype != object and tree["points"].dtype != object
    points = tree["points"] if plain else tree["points"].astype(object)
    v = v if plain else v.astype(object)
    best = np.full(len(v), np.iinfo(np.int64).max, np.int64) if plain else np.full(len(v), None, object)
    number = np.full(len(v), len(points), np.int64)
    # the frontier of each row: nodes not entered yet and the least distance possible there
    rows = np.arange(len(v))
    node = np.zeros((len(v), 1), np.int64)
    bound = np.zeros((len(v), 1))
    while len(rows):
        pick = bound.argmin(axis=1)
        here = np.arange(len(rows))
        at, least = node[here, pick], bound[here, pick]
        if plain:
            go = least * least <= best[rows]  # inclusive; a row without a node left has an infinite bound
        else:  # too large for floating-point bounds: every node is entered
            go = np.isfinite(least)
        rows, node, bound, pick, at, least = (x[go] for x in (rows, node, bound, pick, at, least))
        here = np.arange(len(rows))
        bound[here, pick] = np.inf
        node = np.pad(node, ((0, 0), (0, 1)))
        bound = np.pad(bound, ((0, 0), (0, 1)), constant_values=np.inf)
        for i in np.unique(at):
            which = np.flatnonzero(at == i)
            some = rows[which]
            for c in tree["member"][tree["first"][i]:tree["first"][i] + tree["n"][i]]:
                d = ((v[some] - points[c]) ** 2).sum(axis=1)
                better = np.array([b is None or (x, c) < (b, k) for x, b, k in zip(d, best[some], number[some])], bool) if not plain else (
                    (d < best[some]) | (d == best[some]) & (c < number[some]))
                best[some[better]], number[some[better]] = d[better], c
            root = np.sqrt(d.astype(np.float64)) if plain else np.zeros(len(some))  # of a node with children: the distance from its vantage point
            for child, column in ((tree["near"][i], pick[which]), (tree["far"][i], np.full(len(which), bound.shape[1] - 1))):
                if child >= 0:
                    low, high = tree["low"][child], tree["high"][child]
                    away = np.maximum(low - root, root - high) - 1e-9 * (1 + root + high) if plain else root
                    node[which, column] = child
                    bound[which, column] = np.maximum(least[which], np.maximum(away, 0))
    return number, best


def _portions(batches: Iterator[pa.RecordBatch], length: int, scale: int, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield some.column("vec_id"), integers(some.column("v"), length, scale)


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _summing(tree, length: int, scale: int):
    """Per task: the sums of the vectors of each cluster by component and limb; component -1 is their number."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sums = tree.value, {}
        for _, v in _portions(batches, length, scale):
            number, _ = search(t, v)
            for c in np.unique(number).tolist():
                some = v[number == c]
                held = sums.setdefault(c, [0] * (length + 1))
                for j, x in enumerate([*some.sum(axis=0).tolist(), len(some)]):
                    held[j] += x
        out = [(c, j if j < length else -1, k, x) for c, held in sums.items() for j, s in enumerate(held) for k, x in enumerate(_limbs(s))]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                                          pa.array(columns[3], pa.int64())], ["cluster", "component", "limb", "value"])
    return rows


def _naming(tree, length: int, scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for ids, v in _portions(batches, length, scale):
            number, squared = search(t, v)
            distance = pa.array([x if x < 1 << 63 else None for x in squared.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), distance], ["vec_id", "cluster", "distance"])
    return rows


def start_centroids(vectors: DataFrame, clusters: int, salt: str, scale: int) -> list[list[int]]:
    """The vectors of the smallest hashes, a bounded number."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return [[_floor(x, scale) for x in r.v] for r in rows]


def _floor(x: float, scale: int) -> int:
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


def next_centroids(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Every centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    length = len(centroids[0])
    tree = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    parts = vectors.mapInArrow(_summing(tree, length, scale), "cluster int, component int, limb int, value long")
    sums = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():  # clusters x components
        key = r.cluster, r.component
        sums[key] = sums.get(key, 0) + (r.value << (LIMB * r.limb))
    tree.unpersist()
    return [[sums.get((c, j), 0) // sums[c, -1] for j in range(length)] if (c, -1) in sums else old for c, old in enumerate(centroids)]


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, scale: int = SCALE,
              length: int = LENGTH) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector after the last round, the centroids)."""
    if clusters * length > TREE_COMPONENTS:
        raise ValueError(f"clusters x components is more than {TREE_COMPONENTS}, too much for one tree")
    vectors = usable(embeddings, length)
    centroids = start_centroids(vectors, clusters, salt, scale)
    if centroids:
        for _ in range(rounds):
            centroids = next_centroids(vectors, centroids, scale)
    tree = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    return vectors.mapInArrow(_naming(tree, length, scale), "vec_id long, cluster int, distance long"), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(tables.table(spark, sf_dir, "embeddings"))
    found = tables.written(found, "clusters")
    # a row for each cluster, as many as the parameter says; null if one of its distances is
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.total for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    total = None if None in per.values() else sum(map(int, per.values()))

    def as_long(x):
        return None if x is None or x >= 1 << 63 else int(x)

    rows = [(c, as_long(x), as_long(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in per.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(rounds: int = ROUNDS, clusters: int = CLUSTERS) -> str:
    """DuckDB SQL for the rows of the query: every distance of every round."""
    floor = "(s - ((s % n) + n) % n) // n"
    parts = [f"""
v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id::VARCHAR), e) - 1)::INTEGER AS cluster, e FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id::VARCHAR), e) <= {clusters}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT v.r, v.vec_id, v.e, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance
  FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY distance, c.cluster) = 1
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT cluster, list(({floor})::BIGINT ORDER BY j) AS e FROM (
      SELECT cluster, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
      FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster
  ) m ON m.cluster = c.cluster
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE_SQL = oracle_sql()
