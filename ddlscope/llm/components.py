"""Connected components of an edge table by alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then every node's smaller neighbours and itself at the smallest
of them (small star); chains halve, so a logarithmic number of rounds ends with
one star per component around its smallest node.  Neighbourhoods are never
gathered: a round is minimum aggregation plus joins, which adaptive execution
splits for a node with very many neighbours.  Every round is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ddlscope.llm import tables


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "component", rows: int | None = None) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (two columns of ids, none null); component: its smallest node.

    ``rows``: a bound on the number of edges, if known.  Loops and repeated edges are allowed; nodes without a link to another have no row.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = tables.written(edges, name, rows)
    before = _print(edges)
    while before[0]:
        edges = tables.written(_small_star(_large_star(edges).distinct()), name, before[0])
        now = _print(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return edges.union(roots).toDF("node", "component")
