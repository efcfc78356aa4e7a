"""Edges as tables: both directions, degrees, totals, similarity weights.

``edges(u, v, weight)`` has one row an input line; ``adjacency(src, dst, weight)`` has two.
A self-loop has two rows as well, so it counts twice in its node's degree. Parallel edges
stay and add up. A null weight counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import kernels as K
from graphloom.model import Totals
from graphloom.operators.pairs import similar_links

#: Vectors up to which they travel with every adjacency row.
JOINED = 4_096


def symmetrize(edges: DataFrame) -> DataFrame:
    w = F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight")
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(both).alias("e"), w).select("e.src", "e.dst", "weight")  # edges are worked out once


def nodes_of(edges: DataFrame) -> DataFrame:
    """The node universe: endpoints of edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def weighted_degree(adjacency: DataFrame) -> DataFrame:
    """``(node, k)``; degrees are not weighted by similarity."""
    return adjacency.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))


def graph_total(adjacency: DataFrame) -> DataFrame:
    """One row, ``two_m``: the sum of all degrees, 1 if that is zero."""
    total = F.coalesce(F.sum("weight"), F.lit(0.0))
    return adjacency.agg(F.when(total == 0, F.lit(1.0)).otherwise(total).alias("two_m"))


def align_vectors(nodes: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``(node, z)`` for every node: zeros where it has no vector. Vectors of other nodes go."""
    if dim is None:
        first = vectors.filter("z is not null").select(F.size("z").alias("d")).first()
        if first is None:
            raise ValueError("there are no vectors, so their width is unknown")
        dim = first["d"]
    zeros = F.array_repeat(F.lit(0.0), dim)
    return nodes.join(vectors.select("node", "z"), "node", "left").select("node", F.when(F.size("z") == dim, F.col("z")).otherwise(zeros).alias("z"))


def reweight(adjacency: DataFrame, vectors: DataFrame, phi: str, mode: str = "kmeans") -> DataFrame:
    """``adjacency`` with ``sim`` (similarity of the endpoints) and ``w_uv`` (weight times
    similarity; the plain weight in mode nophi). Over ``JOINED`` vectors, of equal widths,
    links go to blocks of vectors; fewer are joined: two equi-joins on node."""
    w = F.col("weight") if mode == "nophi" else F.col("weight") * F.col("sim")
    if vectors.count() > JOINED:
        return similar_links(adjacency.select("src", "dst", "weight"), vectors, phi).withColumn("w_uv", w)
    sized = K.with_sizes(vectors.select("node", "z"), phi)
    side = lambda end, name: sized.select(F.col("node").alias(end), F.struct(*sized.columns[1:]).alias(name))
    joined = adjacency.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    out = joined.select("src", "dst", "weight", K.similarity_of(phi, F.col("a"), F.col("b")).alias("sim"))
    return out.withColumn("w_uv", w)


def weighted_totals(reweighted: DataFrame) -> DataFrame:
    """One row: ``two_m`` (1 if zero), ``two_m_w`` and ``g_average``, the plain mean of the
    similarity over all adjacency rows (1 without any)."""
    two_m = F.coalesce(F.sum("weight"), F.lit(0.0))
    return reweighted.agg(
        F.when(two_m == 0, F.lit(1.0)).otherwise(two_m).alias("two_m"),
        F.coalesce(F.sum("w_uv"), F.lit(0.0)).alias("two_m_w"),
        F.coalesce(F.avg("sim"), F.lit(1.0)).alias("g_average"),
    )


def totals(reweighted: DataFrame) -> Totals:
    return Totals(**weighted_totals(reweighted).first().asDict())


def simple_graph(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """``(u, v, len)`` with u < v: without self-loops, the last of parallel edges (by
    ``order``, a line number column) counts. ``edges`` has ``u, v, w_uv``."""
    order = F.lit(0) if order is None else order
    low, high = F.least("u", "v"), F.greatest("u", "v")
    proper = edges.filter("u <> v").select(low.alias("u"), high.alias("v"), K.edge_length(F.col("w_uv")).alias("len"), order.alias("line"))
    return proper.groupBy("u", "v").agg(F.max_by("len", F.struct("line", "len")).alias("len"))


def top_strength(reweighted: DataFrame, n: int) -> DataFrame:
    """The n nodes of largest similarity-weighted degree (ties by node)."""
    return reweighted.groupBy(F.col("src").alias("node")).agg(F.sum("w_uv").alias("strength")).orderBy(F.desc("strength"), "node").limit(n)
