"""Community statistics, moves and contraction.

Tables: ``adjacency(src, dst, w_uv)``, ``partition(node, community)`` and
``stats(node, sum_z, sum_k, cnt)``, one row a (super-)node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import kernels as K
from graphloom.model import Objective
from graphloom.operators.numbering import dense_number


def node_stats(degrees: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Statistics of single nodes; without vectors where g is constant."""
    if vectors is None:
        return degrees.select("node", F.lit(None).cast("array<double>").alias("sum_z"), F.col("k").alias("sum_k"), F.lit(1).cast("long").alias("cnt"))
    return degrees.join(vectors, "node").select("node", F.col("z").alias("sum_z"), F.col("k").alias("sum_k"), F.lit(1).cast("long").alias("cnt"))


def community_stats(stats: DataFrame, partition: DataFrame) -> DataFrame:
    """``(community, sum_z, sum_k, cnt)``. Vectors are summed by position, so the shuffle
    carries one partial sum for each position and community of a task."""
    member = stats.join(partition, "node")
    scalars = member.groupBy("community").agg(F.sum("sum_k").alias("sum_k"), F.sum("cnt").alias("cnt"))
    parts = member.select("community", F.posexplode("sum_z").alias("pos", "x")).groupBy("community", "pos").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sum_z"))
    return scalars.join(sums, "community", "left").select("community", "sum_z", "sum_k", "cnt")


def node_community_weight(adjacency: DataFrame, partition: DataFrame) -> DataFrame:
    """``(node, community, w)``: weight from each node to each community around it, its
    own included."""
    there = partition.select(F.col("node").alias("dst"), "community")
    return adjacency.join(there, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w_uv").alias("w"))


def _expected(objective: Objective, k: Column, sum_k: Column, n: Column, count: Column, distance: Column) -> Column:
    g = K.g_interp(distance, objective.anchors) if objective.constant_g is None else F.lit(objective.constant_g)
    if objective.by_degree:
        return F.lit(objective.gamma / objective.totals.two_m) * k * sum_k * g
    return F.lit(objective.gamma) * n * count * g


def penalty_join(objective: Objective, node: str = "n", comm: str = "c") -> Column:
    """Expected weight between a node and a community it is not in (structs with the
    columns of ``stats``)."""
    f = lambda s, x: F.col(f"{s}.{x}")
    d = K.vec_dist(K.centroid(f(node, "sum_z"), f(node, "cnt")), K.centroid(f(comm, "sum_z"), f(comm, "cnt")))
    return F.when(f(comm, "cnt") <= 0, F.lit(0.0)).otherwise(_expected(objective, f(node, "sum_k"), f(comm, "sum_k"), f(node, "cnt"), f(comm, "cnt"), d))


def penalty_exclude(objective: Objective, node: str = "n", comm: str = "c") -> Column:
    """Expected weight between a node and the rest of its own community; 0 if it is alone."""
    f = lambda s, x: F.col(f"{s}.{x}")
    rest = f(comm, "cnt") - f(node, "cnt")
    d = K.vec_dist(K.centroid(f(node, "sum_z"), f(node, "cnt")), K.centroid_without(f(comm, "sum_z"), f(comm, "cnt"), f(node, "sum_z"), f(node, "cnt")))
    return F.when(rest <= 0, F.lit(0.0)).otherwise(_expected(objective, f(node, "sum_k"), f(comm, "sum_k") - f(node, "sum_k"), f(node, "cnt"), rest, d))


def moves(adjacency: DataFrame, partition: DataFrame, stats: DataFrame, objective: Objective, comms: DataFrame | None = None) -> DataFrame:
    """``(node, own, community, gain, stay)`` for each node and each community around it:
    weight to the community less the expected weight; ``stay`` is the gain of staying."""
    comms = community_stats(stats, partition) if comms is None else comms
    row = lambda df, key, name: df.select(F.col(key).alias(f"__{name}"), F.struct("sum_z", "sum_k", "cnt").alias(name))
    n, c, o = row(stats, "node", "n"), row(comms, "community", "c"), row(comms, "community", "o")
    own = partition.select("node", F.col("community").alias("own"))
    weights = node_community_weight(adjacency, partition)
    to_own = weights.join(own, "node").filter(F.col("community") == F.col("own")).select("node", F.col("w").alias("w_own"))
    staying = own.join(n, F.col("node") == F.col("__n")).join(o, F.col("own") == F.col("__o")).join(to_own, "node", "left")
    staying = staying.select("node", "own", "n", (F.coalesce("w_own", F.lit(0.0)) - penalty_exclude(objective, "n", "o")).alias("stay"))
    return (
        weights.join(staying, "node").filter(F.col("community") != F.col("own")).join(c, F.col("community") == F.col("__c"))
        .select("node", "own", "community", (F.col("w") - penalty_join(objective)).alias("gain"), "stay")
    )


def best_moves(candidates: DataFrame) -> DataFrame:
    """``(node, own, community, gain, stay)``: the best candidate of each node that gains
    strictly more than staying; of equal gains the smallest community."""
    best = F.max_by(F.struct("own", "community", "gain", "stay"), F.struct("gain", -F.col("community")))
    return candidates.filter("gain > stay").groupBy("node").agg(best.alias("m")).select("node", "m.*")


def contract(adjacency: DataFrame, partition: DataFrame) -> DataFrame:
    """``(src, dst, w_uv)`` between communities, both directions: what lies inside a
    community goes, both directions are summed and halved."""
    a = partition.select(F.col("node").alias("src"), F.col("community").alias("cu"))
    b = partition.select(F.col("node").alias("dst"), F.col("community").alias("cv"))
    between = adjacency.join(a, "src").join(b, "dst").filter("cu <> cv")
    half = between.groupBy(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst")).agg((F.sum("w_uv") / 2).alias("w_uv"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w_uv"))


def supernode_stats(stats: DataFrame, partition: DataFrame) -> DataFrame:
    """Statistics of communities as nodes of the next level."""
    return community_stats(stats, partition).withColumnRenamed("community", "node")


def compose(labels: DataFrame, level: DataFrame) -> DataFrame:
    """``labels(node, community)`` with each community replaced by its own in ``level``."""
    up = level.select(F.col("node").alias("community"), F.col("community").alias("up"))
    return labels.join(up, "community").select("node", F.col("up").alias("community"))


def rank_edges(edges: DataFrame, bet: str = "bet") -> DataFrame:
    """Edges in order of betweenness, largest first, with ``rank`` from 1; ties by (u, v)."""
    return dense_number(edges, F.desc(bet), "u", "v", name="rank").withColumn("rank", F.col("rank") + 1)
