"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every endpoint in ``edges(u, v)``; a component is named by
    its smallest node.

    Each round hangs the larger neighbours of every node on the smallest one around it,
    then the smaller ones. Rounds grow with the logarithm of the longest path. Minima are
    aggregated before each shuffle, each round is a table in the shared folder (the one before is
    deleted), and the driver sees one (count, checksum) row of it.
    """
    base = written(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "star")
    loops, cur = base.filter("a = b").select("a"), base.filter("a <> b")
    seen = _mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionAll(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        cur = written(small.filter("a <> b").distinct(), "star", instead_of=cur)
        before, seen = seen, _mark(cur)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).unionAll(loops.select(F.col("a").alias("node"))).distinct()
    hung = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    alone = roots.join(hung, "node", "left_anti")
    return hung.unionByName(alone.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
