"""Graphs made from the star-schema and embedding tables, for queries and benchmarks.

========  ==================================================================
``G5``    the union of each vector's 10 nearest (cosine, then id) among those
          of the same ``vec_id % 5``, weight 1
``T35``   vectors with cosine 0.35 or more, weight 1; ``T40`` likewise
``K10``   as G5, among all vectors
``SUP``   suppliers of one order, weight the number of orders they share
========  ==================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.pairs import cosine_over, nearest
from graphloom.storage import table

NEIGHBOURS = 10


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, z)``: vectors in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("z"))


def threshold_graph(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """``(u, v, weight)`` of T35 or T40."""
    return cosine_over(embeddings(spark, sf_dir), least).select("u", "v", F.lit(1.0).alias("weight"))


def neighbour_graph(spark: SparkSession, sf_dir: str, groups: int | None = 5) -> DataFrame:
    """``(u, v, weight)`` of G5 (``groups`` 5) or K10 (None)."""
    vectors = embeddings(spark, sf_dir)
    if groups:
        vectors = vectors.withColumn("part", F.col("node") % groups)
    near = nearest(vectors, NEIGHBOURS, "part" if groups else None)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS)
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("weight", F.lit(1.0))


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(u, v, weight)`` of SUP."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    other = rows.select("l_orderkey", F.col("l_suppkey").alias("v"))
    return rows.withColumnRenamed("l_suppkey", "u").join(other, "l_orderkey").filter("u < v").groupBy("u", "v").agg(F.count("*").cast("double").alias("weight"))
