"""Edge lists and vector files.

``u v [w]`` and ``node f1 ... fd``, separated by any white space, no header. Names are
strings. Line ends of either kind are accepted. Deliberately refused: pointer files that
stand for data stored elsewhere, and a vector file without a vector. Lines of white space
only are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.numbering import dense_number

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_POINTER = "version https://git-lfs"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, tokens)`` of every line that is not blank; ``line`` keeps the file's order."""
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    if not text.filter(F.col("value").startswith(_POINTER)).limit(1).isEmpty():
        raise ValueError(f"{path} points to data stored elsewhere; it holds none")
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    return text.select("line", trimmed.alias("t")).filter("t <> ''").select("line", F.split("t", r"\s+").alias("tokens"))


def _leading_number(token: Column) -> Column:
    """The number that a token starts with, null if it starts with none."""
    return F.regexp_extract(token, _NUMBER, 0).try_cast("double")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(line, u_name, v_name, weight)``; a missing or non-numeric weight is 1, a line of
    one name is an edge to the empty name, further columns are ignored. Repeated lines and
    self-loops stay."""
    rows = _lines(spark, path)
    token = lambda i: F.get("tokens", F.lit(i))
    return rows.select("line", token(0).alias("u_name"), F.coalesce(token(1), F.lit("")).alias("v_name"), F.coalesce(_leading_number(token(2)), F.lit(1.0)).alias("weight"))


def name_nodes(edges: DataFrame) -> DataFrame:
    """``(node, name)``: numbers from 0 in order of first appearance, u before v."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u_name").alias("name"), "line", F.lit(0).alias("side")), F.struct(F.col("v_name").alias("name"), "line", F.lit(1).alias("side")))))
    first = ends.groupBy("name").agg(F.min(F.struct("line", "side")).alias("first"))
    return dense_number(first, "first", name="node").select("node", "name")


def encode(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(line, u, v, weight)`` with node numbers."""
    side = lambda k: nodes.select(F.col("name").alias(f"{k}_name"), F.col("node").alias(k))
    return edges.join(side("u"), "u_name").join(side("v"), "v_name").select("line", "u", "v", "weight")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(name, z)``: the first row that is not empty sets the width; rows of another width
    go, a row ends at its first token that is no number, and of repeated names the last
    row counts."""
    rows = _lines(spark, path)
    numbers = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), _leading_number)
    bad = F.array_position(F.transform(numbers, lambda x: x.isNull()), F.lit(True))
    z = F.when(bad > 0, F.slice(numbers, 1, (bad - 1).cast("int"))).otherwise(numbers)
    parsed = rows.select("line", F.element_at("tokens", 1).alias("name"), z.alias("z"))
    first = parsed.select("line", F.size("z").alias("d")).agg(F.min_by("d", "line").alias("d")).first()["d"]
    if not first:
        raise ValueError(f"{path} has no vector, so their width is unknown")
    return parsed.filter(F.size("z") == first).groupBy("name").agg(F.max_by("z", "line").alias("z"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(name, label)`` of a file of known communities."""
    return _lines(spark, path).select(F.element_at("tokens", 1).alias("name"), F.get("tokens", F.lit(1)).try_cast("int").alias("label"))


def load_graph(spark: SparkSession, edges_path: str, vectors_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, vectors, nodes): encoded edges, vectors of the nodes that have one, names."""
    named = read_edges(spark, edges_path)
    nodes = name_nodes(named)
    vectors = read_vectors(spark, vectors_path).join(nodes, "name").select("node", "z")
    return encode(named, nodes), vectors, nodes
