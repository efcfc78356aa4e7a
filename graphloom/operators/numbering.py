"""Dense numbers 0..n-1 in a given order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import partitions, written

_ROW_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def dense_number(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with the rank of each row, from 0, as ``name``.

    Rows are range-partitioned by ``order`` and sorted inside partitions; partition sizes
    are summed up (one row a partition) to give each partition its first number."""
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part = F.shiftright("__id", _ROW_BITS)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, size in sizes:
        starts += [F.lit(p).cast("long"), F.lit(at).cast("long")]
        at += size
    if not starts:
        return placed.drop("__id").withColumn(name, F.lit(None).cast("long"))
    start = F.element_at(F.create_map(*starts), part)  # one entry a partition
    row = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, (start + row).cast("long")).drop("__id")


def renumber(partition: DataFrame, column: str = "community") -> DataFrame:
    """``partition`` with its labels replaced by 0..c-1 in ascending order of the old ones."""
    labels = dense_number(partition.select(F.col(column).alias("__old")).distinct(), "__old", name="__new")
    return partition.join(labels, partition[column] == labels["__old"]).drop("__old", column).withColumnRenamed("__new", column)
