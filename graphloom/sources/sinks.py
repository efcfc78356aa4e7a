"""Partitions and run logs on disk.

A run's folder is named by its parameters, its number is claimed by creating a file that
must not exist, so runs that start together do not share one, and the log gets one row a
run under a fixed header.
"""

from __future__ import annotations

import csv
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Config

#: Columns of the run log; fixed values.
LOG_COLUMNS = ("Dataset", "Algorithm", "Phi", "Gamma", "Sampling", "Bin_Method", "Bin_Num", "Idx", "Precompute_Time", "Algorithm_Time", "Total_Time", "Run_Dir")


def partition_lines(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(value)``: ``name community`` lines, sorted by name as a string."""
    named = nodes.join(partition, "node")
    return named.orderBy("name", "community").select(F.concat_ws(" ", "name", F.col("community").cast("string")).alias("value"))


def write_partition(partition: DataFrame, nodes: DataFrame, path: str) -> None:
    """The lines as a Spark text directory, in order over its part files."""
    partition_lines(partition, nodes).write.text(path)


def run_folder(network: str, config: Config, bins: int) -> str:
    """Six significant digits for the real parameters: 1.0 is ``1``."""
    return f"{network}_{config.algorithm}_{config.phi}_g{config.mode}_bin{bins}_gamma{config.gamma:g}_samp{config.sampling:g}"


def claim_run(folder: Path) -> int:
    """The next free number of a folder, taken by creating its file."""
    folder.mkdir(parents=True, exist_ok=True)
    taken = [int(p.stem) for p in folder.glob("*.txt") if p.stem.isdigit()]
    index = max(taken, default=0) + 1
    while True:
        try:
            os.close(os.open(folder / f"{index}.txt", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644))
            return index
        except FileExistsError:
            index += 1


def append_log(path: Path, row: dict) -> None:
    """One row of the log; the header only where the file is new."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", newline="") as f:
        out = csv.DictWriter(f, LOG_COLUMNS, lineterminator="\n")
        if f.tell() == 0:
            out.writeheader()
        out.writerow(row)


_LOG_SCHEMA = ", ".join(f"{c} {'long' if c in ('Bin_Num', 'Idx') else 'double' if c.endswith('_Time') else 'string'}" for c in LOG_COLUMNS)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log that ``log_run`` keeps in the store."""
    return spark.read.schema(_LOG_SCHEMA).option("header", True).csv(path)


def log_run(spark: SparkSession, path: str, network: str, config: Config, bins: int, precompute_s: float, algorithm_s: float) -> int:
    """Appends a run to a log in the store, as CSV with the same header in every part, and
    returns its number: one more than the log has for its folder. For one writer at a time."""
    name = run_folder(network, config, bins)
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
    taken = read_log(spark, path).filter(F.col("Run_Dir") == name).agg(F.max("Idx").alias("n")).first()["n"] if there else None
    row = (network, config.algorithm, config.phi, f"{config.gamma:g}", f"{config.sampling:g}", config.mode, bins, (taken or 0) + 1, precompute_s, algorithm_s, precompute_s + algorithm_s, name)
    spark.createDataFrame([row], _LOG_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(path)
    return row[LOG_COLUMNS.index("Idx")]


def save_run(partition: DataFrame, nodes: DataFrame, network: str, config: Config, bins: int, precompute_s: float, algorithm_s: float, output: str) -> Path:
    """Writes a run under ``output`` on the driver's disk and returns its file. The lines are
    streamed to the driver partition by partition; ``write_partition`` is the way for graphs
    whose partition belongs in the store."""
    name = run_folder(network, config, bins)
    index = claim_run(Path(output) / name)
    path = Path(output) / name / f"{index}.txt"
    with path.open("w") as f:
        for r in partition_lines(partition, nodes).toLocalIterator():
            f.write(r["value"] + "\n")
    append_log(Path(output) / "summary.csv", dict(zip(LOG_COLUMNS, (network, config.algorithm, config.phi, f"{config.gamma:g}", f"{config.sampling:g}", config.mode, bins, index, f"{precompute_s:.4f}", f"{algorithm_s:.4f}", f"{precompute_s + algorithm_s:.4f}", name))))
    return path
