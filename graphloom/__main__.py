"""Command line: ``python -m graphloom --network NAME --output DIR``.

Reads ``DATA/NAME/network.dat`` and ``DATA/NAME/embedding.dat``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from graphloom.model import ALGORITHMS, MODES, PHIS, Config
from graphloom.plans.detect import detect
from graphloom.sources.sinks import save_run
from graphloom.sources.text import load_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("graphloom", description="Distance-aware community detection.")
    p.add_argument("--network", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--data", default="datasets", help="folder of the networks")
    p.add_argument("--algorithm", choices=ALGORITHMS, default="MGA")
    p.add_argument("--gamma", type=float, default=1.0)
    p.add_argument("--sampling", type=float, default=0.3)
    p.add_argument("--g", type=int, choices=MODES, default=1, help=", ".join(f"{k}={v}" for k, v in MODES.items()))
    p.add_argument("--phi", choices=PHIS, default="cosine")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--seeding", choices=("quantile", "plusplus"), default="quantile")
    p.add_argument("--solver", choices=("auto", "component", "bulk"), default="auto")
    p.add_argument("--consider-initial", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    config = Config(a.algorithm, a.phi, a.gamma, a.sampling, a.g, a.seed, a.seeding, a.solver, a.consider_initial)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    edges, vectors, nodes = load_graph(spark, f"{a.data}/{a.network}/network.dat", f"{a.data}/{a.network}/embedding.dat")
    run = detect(edges, vectors, config)
    path = save_run(run.partition, nodes, a.network, config, run.bins, run.precompute_s, run.algorithm_s, a.output)
    logging.info("[%s] %s", config.algorithm, path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
