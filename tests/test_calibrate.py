"""Pairs, one-dimensional k-means, silhouette and anchors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import kernels as K
from graphloom.model import Config
from graphloom.operators import calibrate as A
from graphloom.operators import pairs as P


def vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(10 * i, rng.normal(size=4).tolist()) for i in range(n)], "node long, z array<double>")


def test_sample_size():
    assert P.sample_size(34, 0.3) == (168, False)
    assert P.sample_size(34, 1.0) == (561, True)
    assert P.sample_size(100_000, 1.0) == (5_000_000, False)
    assert P.sample_size(1, 0.3)[0] == 0 and P.sample_size(2, 0.3) == (0, False)


@pytest.mark.parametrize("size", [4, 9, 1024])
def test_all_pairs_once(spark, size):
    v = vectors(spark, 23).unionByName(spark.createDataFrame([(999, None)], "node long, z array<double>"))
    z = {r["node"]: np.array(r["z"]) for r in v.filter("z is not null").collect()}
    ids = sorted(z)
    cos = lambda a, b: float(z[a] @ z[b] / np.linalg.norm(z[a]) / np.linalg.norm(z[b]))
    every = {(a, b) for a in ids for b in ids if a < b}
    got = P.pair_rows(v, "cosine", size).collect()
    assert len(got) == 253 and {(r["u"], r["v"]) for r in got} == every
    for r in got:
        assert (r["d"], r["sim"]) == pytest.approx((np.linalg.norm(z[r["u"]] - z[r["v"]]), (cos(r["u"], r["v"]) + 1) / 2))
    assert {(r["u"], r["v"]) for r in P.cosine_over(v, 0.3, size).collect()} == {(a, b) for a, b in every if cos(a, b) >= 0.3}
    for within in (None, "part"):
        near = P.nearest(v.withColumn("part", F.col("node") % 3), 4, within, size).collect()
        assert len(near) == len({(r["u"], r["v"]) for r in near})
        for u in ids:
            best = sorted((b for b in ids if b != u and (within is None or u % 3 == b % 3)), key=lambda b: (-cos(u, b), b))[:4]
            assert [r["v"] for r in sorted((r for r in near if r["u"] == u), key=lambda r: (-r["cos"], r["v"]))][:4] == best
    pair = lambda a, b, same: pa.table({"u": np.repeat(a.node, len(b)), "v": np.tile(b.node, len(a))})
    across = P.pairs_across(v.filter("node < 90"), v.filter("node >= 90"), pair, "u long, v long", size).collect()
    assert sorted(map(tuple, across)) == [(a, b) for a in ids for b in ids if a < 90 <= b]


@pytest.mark.parametrize("phi", ["cosine", "pearson", "sigmoid"])
def test_matrix_similarities(spark, phi):
    rng = np.random.default_rng(5)
    rows = [(i, z) for i, z in enumerate([[0.0] * 4, [2.0] * 4, *rng.normal(size=(5, 4)).tolist()])]
    df = K.with_sizes(spark.createDataFrame(rows, "node long, z array<double>"), phi)
    both = df.select(F.struct(*df.columns).alias("a")).crossJoin(df.select(F.struct(*df.columns).alias("b")))
    want = P.similarities(phi, *[np.array([z for _, z in rows])] * 2)
    for r in both.select("a.node", F.col("b.node").alias("other"), K.similarity_of(phi, F.col("a"), F.col("b")).alias("x"), K.similarity(phi, F.col("a.z"), F.col("b.z")).alias("y")).collect():
        assert r["x"] == r["y"] == pytest.approx(want[r["node"], r["other"]])


def test_sampled_pairs(spark):
    v = vectors(spark, 9)
    a = [(r["r"], r["a"]["node"], r["b"]["node"]) for r in P.sampled_pairs(v, 50, 1).orderBy("r").collect()]
    assert len(a) == 50 and all(x != y for _, x, y in a)
    assert a == [(r["r"], r["a"]["node"], r["b"]["node"]) for r in P.sampled_pairs(v, 50, 1).orderBy("r").collect()]
    assert P.sampled_pairs(vectors(spark, 2), 20, 1).count() == 20
    assert P.sampled_pairs(vectors(spark, 1), 20, 1).count() == 0 and P.sampled_pairs(v, 0, 1).count() == 0


def silhouette(x, bins, k):
    if k <= 1 or k >= len(x):
        return -1.0
    out = []
    for i, (v, c) in enumerate(zip(x, bins)):
        own = [abs(v - w) for j, (w, d) in enumerate(zip(x, bins)) if d == c and j != i]
        if own:
            a = sum(own) / len(own)
            b = min(np.mean([abs(v - w) for w, d in zip(x, bins) if d == o]) for o in set(bins) - {c})
            out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return sum(out) / len(out) if out else -1.0


def test_silhouette(spark):
    rng = random.Random(1)
    for case in range(8):
        x = sorted(round(rng.uniform(0, 3), 1 if case % 2 else 6) for _ in range(30)) + ([50.0] if case > 3 else [])
        mids = [0.7, 1.9, 1.95, 20.0]
        bins = [sum(v >= m for m in mids) for v in x]
        want = silhouette(x, bins, 5)
        df = spark.createDataFrame([(v,) for v in x], "d double")
        assert A.silhouette(df, K.bin_of(F.col("d"), mids), 5).first()["score"] == pytest.approx(want)
        assert A.local_silhouette(np.array(x), np.array(bins), 5) == pytest.approx(want)
    assert A.silhouette(df, F.lit(0), 1).first()["score"] == -1.0 and A.local_silhouette(np.array([1.0, 2.0]), np.array([0, 1]), 2) == -1.0


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.sort(np.concatenate([rng.normal(c, 0.05, 40) for c in (1.0, 2.0, 4.0)]))
    df = spark.createDataFrame([(str(i), float(v), float(v) / 2) for i, v in enumerate(x)], "r string, d double, sim double")
    start = A.seed_quantile(df, 3)
    assert start == pytest.approx(A.quantiles(x, 3))
    centers, cuts = A.kmeans(x, start, 50)
    assert centers == pytest.approx([1.0, 2.0, 4.0], abs=0.05)
    assert [x[a:b].mean() for a, b in zip(cuts, cuts[1:])] == pytest.approx(centers)
    assert A.kmeans(x, centers, 50)[0] == pytest.approx(centers)  # settled: nothing moves
    moved = A.seed_quantile(df, 3)
    for rounds in range(1, 6):  # the same rounds as the table's
        moved = A.moved(moved, A.lloyd_step(df, moved))
        assert A.kmeans(x, start, rounds)[0] == pytest.approx(moved)
    assert A.best_k(df) == A.best_k(df, "plusplus") == 3
    assert A.seed_plusplus(df, 3, 7) == pytest.approx(A.local_plusplus([str(i) for i in range(len(x))], x, 3, 7))
    # an empty bin keeps its center, and its mean is that of the bin before it
    assert A.moved([0.0, 1.5, 30.0], A.lloyd_step(df, [0.0, 1.5, 30.0]))[2] == 30.0
    anchors = A.anchors_of(df, [-50.0, -40.0, 1.5, 30.0, 31.0])
    assert anchors.means[:2] == (0.0, 0.0) and anchors.means[3] == anchors.means[2] == anchors.means[4] > 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 12])
def test_calibration_of_small_graphs(spark, n):
    v = vectors(spark, n) if n else vectors(spark, 1).limit(0)
    anchors, k = A.calibrate(v, Config(sampling=1.0))
    assert len(anchors.centers) == k and list(anchors.centers) == sorted(anchors.centers)
    assert A.calibrate(v, Config(g=2))[1] == 5 and A.calibrate(v, Config(g=5))[0].centers == ()
    assert A.calibrate(v, Config(sampling=0.3)) == A.calibrate(v, Config(sampling=0.3))


def test_vectors_travel_to_few_blocks(spark):
    """Traffic follows the number of blocks: 6,000 vectors of 16 numbers go to some ten, and
    no pair is lost or twice."""
    rng = np.random.default_rng(7)
    z = rng.normal(size=(6000, 16))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "node long, z array<double>")
    blocks, n = P._blocks(v, None, None)
    assert n == math.isqrt(16 * spark.sparkContext.defaultParallelism) + 1
    big, m = P._blocks(v, None, 500)
    assert m == 12 and sorted(len(r["rows"]) for r in blocks.collect()) and sum(len(r["rows"]) for r in big.collect()) == 6000
    got = P.cosine_over(v, 0.8).collect()
    unit = z / np.linalg.norm(z, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.8, 1))
    assert sorted((r["u"], r["v"]) for r in got) == sorted(zip(i.tolist(), j.tolist()))


def test_tiles_of_a_block_meet_once(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(90)], "node long, z array<double>")
    run = lambda a, b, same: pa.table(dict(zip(("u", "v"), P.ends(a, b, *P.every(a, b, same)))))
    spread = P._blocks(v, None, 90)[0].select("w", P.F.lit(0).alias("p"), P.F.lit(0).alias("q"), P.F.lit(2).alias("side"), "rows")
    blocks = [P.Block(rows) for rows in spread.toArrow().column("rows").combine_chunks()]
    monkeypatch.setattr(P, "BLOCK", 20)
    pairs = [(r["u"], r["v"]) for b in blocks for out in P._tiled(b, b, True, run) for r in out.to_pylist()]
    inside = sum(len(b) * (len(b) - 1) // 2 for b in blocks)
    assert len(pairs) == len(set(pairs)) == inside > 0


def test_cosines_at_the_threshold(spark):
    """Kept or not as the sum in order says, to the last bit; zero vectors have no cosine."""
    rng = np.random.default_rng(8)
    z = np.vstack([rng.normal(size=(60, 8)), np.zeros((2, 8))])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "node long, z array<double>")
    block = object.__new__(P.Block)
    block.node, block.z, block.columns = np.arange(62), z, {"node": np.arange(62)}
    cos = P.cosines(block, block)
    for least in cos[3, [7, 20, 41]].tolist():
        i, j = np.nonzero(np.triu(cos >= least, 1))
        assert sorted((r["u"], r["v"], r["cos"]) for r in P.cosine_over(v, least).collect()) == sorted(zip(i.tolist(), j.tolist(), cos[i, j].tolist()))
