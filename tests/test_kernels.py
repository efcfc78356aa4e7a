"""Vector kernels against numpy, edge values included."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import registry
from graphloom.functions import kernels as K
from graphloom.model import Anchors, Config
from graphloom.functions.kernels import interpolate

PAIRS = [([1.0, 2.0, 3.0], [3.0, -1.0, 0.5]), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ([0.0] * 3, [0.0] * 3), ([1e-200] * 3, [1e-200] * 3), ([2.0, 2.0, 2.0], [1.0, 5.0, 2.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), ([400.0, 0.0, 0.0], [-400.0, 0.0, 1.0]), ([400.0, 0.0, 0.0], [400.0, 0.0, 1.0]), ([0.1, 0.2, 0.3], [0.1, 0.2, 0.3])]


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return (max(-1.0, min(1.0, float(a @ b) / size)) + 1) / 2 if size > 0 else 0.0


def by_hand(a, b):
    a, b = np.array(a), np.array(b)
    x = float(a @ b)
    logistic = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    return ((a - b) ** 2).sum(), np.linalg.norm(a - b), cosine(a, b), cosine(a - a.mean(), b - b.mean()), logistic


def test_kernels(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    rows = df.orderBy("i").select(K.dist_sq(a, b), K.vec_dist(a, b), K.cosine_sim_01(a, b), K.pearson_sim_01(a, b), K.sigmoid_sim(a, b)).collect()
    for r, (x, y) in zip(rows, PAIRS):
        assert list(r) == pytest.approx(by_hand(x, y), abs=1e-9), (x, y)


def test_null_vectors_give_null(spark):
    df = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    row = df.select(*[f(F.col("a"), F.col("b")) for f in K.SIMILARITIES.values()]).first()
    assert list(row) == [None, None, None]


ANCHOR_CASES = [Anchors(), Anchors((1.0,), (0.4,)), Anchors((1.0, 2.0), (0.8, 0.2)), Anchors((1.0, 1.0, 2.0), (0.1, 0.5, 0.9)), Anchors((0.5, 1.5, 1.5, 3.0), (0.0, 1.0, 0.2, 0.4))]


@pytest.mark.parametrize("anchors", ANCHOR_CASES)
def test_interpolation(spark, anchors):
    xs = [-1.0, 0.0, 0.5, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 99.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, d double").orderBy("i").select(K.g_interp(F.col("d"), anchors)).collect()]
    assert got == pytest.approx(list(interpolate(np.array(xs), anchors)))
    c, m = anchors.centers, anchors.means
    for x, g in zip(xs, got):
        if not c:
            assert g == 0
        elif x <= c[0]:
            assert g == m[0]
        elif x >= c[-1]:
            assert g == m[-1]
        elif len(set(c)) == len(c):
            assert g == pytest.approx(np.interp(x, c, m))


def test_bins_go_right(spark):
    rows = spark.createDataFrame([(1.0,), (1.5,), (1.4999,), (9.0,)], "d double").select(K.bin_of(F.col("d"), [1.0, 1.5]), K.bin_of(F.col("d"), [])).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (2, 0), (1, 0), (2, 0)]


def test_centroids_and_length(spark):
    df = spark.createDataFrame([([3.0, 6.0], [1.0, 0.0])], "z array<double>, o array<double>")
    row = df.select(K.centroid(F.col("z"), F.lit(3)), K.centroid_without(F.col("z"), F.lit(3), F.col("o"), F.lit(1)), K.edge_length(F.lit(0.0)), K.edge_length(F.lit(0.5))).first()
    assert row[0] == [1.0, 2.0] and row[1] == [1.0, 3.0] and row[2] == pytest.approx(1e8) and row[3] == pytest.approx(2.0, rel=1e-6)


def test_config_is_checked():
    for bad in ({"g": 6}, {"phi": "dot"}, {"algorithm": "X"}, {"sampling": 0}, {"seeding": "x"}, {"solver": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(g=3).mode == "nokk2m"


def test_rounded_as_in_sql(spark):
    rng = np.random.default_rng(4)
    half = np.round(rng.random(2_000) * 12, 6) + 5e-7
    xs = np.concatenate([rng.random(500) * 12, half, np.nextafter(half, 0), np.nextafter(half, 99), [0.0, 1e8, 1e9 + 1 / 3, 1e12, 1e17, math.inf]])
    want = [r[0] for r in duckdb.sql(f"SELECT round(unnest({[str(x) for x in xs]}::DOUBLE[]), 6)").fetchall()]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = [tuple(r) for r in df.select(K.rounded(F.col("x")), F.round("x", 6), "i").orderBy("i").collect()]
    assert [r[0] for r in got] == want
    assert [r[1] for r in got] != want  # by way of decimals


def test_distances_are_rounded_without_decimals(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1.0000014999999998), (2, 3, 0.5)], "u long, v long, len double")
    monkeypatch.setattr(registry, "_t40_lengths", lambda spark, sf: edges)
    df = registry.sssp(spark, "")
    assert {(r["s"], r["v"]): r["dist"] for r in df.collect()} == {(s, v): round(abs(x - y), 6) for s, x in ((1, 0.0), (2, 1.000001), (3, 1.500001)) for v, y in ((1, 0.0), (2, 1.000001), (3, 1.500001))}
    assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString()
