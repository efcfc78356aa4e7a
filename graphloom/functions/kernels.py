"""Vector kernels as Column expressions; vectors are ``array<double>``.

All stay in the JVM. Similarities map to [0, 1]: cosine and Pearson as (s + 1) / 2 with
s clamped to [-1, 1], sigmoid as the logistic function of the dot product. A vector of
zero norm (for Pearson: zero variance) has similarity 0 by cosine and Pearson, and 1/2
by sigmoid. A null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Anchors

EPSILON_LENGTH = 1e-8
SAME_CENTER = 1e-18


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def dist_sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def vec_dist(a: Column, b: Column) -> Column:
    return F.sqrt(dist_sq(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def stable_sigmoid(x: Column) -> Column:
    """Never raises e to a positive power."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def cosine_sim_01(a: Column, b: Column) -> Column:
    return _cosine(a, b, norm(a) * norm(b))


def _cosine(a: Column, b: Column, size: Column) -> Column:
    raw = F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).when(size.isNotNull(), F.lit(-1.0))
    return (raw + 1) / 2


def centered(a: Column) -> Column:
    mean = _sum(a) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def pearson_sim_01(a: Column, b: Column) -> Column:
    return cosine_sim_01(centered(a), centered(b))


def sigmoid_sim(a: Column, b: Column) -> Column:
    return stable_sigmoid(dot(a, b))


SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_sim_01, "pearson": pearson_sim_01, "sigmoid": sigmoid_sim}


def similarity(name: str, a: Column, b: Column) -> Column:
    return SIMILARITIES[name](a, b)


def with_sizes(vectors: DataFrame, phi: str) -> DataFrame:
    """``vectors(node, z)`` with what ``similarity_of`` needs of a vector, taken once for each:
    ``x`` (the centered vector, for Pearson only) and ``size``, its norm."""
    if phi == "pearson":
        vectors = vectors.withColumn("x", centered(F.col("z")))
    return vectors if phi == "sigmoid" else vectors.withColumn("size", norm(F.col("x" if phi == "pearson" else "z")))


def similarity_of(phi: str, a: Column, b: Column) -> Column:
    """``similarity`` of two rows of ``with_sizes``, as structs."""
    if phi == "sigmoid":
        return sigmoid_sim(a["z"], b["z"])
    x = "x" if phi == "pearson" else "z"
    return _cosine(a[x], b[x], a["size"] * b["size"])


def interpolate(d: np.ndarray, anchors: Anchors) -> np.ndarray:
    """``g_interp`` for many distances in memory."""
    c, m = np.array(anchors.centers), np.array(anchors.means)
    if not len(c):
        return np.zeros_like(d)
    if len(c) == 1:
        return np.full_like(d, m[0])
    i = np.clip(np.searchsorted(c, d, side="right"), 1, len(c) - 1)
    gap = c[i] - c[i - 1]
    t = np.where(gap > SAME_CENTER, np.clip((d - c[i - 1]) / np.where(gap > SAME_CENTER, gap, 1.0), 0.0, 1.0), 0.0)
    return np.where(d <= c[0], m[0], np.where(d >= c[-1], m[-1], m[i - 1] + t * (m[i] - m[i - 1])))


def g_interp(d: Column, anchors: Anchors) -> Column:
    """Piecewise linear over the anchors, flat outside; 0 without anchors. One CASE chain
    of at most 15 branches, so it stays inside code generation."""
    if not anchors.centers:
        return F.when(d.isNotNull(), F.lit(0.0))
    points = list(zip(anchors.centers, anchors.means))
    (first, first_mean), (last, last_mean) = points[0], points[-1]
    out = F.when(d <= first, F.lit(first_mean)).when(d >= last, F.lit(last_mean))
    for (c0, m0), (c1, m1) in zip(points, points[1:]):
        slope = (m1 - m0) / (c1 - c0) if c1 - c0 > SAME_CENTER else 0.0
        out = out.when(d < c1, F.lit(m0) + (d - F.lit(c0)) * F.lit(slope))
    return out


def rounded(x: Column, digits: int = 6) -> Column:
    """``x``, not negative, rounded half up as DuckDB does, in double precision;
    Spark's ``round`` goes by way of decimals."""
    by = 10.0**digits
    return F.when(x * by < 2.0**52, F.floor(x * by + 0.5)).otherwise(x * by) / by


def edge_length(w: Column) -> Column:
    return 1 / (F.lit(EPSILON_LENGTH) + w)


def centroid(sum_z: Column, count: Column) -> Column:
    return F.transform(sum_z, lambda x: x / count)


def centroid_without(sum_z: Column, count: Column, own_z: Column, own_count: Column) -> Column:
    """Centroid of a community without one of its members."""
    return F.zip_with(sum_z, own_z, lambda x, y: (x - y) / (count - own_count))


def bin_of(d: Column, midpoints: list[float]) -> Column:
    """Index of the interval between midpoints; a value on a midpoint goes right."""
    out = None
    for i, m in enumerate(midpoints):
        out = F.when(d < m, F.lit(i)) if out is None else out.when(d < m, F.lit(i))
    last = F.lit(len(midpoints))
    return last if out is None else out.otherwise(last)
