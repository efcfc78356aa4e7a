"""Calibration of g(d): one-dimensional k-means of pair distances, the number of clusters
by silhouette, the mean similarity of each cluster, linear interpolation in between.

``distances(d, sim, ...)`` is a table. A Lloyd step over it is one aggregation to 15 rows
(``lloyd_step``). The whole of a calibration runs on the sorted distances themselves: the
method looks at ``PAIR_CAP`` pairs at most, 40 MB of doubles at any size of the graph, so
they are collected once, and with prefix sums a round is a few binary searches.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import kernels as K
from graphloom.model import CONSTANT_BINS, Anchors, Config
from graphloom.operators import pairs as P
from graphloom.storage import written

K_MIN, K_MAX = 2, 15
SEARCH_ROUNDS, FINAL_ROUNDS = 30, 50


def midpoints(centers: list[float]) -> list[float]:
    return [0.5 * (a + b) for a, b in zip(centers, centers[1:])]


def seed_quantile(distances: DataFrame, k: int) -> list[float]:
    """Centers at the (i + 1/2) / k quantiles; the default, free of chance."""
    row = distances.agg(F.percentile("d", F.array(*[F.lit((i + 0.5) / k) for i in range(k)])).alias("c")).first()
    return list(row["c"] or [])


def seed_plusplus(distances: DataFrame, k: int, seed: int, key: str = "r") -> list[float]:
    """k-means++: each next center is drawn with probability proportional to the squared
    distance from the nearest one. The draw is a race: the row with the least -ln(u) / weight
    wins, with u from md5 of (seed, center, row), so it is one aggregation per center."""
    centers: list[float] = []
    for i in range(k):
        u = (P._hex8(F.concat(F.lit(f"{seed}:{i}:"), F.col(key).cast("string"))) + 0.5) / float(1 << 32)
        weight = F.least(*[F.pow(F.col("d") - F.lit(c), 2) for c in centers]) if len(centers) > 1 else F.pow(F.col("d") - F.lit(centers[0]), 2) if centers else F.lit(1.0)
        race = F.when(weight > 0, -F.log(u) / weight)
        row = distances.agg(F.min_by("d", race).alias("c"), F.min_by("d", u).alias("any")).first()
        centers.append(row["c"] if row["c"] is not None else row["any"])
    return sorted(centers)


def lloyd_step(distances: DataFrame, centers: list[float]) -> DataFrame:
    """``(c, center, n)`` of the non-empty bins of these centers."""
    return distances.groupBy(K.bin_of(F.col("d"), midpoints(centers)).alias("c")).agg(F.avg("d").alias("center"), F.count("*").alias("n"))


def moved(centers: list[float], step: DataFrame) -> list[float]:
    """The centers after a step: an empty bin keeps its center; sorted."""
    out = list(centers)
    for r in step.collect():  # k rows
        out[r["c"]] = r["center"]
    return sorted(out)


def kmeans(x: np.ndarray, centers: list[float], max_rounds: int) -> tuple[list[float], np.ndarray]:
    """(centers, where the bins of the last assignment start and end) of sorted values.

    Stops when a round, not the first, leaves every assignment as it was. An empty bin keeps
    its center; a value on a midpoint goes right."""
    upto = np.concatenate([[0.0], np.cumsum(x)])
    c, cuts = np.array(centers, float), None
    for _ in range(max_rounds):
        now = np.concatenate([[0], np.searchsorted(x, (c[:-1] + c[1:]) / 2), [len(x)]])
        if cuts is not None and (now == cuts).all():
            break
        cuts, size = now, np.diff(now)
        c = np.sort(np.where(size > 0, np.diff(upto[now]) / np.maximum(size, 1), c))
    return c.tolist(), cuts


def wcss(distances: DataFrame, centers: list[float]) -> DataFrame:
    """One row: the sum of squared distances from each row's center."""
    own = F.element_at(F.array(*[F.lit(c) for c in centers]), K.bin_of(F.col("d"), midpoints(centers)) + 1)
    return distances.agg(F.sum(F.pow(F.col("d") - own, 2)).alias("wcss"))


def silhouette(sample: DataFrame, bins: Column, k: int) -> DataFrame:
    """One row, ``score``, of at most ``SUBSAMPLE_CAP`` rows ``d``.

    Bins are intervals of the line, so the mean distance to a bin on one side is the
    distance to its mean, only the nearest bins on either side can be nearest, and the
    mean distance inside a bin follows from prefix sums: no pair is formed. Rows alone in
    their bin do not count; NaN if all rows share one bin. -1 if k is 1 or not below the number of rows."""
    rows = sample.select("d", bins.alias("c"))
    per = rows.groupBy("c").agg(F.count("*").alias("m"), F.sum("d").alias("total"))
    by_bin = Window.orderBy("c")  # k rows
    per = per.withColumn("left", F.lag(F.col("total") / F.col("m")).over(by_bin)).withColumn("right", F.lead(F.col("total") / F.col("m")).over(by_bin))
    inside = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(per, "c").withColumn("i", F.count("*").over(inside)).withColumn("upto", F.sum("d").over(inside))
    d, m, i = F.col("d"), F.col("m"), F.col("i")
    a = F.try_divide(d * i - F.col("upto") + (F.col("total") - F.col("upto")) - d * (m - i), m - 1)
    b = F.least(F.abs(d - F.col("left")), F.abs(d - F.col("right")))  # null where there is no bin
    top = F.greatest(a, b)
    s = F.when(top > 0, (b - a) / top).otherwise(F.lit(0.0))
    counted = placed.filter(m > 1)
    score = F.coalesce(F.avg(F.when(F.col("only"), F.lit(float("nan"))).otherwise(F.col("s"))), F.lit(-1.0))
    n = sample.count()
    if k <= 1 or k >= n:
        return sample.sparkSession.range(1).select(F.lit(-1.0).alias("score"))
    return counted.select(s.alias("s"), (F.col("left").isNull() & F.col("right").isNull()).alias("only")).agg(score.alias("score"))


def local_silhouette(x: np.ndarray, bins: np.ndarray, k: int) -> float:
    """The score of ``silhouette`` for sorted values in memory."""
    n = len(x)
    if k <= 1 or k >= n:
        return -1.0
    kept, start, size = np.unique(bins, return_index=True, return_counts=True)
    if len(kept) == 1:
        return float("nan")
    at = np.searchsorted(kept, bins)
    total = np.add.reduceat(x, start)
    mean = total / size
    upto = np.cumsum(x)
    upto -= np.where(start[at] > 0, upto[start[at] - 1], 0.0)
    i, m = np.arange(n) - start[at] + 1, size[at]
    own = (x * i - upto + total[at] - upto - x * (m - i)) / np.maximum(m - 1, 1)
    left, right = np.r_[-np.inf, mean[:-1]][at], np.r_[mean[1:], np.inf][at]
    other = np.minimum(x - left, right - x)
    top = np.maximum(own, other)
    score = np.where(top > 0, (other - own) / np.where(top > 0, top, 1.0), 0.0)[m > 1]
    return float(score.mean()) if len(score) else -1.0


def best_k(sample: DataFrame, seeding: str = "quantile", seed: int = 42, k_min: int = K_MIN, k_max: int = K_MAX) -> int:
    """The k of highest silhouette; the smallest of equals. ``sample`` has at most
    ``SUBSAMPLE_CAP`` rows by its making, so the search runs on the driver."""
    rows = sample.select("d", "r").limit(P.SUBSAMPLE_CAP).toPandas().sort_values(["d", "r"])
    x = rows["d"].to_numpy()
    best, best_score = CONSTANT_BINS, float("-inf")
    for k in range(k_min, k_max + 1):
        centers = quantiles(x, k) if seeding == "quantile" else local_plusplus(rows["r"].tolist(), x, k, seed)
        cuts = kmeans(x, centers, SEARCH_ROUNDS)[1]
        score = local_silhouette(x, np.repeat(np.arange(k), np.diff(cuts)), k)
        if score > best_score:
            best, best_score = k, score
    return best


def local_plusplus(keys: list, x: np.ndarray, k: int, seed: int) -> list[float]:
    """The race of ``seed_plusplus`` for values in memory."""
    centers: list[float] = []
    for i in range(k):
        u = np.array([(int(hashlib.md5(f"{seed}:{i}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32) for r in keys])
        weight = np.min([(x - c) ** 2 for c in centers], axis=0) if centers else np.ones(len(x))
        race = np.where(weight > 0, -np.log(u) / np.where(weight > 0, weight, 1.0), np.inf)
        centers.append(float(x[race.argmin()] if np.isfinite(race).any() else x[u.argmin()]))
    return sorted(centers)


def quantiles(x: np.ndarray, k: int) -> list[float]:
    """``seed_quantile`` of sorted values."""
    return np.quantile(x, [(i + 0.5) / k for i in range(k)]).tolist()


def bin_means(distances: DataFrame, centers: list[float]) -> DataFrame:
    """``(c, center, mean_sim)`` of every bin: an empty bin carries the mean of the one
    before it, an empty first bin has 0."""
    spark = distances.sparkSession
    per = distances.groupBy(K.bin_of(F.col("d"), midpoints(centers)).alias("c")).agg(F.avg("sim").alias("m"))
    every = spark.createDataFrame(list(enumerate(map(float, centers))), "c int, center double")
    carry = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows
    return every.join(per, "c", "left").select("c", "center", F.coalesce(F.last("m", ignorenulls=True).over(carry), F.lit(0.0)).alias("mean_sim"))


def anchors_of(distances: DataFrame, centers: list[float]) -> Anchors:
    rows = sorted((r["c"], r["center"], r["mean_sim"]) for r in bin_means(distances, centers).collect())
    return Anchors(tuple(r[1] for r in rows), tuple(r[2] for r in rows))


def pair_distances(vectors: DataFrame, config: Config) -> DataFrame:
    """``(r, d, sim)``: all pairs if the sample would cover them, else a sample."""
    n = vectors.count()
    wanted, exhaustive = P.sample_size(n, config.sampling)
    if exhaustive:
        pairs = P.pair_rows(vectors, config.phi)
        return pairs.select(F.concat_ws(":", "u", "v").alias("r"), "d", "sim")
    found = P.sampled_pairs(K.with_sizes(vectors.select("node", "z"), config.phi), wanted, config.seed, n)
    sim = K.similarity_of(config.phi, F.col("a"), F.col("b"))
    return found.select(F.col("r").cast("string").alias("r"), K.vec_dist(F.col("a.z"), F.col("b.z")).alias("d"), sim.alias("sim"))


def calibrate(vectors: DataFrame, config: Config) -> tuple[Anchors, int]:
    """(anchors, number of bins to report). Modes with a constant g need no vectors; a
    graph without a pair of nodes has no anchors."""
    if config.mode in ("nog", "gaverage"):
        return Anchors(), CONSTANT_BINS
    distances = written(pair_distances(vectors, config), "distances")
    sample = written(P.subsample(distances, seed=config.seed), "distance-sample")
    n = sample.count()
    if not n:
        return Anchors(), 0
    k = best_k(sample, config.seeding, config.seed) if n > K_MIN else 1
    x = np.sort(distances.select("d").toArrow()["d"].to_numpy())  # PAIR_CAP values at most
    start = quantiles(x, k) if config.seeding == "quantile" else seed_plusplus(distances, k, config.seed)
    return anchors_of(distances, kmeans(x, start, FINAL_ROUNDS)[0]), k
