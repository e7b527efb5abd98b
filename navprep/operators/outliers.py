"""Statistical outliers of clouds by a nearest-neighbour join over blocks: no task holds an env's cloud.

First every block answers for its own points from them and a halo of its neighbours' points. A point whose k nearest can't be told from those, because the
k-th is farther than the halo is wide, is sent on, with a radius twice as large each round, to all blocks that hold a point within it; each block gives its
nearest, and the nearest of those are kept. So dense parts are done at once, and only lone points search far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import sized, stored

NEIGHBOURS, RATIO = 50, 2.0
#: Width of the halo in the given spacing of points, and a block's edge in halos.
HALO, EDGE = 6, 4
#: Distances that a task holds at once.
CHUNK = 1 << 21
_XYZ = ("x", "y", "z")
_BLOCK = ("bx", "by", "bz")


def nearest_means(own: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, distance, how many) of the k nearest points of each of own; the farthest of these is the distance."""
    n = min(k, len(points))
    mean, far = np.empty(len(own)), np.empty(len(own))
    for i, d in _distances(own, points, n):
        mean[i], far[i] = d.mean(1), d.max(1)
    return mean, far, np.full(len(own), n)


def block_means(own: np.ndarray, points: np.ndarray, k: int, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As nearest_means for own, which are among points, where the k-th is no farther than halo; elsewhere the distance is infinite.

    Cells of half the halo, then of the halo: the points of the 27 cells around a point's own hold all within a cell's width of it. So the work of a dense
    block follows its points, not their square."""
    n = min(k, len(points))
    mean, far, left = np.full(len(own), np.nan), np.full(len(own), np.inf), np.arange(len(own))
    low = points.min(0)
    for width in (halo / 2, halo):
        cell, asked = (np.floor((p - low) / width).astype(np.int64) + 1 for p in (points, own[left]))
        _, ny, nz = cell.max(0) + 2
        code, asked = ((c[:, 0] * ny + c[:, 1]) * nz + c[:, 2] for c in (cell, asked))
        order, turn = np.argsort(code, kind="stable"), np.argsort(asked, kind="stable")
        code, points_in = code[order], points[order]
        left, (where, first) = left[turn], np.unique(asked[turn], return_index=True)
        rows = where[:, None] + np.array([(i * ny + j) * nz for i in (-1, 0, 1) for j in (-1, 0, 1)])
        lo, hi = np.searchsorted(code, rows - 1), np.searchsorted(code, rows + 1, "right")
        for a, b, ends in zip(first, [*first[1:], len(left)], zip(lo, hi)):
            near = np.concatenate([points_in[i:j] for i, j in zip(*ends)])
            if len(near) >= n:
                for at, d in _distances(own[left[a:b]], near, n):
                    mean[left[a:b][at]], far[left[a:b][at]] = d.mean(1), d.max(1)
        left = left[far[left] > width]
        if not len(left):
            break
    far[far > halo] = np.inf
    return mean, far, np.full(len(own), n)


def _distances(own: np.ndarray, points: np.ndarray, n: int):
    """Slices of own with their n least distances to points, in no order."""
    step = max(1, CHUNK // max(1, len(points)))
    for at in range(0, len(own), step):
        d = sum((own[at : at + step, None, c] - points[None, :, c]) ** 2 for c in range(points.shape[1]))
        yield slice(at, at + step), np.sqrt(np.partition(d, n - 1, 1)[:, :n])


def _blocks(points: DataFrame, edge: float, halo: float) -> DataFrame:
    """points, once for each block whose cells or halo hold them; home: it is their own."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / edge).cast("long"), F.floor((F.col(c) + halo) / edge).cast("long"))
    own = F.lit(True)
    for c, b in zip(_XYZ, _BLOCK):
        points = points.withColumn(b, F.explode(near(c)))
        own &= F.col(b) == F.floor(F.col(c) / edge)
    return points.withColumn("home", own)


def mean_distances(points: DataFrame, spacing: float, k: int = NEIGHBOURS) -> DataFrame:
    """id, env, mean: the mean distance of each point (id, env, x, y, z; stored) to its k nearest of the env, itself among them, or to all if there are fewer.

    spacing: about the distance of neighbours, as voxels of that size leave it; it decides the work, not the result. A block holds as many points as its
    volume has voxels, so clouds are to be thinned first. Points of equal place count each."""
    halo, edge = HALO * spacing, HALO * EDGE * spacing

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["home"]]
        mean, far, n = block_means(own[list(_XYZ)].to_numpy(float), pdf[list(_XYZ)].to_numpy(float), k, halo)
        return pd.DataFrame({"id": own["id"].to_numpy(), "env": np.full(len(own), pdf["env"].iloc[0], object), "mean": mean, "far": far, "n": n})

    at_home = _blocks(points, edge, halo).groupBy("env", *_BLOCK).applyInPandas(first, "id long, env string, mean double, far double, n long")
    size = lambda c: (F.max(c) - F.min(c)) ** 2
    envs = stored(points.groupBy("env").agg(F.count("*").alias("all"), F.sqrt(size("x") + size("y") + size("z")).alias("wide")), "outlier-envs")
    found = stored(at_home.join(sized(envs), "env"), "outlier-near")
    # done: enough points, the farthest of them nearer than any outside the halo
    done = (F.col("n") >= F.least(F.col("all"), F.lit(k))) & ((F.col("far") <= halo) | (F.col("wide") <= halo))
    out = found.where(done).select("id", "env", "mean")
    left = found.where(~done).select("id", "env", "wide", "all")
    if left.isEmpty():
        return out
    placed = points.select("env", *_XYZ, *(F.floor(F.col(c) / edge).cast("long").alias(b) for c, b in zip(_XYZ, _BLOCK)))
    taken = stored(placed.groupBy("env", *_BLOCK).agg(*(f(c).alias(f"{n}_{c}") for c in _XYZ for n, f in (("lo", F.min), ("hi", F.max)))), "outlier-blocks")
    left = stored(left.join(points.select("id", *_XYZ), "id"), "outlier-left")
    radius = halo
    while True:
        radius *= 2
        met = _within(left, taken, edge, radius, placed, k)
        # of all that blocks gave, the k nearest
        best = met.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        best = stored(left.join(best, "id").withColumn("n", F.size("near")), "outlier-wider")
        done = (F.col("n") >= F.least(F.col("all"), F.lit(k))) & ((F.element_at("near", -1) <= radius) | (F.col("wide") <= radius))
        mean = F.aggregate("near", F.lit(0.0), lambda a, d: a + d) / F.col("n")
        out = out.unionByName(best.where(done).select("id", "env", mean.alias("mean")))
        left = best.where(~done).drop("near", "n")
        if left.isEmpty():
            return out


def _within(left: DataFrame, taken: DataFrame, edge: float, radius: float, placed: DataFrame, k: int) -> DataFrame:
    """id, near: for each point of left and each block with a point's box within radius of it, the block's up to k least distances.

    Blocks are found by a grid of cells as wide as the radius, so a point meets the blocks of 27 cells, not all."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    q = left.select("id", "env", *_XYZ)
    b = taken
    for c in _XYZ:
        q = q.withColumn(f"c{c}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
        # a block's box is no wider than a cell of twice the halo or more allows: it lies in one or two cells
        b = b.withColumn(f"c{c}", F.explode(F.sequence(cell(f"lo_{c}"), cell(f"hi_{c}"))))
    gap = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
    pairs = q.join(b, ["env", "cx", "cy", "cz"]).where(gap("x") ** 2 + gap("y") ** 2 + gap("z") ** 2 <= radius * radius)
    pairs = pairs.select("id", "env", *_XYZ, *_BLOCK).distinct()

    def nearest(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        near: list[np.ndarray] = []
        if not len(asked):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "near": np.zeros(0, object)})
        for _, d in _distances(asked[list(_XYZ)].to_numpy(float), points[list(_XYZ)].to_numpy(float), min(k, len(points))):
            near.extend(d)
        return pd.DataFrame({"id": asked["id"].to_numpy(), "near": near})

    keys = ("env", *_BLOCK)
    return pairs.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(nearest, "id long, near array<double>")


def remove_outliers(points: DataFrame, spacing: float, k: int = NEIGHBOURS, ratio: float = RATIO) -> DataFrame:
    """points (env, x, y, z and any other columns) without those whose mean distance to their k nearest (themselves among them) isn't below the env's mean of
    these by more than ratio deviations above it, or is 0.

    As in the public definition: the deviation is of all means above 0, with one degree of freedom less than points. So an env of one point, or of copies of
    one, loses all, as its means are 0; rows with a null or non-finite coordinate go."""
    finite = F.lit(True)
    for c in _XYZ:
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = stored(points.where(finite).withColumn("_id", F.monotonically_increasing_id()), "outlier-points")
    means = stored(mean_distances(rows.select(F.col("_id").alias("id"), "env", *_XYZ), spacing, k), "outlier-means")
    above = F.when(F.col("mean") > 0, F.col("mean"))
    centre = stored(means.groupBy("env").agg((F.coalesce(F.sum(above), F.lit(0.0)) / F.count("*")).alias("centre"), F.count("*").alias("n")), "outlier-centres")
    spread = means.join(sized(centre), "env").groupBy("env", "centre", "n").agg(F.sum((above - F.col("centre")) ** 2).alias("s"))
    most = stored(spread.select("env", (F.col("centre") + ratio * F.sqrt(F.col("s") / (F.col("n") - 1))).alias("most")), "outlier-most")
    kept = means.join(sized(most), "env").where("mean > 0 and mean < most").select(F.col("id").alias("_id"))
    return rows.join(kept, "_id", "left_semi").drop("_id")
