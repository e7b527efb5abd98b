"""Trajectories and their scores against cost maps."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g
from .folds import ordered_fold
from .grids import bicubic, dense
from .tables import sized, stored

#: Waypoints of a tile that a task samples at once.
WAYPOINTS = 1 << 16


def densify(keypoints: DataFrame, per_segment: int = 10) -> DataFrame:
    """traj_id, wp_idx, x, y, z on the cubic Hermite through the origin and the keypoints (kp_idx from 1); tangents are one-sided at the ends, else means of the neighbours."""
    node = lambda i, *v: F.struct(i.cast("int").alias("kp_idx"), *(c.cast("double").alias(n) for n, c in zip("xyz", v)))
    k = keypoints.groupBy("traj_id").agg(F.sort_array(F.collect_list(node(F.col("kp_idx"), *map(F.col, "xyz")))).alias("k"))
    k = k.select("traj_id", F.concat(F.array(node(F.lit(0), *(F.lit(0.0),) * 3)), "k").alias("k"))

    def tangent(p, i, c: str):
        back, fore = p[c] - F.get("k", i - 1)[c], F.get("k", i + 1)[c] - p[c]
        return F.when(back.isNull(), fore).when(fore.isNull(), back).otherwise((back + fore) / 2).alias(f"t{c}")

    k = k.select("traj_id", F.transform("k", lambda p, i: F.struct(p["kp_idx"].alias("kp_idx"), *(p[c].alias(c) for c in "xyz"), *(tangent(p, i, c) for c in "xyz"))).alias("k"))
    names = ("x", "y", "z", "tx", "ty", "tz")
    ahead = F.transform("k", lambda p, i: F.struct(p["kp_idx"].alias("kp_idx"), *(p[c].alias(c) for c in names), *(F.get("k", i + 1)[c].alias(f"n{c}") for c in names), F.get("k", i + 2).isNull().alias("last")))
    k = k.select("traj_id", F.explode(ahead).alias("k")).select("traj_id", "k.*").where("nx is not null")
    k = k.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(per_segment) - F.when(F.col("last"), 0).otherwise(1))))
    t = F.col("s") / per_segment
    h = (2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t, -2 * t**3 + 3 * t**2, t**3 - t**2)
    at = lambda c: (h[0] * F.col(c) + h[1] * F.col(f"t{c}") + h[2] * F.col(f"n{c}") + h[3] * F.col(f"nt{c}")).alias(c)
    return k.select("traj_id", (F.col("kp_idx") * per_segment + F.col("s")).cast("int").alias("wp_idx"), at("x"), at("y"), at("z"))


def shift_sensor(keypoints: DataFrame, dx: float, dy: float, least: float = 0.1) -> DataFrame:
    """Keypoints (traj_id, kp_idx from 1, x, y, z) seen from a sensor at dx, dy: if that is more than least away, the origin comes first, as keypoint 1, and all
    are moved by it; else they stay as they are."""
    if math.hypot(dx, dy) <= least:
        return keypoints
    row = lambda i, *v: F.struct(i.cast("int").alias("kp_idx"), *(c.cast("double").alias(n) for n, c in zip("xyz", v)))
    own, zero = row(F.col("kp_idx") + 1, *map(F.col, "xyz")), F.lit(0)
    k = keypoints.select("traj_id", F.explode(F.when(F.col("kp_idx") == 1, F.array(row(F.lit(1), zero, zero, zero), own)).otherwise(F.array(own))).alias("k")).select("traj_id", "k.*")
    return k.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)


def to_world(waypoints: DataFrame) -> DataFrame:
    """World coordinates wx, wy, wz of waypoints with a pose."""
    v = g.transform(F.col("pose"), (F.col("x"), F.col("y"), F.col("z")))
    return waypoints.withColumns(dict(zip(("wx", "wy", "wz"), v)))


def path_columns(waypoints: DataFrame) -> DataFrame:
    """seg: distance from the waypoint before (null for the first); along: path length so far."""
    w = W.partitionBy("traj_id").orderBy("wp_idx")
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    p = waypoints.withColumn("seg", F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2))
    return p.withColumn("along", F.coalesce(F.sum("seg").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))


def lookup(waypoints: DataFrame, cells: DataFrame, params: DataFrame, columns: dict[str, str] | None = None, tile: int = 256) -> DataFrame:
    """waypoints (with env, wx, wy) with the bicubic sample of an env's map (cells: env, ix, iy and layers) for each of columns (name: layer; cost: value), and
    inside: whether the place is within the map.

    Waypoints meet tiles with a border of cells, so that neither a map nor an env's waypoints are one task's; all layers are sampled at once. Where a tile has
    many waypoints, they are dealt to as many copies of it as keep a task's share at about WAYPOINTS. A cell that isn't listed is 0, one beyond the map's edge
    repeats the edge. Waypoints of an env without a map keep null samples and inside false; they meet no tile."""
    columns = columns or {"cost": "value"}
    p = waypoints.join(params.select("env", "num_x", "num_y", "start_x", "start_y", "voxel"), "env", "left")
    for c in "xy":
        p = p.withColumn(f"_h{c}", (F.col(f"w{c}") - F.col(f"start_{c}")) / F.col("voxel"))
        p = p.withColumn(f"_t{c}", F.floor(F.least(F.greatest(F.col(f"_h{c}"), F.lit(0.0)), F.col(f"num_{c}") - 1) / tile).cast("int"))
    p = p.drop("start_x", "start_y", "voxel")
    placed = p.where("num_x is not null")
    m = cells.select("env", "ix", "iy", *dict.fromkeys(columns.values()))
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile).cast("int") for d in (-3, 0, 3))))
    m = m.withColumn("_tx", F.explode(near("ix"))).withColumn("_ty", F.explode(near("iy")))
    names = list(waypoints.columns)

    def sample(points: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame(columns=[*names, *columns, "inside"])
        q = points.iloc[0]
        x0, y0 = int(q["_tx"]) * tile - 3, int(q["_ty"]) * tile - 3
        size = tile + 6
        local = tiles[(tiles["ix"] >= x0) & (tiles["ix"] < x0 + size) & (tiles["iy"] >= y0) & (tiles["iy"] < y0 + size)].assign(ix=lambda t: t["ix"] - x0, iy=lambda t: t["iy"] - y0)
        lo, hi = (max(0, -x0), max(0, -y0)), (min(size, int(q["num_x"]) - x0), min(size, int(q["num_y"]) - y0))
        h = points[["_hx", "_hy"]].to_numpy(float)
        out = {c: bicubic(dense(local, size, size, layer)[lo[0] : hi[0], lo[1] : hi[1]], h - (x0 + lo[0], y0 + lo[1])) for c, layer in columns.items()}
        inside = (h[:, 0] > 0) & (h[:, 0] < q["num_x"]) & (h[:, 1] > 0) & (h[:, 1] < q["num_y"])
        return points[names].assign(**out, inside=inside)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in waypoints.schema), *(f"{c} double" for c in columns), "inside boolean"])
    keys = ["env", "_tx", "_ty"]
    shares = sized(stored(placed.groupBy(*keys).agg(F.ceil(F.count("*") / WAYPOINTS).cast("int").alias("_shares")), "tile-shares"))
    placed = placed.join(shares, keys).withColumn("_share", F.pmod(F.xxhash64(*names), F.col("_shares")).cast("int")).drop("_shares")
    m = m.join(shares, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    keys.append("_share")
    out = placed.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(sample, schema)
    out = out.select(*names, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns), "inside")
    return out.unionByName(p.where("num_x is null").select(*names, *(F.lit(None).cast("double").alias(c) for c in columns), F.lit(False).alias("inside")))


def score(waypoints: DataFrame, goals: DataFrame, ahead: float = 2.5, limit: float = 0.5, weights: tuple[float, float, float, float] = (0.5, 1.0, 2.0, 5.0), path: bool = False) -> DataFrame:
    """traj_id, obstacle, height, motion, goal, fear, total; path: the path's length as well.

    waypoints: traj_id, wp_idx, x, y, z and, as given, cost and ground (sampled at the waypoint; absent: 0). goals: traj_id, gx, gy, gz. fear: the largest cost of
    waypoints 1.. whose path length is at most ahead exceeds limit. Without a map (cost or ground null) what needs it, and the total, is null.

    Waypoints are sorted once, by trajectory and in order, without columns that no score needs; windows, the join and sums follow that order."""
    w = path_columns(waypoints.select("traj_id", "wp_idx", *"xyz", *(c for c in ("cost", "ground") if c in waypoints.columns)))
    cost = F.col("cost") if "cost" in w.columns else F.lit(0.0)
    ground = F.col("ground") if "ground" in w.columns else F.lit(0.0)
    n = F.count("*").over(W.partitionBy("traj_id").orderBy("wp_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    w = w.withColumn("n", n).withColumn("c", cost).withColumn("dz", F.abs(F.col("z") - ground)).join(goals, "traj_id")
    far = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    w = w.withColumn("ideal", far / (F.col("n") - 1))
    miss = F.sqrt((F.col("gx") - F.col("last_x")) ** 2 + (F.col("gy") - F.col("last_y")) ** 2 + (F.col("gz") - F.col("last_z")) ** 2)
    s = w.groupBy("traj_id", "gx", "gy", "gz").agg(
        F.sum("c").alias("obstacle"), F.sum("dz").alias("height"), F.sum(F.abs(F.col("ideal") - F.col("seg"))).alias("motion"),
        *(F.max_by(c, "wp_idx").alias(f"last_{c}") for c in "xyz"), F.max(F.when((F.col("wp_idx") > 0) & (F.col("along") <= ahead), F.col("c"))).alias("worst"), F.max("along").alias("path"),
    )
    s = s.withColumn("goal", F.log(miss + 1)).withColumn("fear", F.when(F.col("obstacle").isNotNull(), F.coalesce(F.col("worst") > limit, F.lit(False))))
    total = weights[0] * F.col("obstacle") + weights[1] * F.col("height") + weights[2] * F.coalesce("motion", F.lit(0.0)) + weights[3] * F.col("goal")
    return s.select("traj_id", "obstacle", "height", F.coalesce("motion", F.lit(0.0)).alias("motion"), "goal", "fear", total.alias("total"), *(["path"] if path else []))


def is_forward(waypoints: DataFrame, distance: float, threshold: float) -> DataFrame:
    """traj_id, forward: the first waypoint farther than distance lies within threshold of straight ahead; true if there is none."""
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    first = waypoints.withColumn("d", d).groupBy("traj_id").agg(F.min_by(F.struct("x", "d"), F.when(F.col("d") > distance, F.col("wp_idx"))).alias("p"))
    return first.select("traj_id", F.coalesce(F.col("p.x") / F.col("p.d") > 1 - threshold, F.lit(True)).alias("forward"))


def fear_loss(scored: DataFrame, predicted: str = "p") -> DataFrame:
    """Mean cross-entropy of predicted fear, logarithms at least -100."""
    log = lambda x: F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(-100.0)
    p = F.col(predicted)
    return scored.agg(F.avg(-F.when(F.col("fear"), log(p)).otherwise(log(1 - p))).alias("loss"))


def score_summary(scores: DataFrame) -> DataFrame:
    """micro: mean of batch means; macro: mean over envs of the mean over their batches. scores: env, batch, total."""
    b = scores.groupBy("env", "batch").agg(F.avg("total").alias("loss"))
    e = b.groupBy("env").agg(F.avg("loss").alias("loss"), F.sum("loss").alias("s"), F.count("*").alias("n"))
    return e.agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg("loss").alias("macro"))


def best_so_far(log: DataFrame) -> DataFrame:
    """best validation loss before each epoch's row, and whether the row is strictly lower."""
    w = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("best", F.min("val_loss").over(w)).withColumn("saved", F.coalesce(F.col("val_loss") < F.col("best"), F.lit(True)))


def moving_average(series: DataFrame, window: int) -> DataFrame:
    """smooth: weights 1 .. window over their sum, the newest heaviest; before the start stands the first value."""
    w = W.partitionBy("run").orderBy("epoch")
    first = F.first("value").over(w)
    total = sum((window - i) * F.coalesce(F.lag("value", i).over(w), first) for i in range(window))
    return series.withColumn("smooth", total / (window * (window + 1) / 2))


def plateau_steps(losses: list[float], state: list, factor: float = 0.5, patience: int = 4, floor: float = 1e-6, threshold: float = 1e-4) -> tuple[list[tuple[float, bool]], list]:
    """(learning rate after the epoch, stop) of each loss, and the state [best, bad epochs, rate, stop]: no relative improvement for more than patience epochs
    lowers the rate; where it can't drop by more than 1e-8, it stays and training stops."""
    best, bad, lr, stop = state
    out = []
    for x in losses:
        best, bad = (x, 0) if best is None or x < best * (1 - threshold) else (best, bad + 1)
        if bad > patience:
            new, bad = max(lr * factor, floor), 0
            lr, stop = (new, stop) if lr - new > 1e-8 else (lr, True)
        out.append((lr, stop))
    return out, [best, bad, lr, stop]


def replay_schedule(log: DataFrame, lr: float, parts: int | None = None, **more) -> DataFrame:
    """run, epoch, lr, stop: a fold in order of epochs; rows after a stop keep its rate."""

    def fold(rows: pd.DataFrame, state: list) -> tuple[dict, list]:
        steps, state = plateau_steps([float(x) for x in rows["val_loss"]], state, **more)
        return {"lr": np.array([s[0] for s in steps]), "stop": np.array([s[1] for s in steps], bool)}, state

    return ordered_fold(log.select("run", "epoch", "val_loss"), "run", ["epoch"], fold, [None, 0, lr, False], "lr double, stop boolean", ["run", "epoch"], parts=parts)


def spectrum(image: np.ndarray) -> np.ndarray:
    """Of images (.., channels, height, width), for circular correlations."""
    return np.fft.rfft2(image)


def correlations(x: np.ndarray, y: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Circular correlation of spectra x and y, summed over channels: at (i, j) the product of x with y moved back by i rows and j columns."""
    return np.fft.irfft2((np.conj(x) * y).sum(-3), s=shape)


def best_shift(surface: np.ndarray, scale: float) -> tuple[float, int, int]:
    """The largest value of a correlation surface over scale (the product of both norms; 0 gives 0), clamped to -1..1, and its place."""
    i, j = np.unravel_index(int(np.argmax(surface)), surface.shape)
    return (float(np.clip(surface[i, j] / scale, -1, 1)) if scale > 0 else 0.0), int(i), int(j)
