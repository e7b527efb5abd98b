"""Cost maps of environments: layers, distances, components and scores of dense grids, by tiles and strips (tiles.py), so that no task holds a map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from . import tiles as T
from .tables import sized, stored

OBSTACLE, FREE, CORRIDOR = 1, 2, 4
OCCUPIED, SEEN = 1, 2
_FLAG = {"mask": "u1"}


def dense(cells: pd.DataFrame, nx: int, ny: int, column: str = "value") -> np.ndarray:
    out = np.zeros((nx, ny))
    out[cells["ix"], cells["iy"]] = cells[column] if column in cells else 1.0
    return out


def normalised_cells(cells: DataFrame, params: DataFrame, column: str = "value") -> DataFrame:
    """env, row, col, value of every listed cell as a pixel of an image: finite values to 0..255 between the env's least and largest, cut off, others and those of a
    constant map 0; transposed and upside down, so that row num_y - 1 - iy holds column ix."""
    ok = ~F.isnan(column) & (F.abs(column) < float("inf"))
    ends = stored(cells.groupBy("env").agg(F.min(F.when(ok, F.col(column))).alias("_lo"), F.max(F.when(ok, F.col(column))).alias("_hi")), "map-ends")
    x = cells.join(sized(ends), "env").join(params.select("env", "num_y"), "env")
    scaled = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255
    value = F.when(ok & (F.col("_hi") > F.col("_lo")), scaled).otherwise(0.0).cast("int")
    return x.select("env", (F.col("num_y") - 1 - F.col("iy")).alias("row"), F.col("ix").alias("col"), value.alias("value"))


def layer_stats(cells: DataFrame) -> DataFrame:
    """env, occupied, free, unknown cells, the largest and the mean cost of maps (value, state)."""
    n = lambda k: F.count_if(F.col("state") == k)
    return cells.groupBy("env").agg(n(2).alias("occupied"), n(1).alias("free"), n(0).alias("unknown"), F.max("value").alias("max_cost"), F.avg("value").alias("mean_cost"))


def bicubic(grid: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values at map coordinates h (n, 2) from 16 cells each (A = -0.75), edges clamped, cell centres at half units."""
    a = -0.75
    p = h - 0.5
    base = np.floor(p).astype(int)
    t = p - base
    w = np.empty((4, *t.shape))
    for i, d in enumerate((t + 1, t, 1 - t, 2 - t)):
        w[i] = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
    out = np.zeros(len(h))
    for i in range(4):
        for j in range(4):
            out += w[i, :, 0] * w[j, :, 1] * grid[np.clip(base[:, 0] + i - 1, 0, grid.shape[0] - 1), np.clip(base[:, 1] + j - 1, 0, grid.shape[1] - 1)]
    return out


def _stored_params(params: DataFrame) -> tuple[DataFrame, float]:
    """params, planned once, and the least voxel (1 without any map)."""
    p = stored(params.select("env", "num_x", "num_y", "voxel"), "map-params")
    return p, float(p.agg(F.min("voxel")).first()[0] or 1.0)


def _marked(cells: DataFrame, mask: Column) -> DataFrame:
    """env, ix, iy, mask: the flags of a cell's rows together."""
    return cells.select("env", "ix", "iy", mask.cast("int").alias("mask")).groupBy("env", "ix", "iy").agg(F.bit_or("mask").alias("mask"))


def _within(zero: np.ndarray, region: T.Region, cells: float) -> np.ndarray:
    """Whether a core cell is within so many cells of one of zero, which holds all the region's cells; the halo must be as wide."""
    d2 = T.squared(T.along_x(zero), region._replace(num_x=zero.shape[0], num_y=zero.shape[1]))
    return region.own(d2 <= cells * cells + 1e-9) if zero.any() else np.zeros_like(region.own(zero))


def surface_map(cells: DataFrame, params: DataFrame, robot: float = 0.3, sigma: float = 2.5, reassign: float = 0.3, least_free: float = 0.7, side: int = T.SIDE) -> DataFrame:
    """env, ix, iy, value from rows env, ix, iy, layer ('obstacle', 'free', 'corridor').

    Obstacles, spread by the robot's size, and the corridor decide the free space; its distance to free cells, smoothed by sigma, in logarithms. The layers are
    smoothed tile by tile, their maxima are sums over tiles, distances run over strips, first along x, then along y. An env without a free cell has distance 0."""
    params, voxel = _stored_params(params)
    flag = F.when(F.col("layer") == "obstacle", OBSTACLE).when(F.col("layer") == "free", FREE).otherwise(CORRIDOR)

    def layers(region, a):
        mask = a["mask"]
        obstacle = T.smooth((mask & OBSTACLE > 0).astype(float), region, robot / region.voxel)
        blocked = T.smooth((mask & FREE == 0).astype(float), region, sigma)
        return {"obstacle": obstacle, "blocked": blocked, "way": region.own(mask & CORRIDOR > 0), "most_obstacle": obstacle.max(), "most_blocked": blocked.max()}

    def free_cells(region, a):
        obstacle, blocked = a["obstacle"] / (region.more["top_obstacle"] + 1e-5), a["blocked"]
        if region.more["top_blocked"] > 0:
            blocked = blocked / region.more["top_blocked"]
        way = a["way"] > 0
        taken = ((blocked >= least_free) & (blocked > 0)) | (np.where(way, 0.0, obstacle) > reassign)
        return {"dx": T.along_x(~taken | way)}

    def far(region, a):
        d2 = T.squared(a["dx"], region)
        return {"d": np.where(d2 >= T.far_squared(region), 0.0, np.sqrt(d2))}

    square, x, y = T.Shape("tile", max(T.reach(robot / voxel), T.reach(sigma))), T.Shape("x"), T.Shape("y")
    smoothed = {"obstacle": "f8", "blocked": "f8", "way": "u1"}
    tops = ("most_obstacle", "most_blocked")
    one = T.stage(T.address(_marked(cells, flag), params, square, "mask", side), square, _FLAG, layers, x, smoothed, tops, side=side)
    one = stored(one, "map-layers")
    most = stored(one.groupBy("env").agg(F.max("most_obstacle").alias("top_obstacle"), F.max("most_blocked").alias("top_blocked")), "map-tops")
    two = T.stage(one.join(sized(most), "env"), x, smoothed, free_cells, y, {"dx": "i4"}, more=("top_obstacle", "top_blocked"), side=side)
    wide = T.Shape("tile", T.reach(sigma))
    three = T.stage(two, y, {"dx": "i4"}, far, wide, {"d": "f8"}, side=side)
    return T.to_cells(three, wide, {"d": "f8"}, lambda region, a: {"value": np.log(T.smooth(a["d"], region, sigma) + 1.00001)}, "value double", side=side)


def logistic_cost(d: np.ndarray, radius: float, softness: float, power: float = 1.0) -> np.ndarray:
    """Cost by the distance to an occupied cell in metres."""
    if softness <= 0:
        return (d <= radius).astype(float)
    return (1 / (1 + np.exp(np.clip((d - radius) / softness, -60, 60)))) ** power


def raycast_map(votes: DataFrame, params: DataFrame, radius: float, softness: float, unknown_cost: float, least: int, sigma: float = 0.0, inflation: float = 0.0, power: float = 1.0, reach: float = 0.0, side: int = T.SIDE) -> DataFrame:
    """env, ix, iy, value, state from votes (occupied, free): occupied cells farther than reach metres from free evidence go (reach 0, or an env without any: none),
    then small components, the rest grow by inflation metres, clearance cost, unknown cells cost at least unknown_cost, smoothed, 0..1.

    state: 2 occupied, 1 free, 0 unknown. An env with no occupied cell has no clearance cost; an env without votes is unknown throughout."""
    params, voxel = _stored_params(params)
    marks = votes.where("occupied or free").select("env", "ix", "iy", (F.col("occupied").cast("int") * OCCUPIED + F.col("free").cast("int") * SEEN).alias("mask"))
    marks = stored(marks, "map-votes")
    if reach > 0:
        marks = _thinned(marks, params, reach, voxel, side)
    if least > 1:
        parts = component_cells(marks.where(F.col("mask").bitwiseAND(OCCUPIED) > 0), params, side)
        small = parts.where(F.col("size") < least).select("env", "ix", "iy", F.lit(True).alias("small"))
        marks = marks.join(small, ["env", "ix", "iy"], "left").withColumn("mask", F.when(F.col("small"), F.col("mask").bitwiseAND(SEEN)).otherwise(F.col("mask"))).drop("small")
    cells = math.ceil(inflation / voxel) if inflation > 0 else 0

    def grow(region, a):
        mask, grown = a["mask"], math.ceil(inflation / region.voxel)
        return {"mask": np.where(_within(mask & OCCUPIED > 0, region, grown), OCCUPIED, 0) | region.own(mask & SEEN)}

    square, x, y, wide = T.Shape("tile", cells), T.Shape("x"), T.Shape("y"), T.Shape("tile", T.reach(sigma))
    pieces = T.address(marks, params, square if cells else x, "mask", side)
    if cells:
        pieces = T.stage(pieces, square, _FLAG, grow, x, _FLAG, side=side)
    both = {"dx": "i4", "mask": "u1"}
    pieces = T.stage(pieces, x, _FLAG, lambda region, a: {"dx": T.along_x(a["mask"] & OCCUPIED > 0), "mask": a["mask"]}, y, both, side=side)

    def costs(region, a):
        occupied = a["mask"] & OCCUPIED > 0
        d2 = T.squared(a["dx"], region)
        near = logistic_cost(np.sqrt(d2) * region.voxel, radius, softness, power) if radius > 0 else np.zeros(d2.shape)
        near = np.where(occupied, 1.0, np.where(d2 >= T.far_squared(region), 0.0, near))
        return {"cost": np.maximum(np.where(a["mask"] > 0, 0.0, unknown_cost), near), "mask": a["mask"]}

    def finish(region, a):
        mask = region.own(a["mask"])
        return {"value": np.clip(T.smooth(a["cost"], region, sigma), 0, 1), "state": np.where(mask & OCCUPIED > 0, 2, np.where(mask > 0, 1, 0)).astype(np.int32)}

    cost = {"cost": "f8", "mask": "u1"}
    pieces = T.stage(pieces, y, both, costs, wide, cost, side=side)
    return T.to_cells(pieces, wide, cost, finish, "value double, state int", side=side)


def _thinned(marks: DataFrame, params: DataFrame, reach: float, voxel: float, side: int) -> DataFrame:
    """marks without occupied cells farther than reach metres from free evidence; envs without any keep theirs."""
    seen = marks.where(F.col("mask").bitwiseAND(SEEN) > 0).select("env").distinct().withColumn("any", F.lit(True))
    p = stored(params.join(seen, "env", "left").withColumn("any", F.coalesce("any", F.lit(False))), "map-seen")
    square = T.Shape("tile", int(reach / voxel) + 1)
    some = T.address(marks.join(p.where("any").select("env"), "env", "left_semi"), p.where("any"), square, "mask", side)

    def near(region, a):
        mask = a["mask"]
        return {"mask": np.where(_within(mask & SEEN > 0, region, reach / region.voxel), region.own(mask), region.own(mask & SEEN)).astype(np.int32)}

    thinned = T.to_cells(some, square, _FLAG, near, "mask int", side=side, where=True)
    return stored(thinned.unionByName(marks.join(p.where("any").select("env"), "env", "left_anti")), "map-thinned")


def gaussian_cells(cells: DataFrame, params: DataFrame, sigma: float, side: int = T.SIDE) -> DataFrame:
    """env, ix, iy, value of every cell: cells (env, ix, iy, value; a row a cell, others 0) smoothed."""
    params, _ = _stored_params(params)
    square = T.Shape("tile", T.reach(sigma))
    pieces = T.address(cells.select("env", "ix", "iy", F.col("value").cast("double").alias("value")), params, square, "value", side)
    return T.to_cells(pieces, square, {"value": "f8"}, lambda region, a: {"value": T.smooth(a["value"], region, sigma)}, "value double", side=side)


def distance_cells(cells: DataFrame, params: DataFrame, side: int = T.SIDE) -> DataFrame:
    """Distance of each cell to the nearest of cells, in cells; an env without any has no row."""
    params, _ = _stored_params(params)
    x, y = T.Shape("x"), T.Shape("y")
    marks = cells.select("env", "ix", "iy").distinct().withColumn("mask", F.lit(1))
    some = params.join(marks.select("env").distinct(), "env", "left_semi")
    pieces = T.stage(T.address(marks, some, x, "mask", side), x, _FLAG, lambda region, a: {"dx": T.along_x(a["mask"] > 0)}, y, {"dx": "i4"}, side=side)
    return T.to_cells(pieces, y, {"dx": "i4"}, lambda region, a: {"value": np.sqrt(T.squared(a["dx"], region))}, "value double", side=side)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1) of 4-connected cells, by the least index each component's cells pass on."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
            for t, s in ((new[a], new[b]), (new[:, a], new[:, b])):
                both = (t > 0) & (s > 0)
                t[both] = np.minimum(t[both], s[both])
        jump = np.where(new > 0, new.reshape(-1)[np.maximum(new - 1, 0)], 0)
        if (jump == label).all():
            return label
        label = jump


def component_cells(cells: DataFrame, params: DataFrame, side: int = T.SIDE) -> DataFrame:
    """env, ix, iy, label, size of occupied cells; the label is the least ix * num_y + iy of its 4-connected component.

    Tiles label their own cells; parts that touch across a border are links, merged in rounds over parts, not cells."""
    params, _ = _stored_params(params)
    square = T.Shape("tile")

    def label(region, a):
        own = components(a["mask"] > 0)
        ix, iy = np.indices(own.shape)
        # the first cell of a part, in the tile's order, is its first in the map's as well
        first = np.maximum(own - 1, 0)
        part = (first // own.shape[1] + region.x0) * region.num_y + first % own.shape[1] + region.y0
        edge = (ix == 0) | (iy == 0) | (ix == own.shape[0] - 1) | (iy == own.shape[1] - 1)
        return {"occupied": own > 0, "part": part.astype(np.int64), "edge": edge}

    marks = cells.select("env", "ix", "iy").distinct().withColumn("mask", F.lit(1))
    some = params.join(marks.select("env").distinct(), "env", "left_semi")
    parts = T.to_cells(T.address(marks, some, square, "mask", side), square, _FLAG, label, "occupied boolean, part long, edge boolean", side=side, where=True)
    parts = stored(parts.drop("occupied"), "map-parts")
    edge = parts.where("edge").select("env", "ix", "iy", "part")
    ahead = edge.select("env", F.explode(F.array(F.struct((F.col("ix") + 1).alias("ix"), "iy"), F.struct("ix", (F.col("iy") + 1).alias("iy")))).alias("c"), F.col("part").alias("a")).select("env", "c.*", "a")
    links = ahead.join(edge, ["env", "ix", "iy"]).where("a <> part").select("env", "a", F.col("part").alias("b")).distinct()
    root = least_linked(links)
    merged = parts.groupBy("env", "part").agg(F.count("*").alias("n")).join(root.withColumnRenamed("node", "part"), ["env", "part"], "left").withColumn("label", F.coalesce("root", "part"))
    sizes = stored(merged.select("env", "part", "label", F.sum("n").over(W.partitionBy("env", "label")).alias("size")), "map-sizes")
    return parts.join(sized(sizes), ["env", "part"]).select("env", "ix", "iy", "label", "size")


def least_linked(links: DataFrame, rounds: int = 60) -> DataFrame:
    """env, node, root for every end of links (env, a, b): the least node that links reach.

    Each round a node takes the least parent of its neighbours' parents and of its own, and hands it on to the parent it had: trees halve their depth while
    roots hook onto smaller ones. Rounds grow with the logarithm of the longest chain; it is an error if `rounds` aren't enough."""
    both = stored(links.select("env", F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select("env", F.col("b").alias("node"), F.col("a").alias("to"))), "link-ends")
    now = stored(both.groupBy("env", "node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "link-roots")
    if now.isEmpty():
        return now
    for _ in range(rounds):
        up = now.select("env", F.col("node").alias("root"), F.col("root").alias("above"))
        lifted = stored(now.join(sized(up), ["env", "root"]).select("env", "node", "root", "above"), "link-lifted")
        seen = both.join(sized(lifted.select("env", F.col("node").alias("to"), "above")), ["env", "to"]).groupBy("env", "node").agg(F.min("above").alias("seen"))
        offer = lifted.join(seen, ["env", "node"]).withColumn("best", F.least("above", "seen"))
        hooks = offer.select("env", "node", "best").unionByName(offer.select("env", F.col("root").alias("node"), "best"))
        new = stored(hooks.groupBy("env", "node").agg(F.min("best").alias("root")), "link-roots")
        changed = new.join(now.select("env", "node", F.col("root").alias("old")), ["env", "node"]).where("root < old").limit(1).count()
        now = new
        if not changed:
            return now
    raise RuntimeError(f"links were not merged within {rounds} rounds")
