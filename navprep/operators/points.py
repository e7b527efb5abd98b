"""Points, clouds and cells: projections, filters and aggregates over (env, frame_id, x, y, z) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g
from .tables import sized, stored


def range_filter(points: DataFrame, max_range: float | None, origin: tuple[Column, Column, Column] | None = None) -> DataFrame:
    if not max_range or max_range <= 0:
        return points
    d = [F.col(c) - o for c, o in zip("xyz", origin or (F.lit(0.0),) * 3)]
    return points.where(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= max_range)


def classify_terrain(points: DataFrame, ground_z: Column, ground_height: float, robot_height: float) -> DataFrame:
    """terrain: 'obstacle' for z in (g + h, g + 1.5 robot), 'free' for z in (g - h, g + h), open ends; other points go."""
    z = F.col("z") - ground_z
    kind = F.when((z > ground_height) & (z < 1.5 * robot_height), "obstacle").when((z < ground_height) & (z > -ground_height), "free")
    return points.withColumn("terrain", kind).where("terrain is not null")


def in_box(pose: Column, box: tuple[float, float, float, float, float, float]) -> Column:
    """Whether the point x, y, z is inside the closed box (x0, x1, y0, y1, z0, z1) of the sensor's frame."""
    v = g.untransform(pose, (F.col("x"), F.col("y"), F.col("z")))
    inside = F.lit(True)
    for c, lo, hi in zip(v, box[::2], box[1::2]):
        inside = inside & (c >= lo) & (c <= hi)
    return inside


def filter_self_points(points: DataFrame, pose: Column, box: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Without the points in the box."""
    return points.where(~in_box(pose, box))


def scan_stats(points: DataFrame, pose: Column, box: tuple[float, float, float, float, float, float]) -> DataFrame:
    """env, scans, min_cloud_points, max_cloud_points (of a scan, env and frame_id, without the box), removed_self_points, mean_removed, max_removed (of a scan).
    Two levels of sums: a scan is never gathered."""
    inside = in_box(pose, box)
    scans = points.groupBy("env", "frame_id").agg(F.count_if(~inside).alias("kept"), F.count_if(inside).alias("removed"))
    return scans.groupBy("env").agg(F.count("*").alias("scans"), F.min("kept").alias("min_cloud_points"), F.max("kept").alias("max_cloud_points"), F.sum("removed").alias("removed_self_points"), F.avg("removed").alias("mean_removed"), F.max("removed").alias("max_removed"))


def select_frames(frames: DataFrame, start: int = 0, count: int | None = None, stride: int = 1) -> DataFrame:
    f = frames.where((F.col("frame_id") >= start) & ((F.col("frame_id") - start) % stride == 0))
    return f if count is None else f.where(F.col("frame_id") < start + count)


def to_cells(points: DataFrame, params: DataFrame) -> DataFrame:
    """ix, iy by half-even rounding of (p - start) / voxel, and inside (0 <= i < n). params is a row for each env; it is joined, and broadcast if Spark knows it to be small."""
    p = points.join(params, "env")
    i = lambda c: F.rint((F.col(c) - F.col(f"start_{c}")) / F.col("voxel")).cast("int")
    p = p.withColumn("ix", i("x")).withColumn("iy", i("y"))
    return p.withColumn("inside", (F.col("ix") >= 0) & (F.col("ix") < F.col("num_x")) & (F.col("iy") >= 0) & (F.col("iy") < F.col("num_y")))


def to_world(points: DataFrame, mode: str, pose: Column | None = None, extrinsic: Column | None = None) -> DataFrame:
    v = (F.col("x"), F.col("y"), F.col("z"))
    if mode == "world":
        return points
    if mode == "base_to_world":
        v = g.transform(pose, v)
    elif mode == "sensor_to_world":
        v = g.transform(g.compose(pose, extrinsic), v)
    else:
        raise ValueError(f"unknown mode {mode}")
    return points.withColumns(dict(zip("xyz", v)))


def back_project(pixels: DataFrame, fx: Column, fy: Column, cx: Column, cy: Column, camera: Column) -> DataFrame:
    """x, y, z in the world of pixels (u, v, depth): z forward, x right, y down in the camera."""
    d = F.col("depth")
    x, y, z = g.transform(camera, ((F.col("u") - cx) / fx * d, (F.col("v") - cy) / fy * d, d))
    return pixels.withColumns({"x": x, "y": y, "z": z})


def mean_height(poses: DataFrame) -> DataFrame:
    return poses.groupBy("env").agg(F.avg("z").alias("mean_z"))


def voxel_downsample(points: DataFrame, size: float, near: str | None = None) -> DataFrame:
    """The mean point of each voxel; the lattice starts half a voxel below an env's least coordinates. Partial sums meet by voxel, not by env: the least
    coordinates, a row an env, are stored first, so that points aren't shuffled by env to meet them. near: a column that says which rows' voxels are wanted."""
    low = stored(points.groupBy("env").agg(*(F.min(c).alias(f"min_{c}") for c in "xyz")), "voxel-lows")
    k = lambda c: F.floor((F.col(c) - F.col(f"min_{c}") + size / 2) / size).alias(f"k{c}")
    p = (points.where(near) if near else points).join(sized(low), "env").select("env", "x", "y", "z", k("x"), k("y"), k("z"))
    return p.groupBy("env", "kx", "ky", "kz").agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def map_bounds(obstacles: DataFrame, voxel: float, clear: float) -> DataFrame:
    """A params row for each env: extent of the points and clear on each side, in tens of cells, centred."""
    b = obstacles.groupBy("env").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    for c in "xy":
        lo, hi = F.col(f"lo_{c}") - clear, F.col(f"hi_{c}") + clear
        n = (F.ceil((hi - lo) / voxel / 10) * 10).cast("int")
        b = b.withColumn(f"num_{c}", n).withColumn(f"start_{c}", (lo + hi) / 2 - F.col(f"num_{c}") / 2 * voxel)
    return b.select("env", "num_x", "num_y", "start_x", "start_y", F.lit(voxel).alias("voxel"), F.lit(clear).alias("clear_dist"))


def raycast_bounds(points: DataFrame, cameras: DataFrame, voxel: float, clear: float) -> DataFrame:
    """As map_bounds over points and camera centres, at least 10 cells a side."""
    b = map_bounds(points.select("env", "x", "y").unionByName(cameras.select("env", "x", "y")), voxel, clear)
    for c in "xy":
        n = F.greatest(F.col(f"num_{c}"), F.lit(10))
        b = b.withColumn(f"start_{c}", F.col(f"start_{c}") - (n - F.col(f"num_{c}")) / 2 * voxel).withColumn(f"num_{c}", n)
    return b


def occupied_cells(cells: DataFrame) -> DataFrame:
    return cells.where("inside").select("env", "ix", "iy").distinct()


def hit_votes(cells: DataFrame) -> DataFrame:
    return cells.where("inside").groupBy("env", "ix", "iy").agg(F.count("*").alias("hit_votes"))


def free_votes(ray_cells: DataFrame) -> DataFrame:
    """At most one vote of a frame for a cell."""
    return ray_cells.select("env", "frame_id", "ix", "iy").distinct().groupBy("env", "ix", "iy").agg(F.count("*").alias("free_votes"))


def ray_cells(rays: DataFrame, margin: int) -> DataFrame:
    """Cells of the 8-connected line from (cx, cy) towards (ix, iy), shortened by margin cells; rays no longer than margin + 1 go. Endpoints of a frame count once.

    Step k of the longer axis moves ceil(k * minor / major - 0.5) along the other, from the end of smaller first coordinate on."""
    r = rays.select("env", "frame_id", "cx", "cy", "ix", "iy").distinct()
    length = F.sqrt((F.col("ix") - F.col("cx")) ** 2 + (F.col("iy") - F.col("cy")) ** 2)
    r = r.withColumn("len", length).where(F.col("len") > margin + 1)
    end = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * (F.col("len") - margin) / F.col("len")).cast("int")
    r = r.withColumn("ex", end("cx", "ix")).withColumn("ey", end("cy", "iy"))
    swap = F.col("ey") < F.col("cy")  # an image's first coordinate is iy
    r = r.select("env", "frame_id", *(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for a, b, n in (("cx", "ex", "x0"), ("cy", "ey", "y0"), ("ex", "cx", "x1"), ("ey", "cy", "y1"))))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    r = r.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    step = lambda d: F.when(F.col("n") == 0, F.lit(0)).when(F.abs(d) == F.col("n"), F.signum(d) * F.col("k")).otherwise(F.signum(d) * F.ceil(F.col("k") * F.abs(d) / F.col("n") - 0.5))
    return r.select("env", "frame_id", (F.col("x0") + step(dx)).cast("int").alias("ix"), (F.col("y0") + step(dy)).cast("int").alias("iy"))


def vote_occupancy(hits: DataFrame, free: DataFrame, min_hits: int, ratio: float, min_free: int) -> DataFrame:
    return occupancy(hits.join(free, ["env", "ix", "iy"], "full_outer").na.fill(0, ["hit_votes", "free_votes"]), min_hits, ratio, min_free)


def occupancy(votes: DataFrame, min_hits: int, ratio: float, min_free: int) -> DataFrame:
    """votes (env, ix, iy, hit_votes, free_votes) with ratio, occupied and free."""
    v = votes.withColumn("ratio", F.col("hit_votes") / (F.col("hit_votes") + F.col("free_votes") + 1e-6))
    return v.withColumn("occupied", (F.col("hit_votes") >= min_hits) & (F.col("ratio") >= ratio)).withColumn("free", F.col("free_votes") >= min_free)


def carve(votes: DataFrame, min_free: int, max_ratio: float) -> DataFrame:
    """Clears occupied cells that many rays crossed; off when min_free <= 0."""
    if min_free <= 0:
        return votes
    return votes.withColumn("occupied", F.col("occupied") & ~((F.col("free_votes") >= min_free) & (F.col("ratio") <= max_ratio)))


def _disc(cells: int, reach: float) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-cells, cells + 1) for j in range(-cells, cells + 1) if (i * i + j * j) ** 0.5 <= reach]


def _spread(cells: DataFrame, disc: list[tuple[int, int]]) -> DataFrame:
    d = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc)))
    return cells.select("env", "ix", "iy", d.alias("d")).select("env", (F.col("ix") + F.col("d.i")).alias("ix"), (F.col("iy") + F.col("d.j")).alias("iy")).distinct()


def inflate(cells: DataFrame, params: DataFrame, radius: float, voxel: float) -> DataFrame:
    """The cells within ceil(radius / voxel) cells of occupied ones, inside the map."""
    n = -(-radius // voxel)
    out = _spread(cells, _disc(int(n), n)).join(params.select("env", "num_x", "num_y"), "env")
    return out.where("ix >= 0 and ix < num_x and iy >= 0 and iy < num_y").select("env", "ix", "iy")


def corridor(poses: DataFrame, params: DataFrame, radius: float, voxel: float) -> DataFrame:
    """Cells within radius metres of a pose's cell, inside the map."""
    c = to_cells(poses, params).select("env", "ix", "iy").distinct()
    out = _spread(c, _disc(int(radius / voxel) + 1, radius / voxel)).join(params.select("env", "num_x", "num_y"), "env")
    return out.where("ix >= 0 and ix < num_x and iy >= 0 and iy < num_y").select("env", "ix", "iy")


def thin_to_surface(occupied: DataFrame, free: DataFrame, reach: float, voxel: float) -> DataFrame:
    """Occupied cells within reach metres of free evidence; unchanged where reach <= 0 or an env has no free cell."""
    if reach <= 0:
        return occupied
    near = _spread(free, _disc(int(reach / voxel) + 1, reach / voxel))
    without = occupied.join(free.select("env").distinct(), "env", "left_anti")
    return occupied.join(near, ["env", "ix", "iy"], "left_semi").unionByName(without)


def raycast_stats(votes: DataFrame) -> DataFrame:
    return votes.groupBy("env").agg(F.count_if("occupied").alias("occupied"), F.count_if("free").alias("free"), F.max("hit_votes").alias("max_hits"), F.max("free_votes").alias("max_free"), F.sum("hit_votes").alias("hits"))


def sample_cloud(points: DataFrame, target: int, frames: int = 200) -> DataFrame:
    """Each frame thinned to every (n // target + 1)-th point, of the first frames that have points."""
    w = W.partitionBy("env", "frame_id")
    p = points.withColumn("k", F.row_number().over(w.orderBy("x", "y", "z")) - 1).withColumn("n", F.count("*").over(w))
    first = points.select("env", "frame_id").distinct().withColumn("f", F.row_number().over(W.partitionBy("env").orderBy("frame_id"))).where(F.col("f") <= frames).drop("f")
    return p.where(F.col("k") % (F.floor(F.col("n") / target) + 1) == 0).drop("k", "n").join(first, ["env", "frame_id"], "left_semi")
