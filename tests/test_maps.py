"""Maps from each source on small scenes."""

import math

import numpy as np
import pytest
import whole_maps

from navprep.jobs import maps
from navprep.jobs.catalog import QUERIES
from navprep.jobs.settings import resolve
from navprep.operators import rays

POSE = "env string, frame_id long, x double, y double, z double, qx double, qy double, qz double, qw double"
FRAME = "env string, frame_id long, height int, width int, data array<int>, fx double, fy double, cx double, cy double"


def dense(rows, n, m):
    out = np.full((n, m), np.nan)
    for r in rows:
        out[r["ix"], r["iy"]] = r["value"]
    return out


def test_scans_in_world_give_the_layers_map(spark):
    rng = np.random.default_rng(3)
    pts = np.c_[rng.uniform(-3, 3, (300, 2)), rng.choice([0.0, 0.5], 300)]
    lone = [[40.0, 40.0, 0.5]]  # an outlier among obstacles: it neither stands in the map nor widens it
    scans = spark.createDataFrame([("a", 0, *map(float, p)) for p in [*pts, *lone]], "env string, frame_id long, x double, y double, z double")
    poses = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.4, 0.0, 0.0, 0.0, 1.0)], POSE)
    s = resolve({"cloud_source": "point_cloud", "scan_transform_mode": "world", "voxel_size": 0.2, "max_scan_range": 50.0, "trajectory_clear_radius": 0.5})
    s["cloud_voxel"] = 1e-4  # each point is its own voxel
    cells, params = maps.build_map(s, poses, scans=scans)
    p = params.first()
    at = lambda q: np.rint((q[:, :2] - [p["start_x"], p["start_y"]]) / 0.2).astype(int)
    n, m = p["num_x"], p["num_y"]
    layer = {k: np.zeros((n, m), bool) for k in "ofc"}
    for k, q in (("o", pts[pts[:, 2] > 0.25]), ("f", pts[pts[:, 2] < 0.25])):
        for i, j in at(q):
            if 0 <= i < n and 0 <= j < m:
                layer[k][i, j] = True
    c = at(np.zeros((1, 3)))[0]
    i, j = np.indices((n, m))
    layer["c"] = np.hypot(i - c[0], j - c[1]) * 0.2 <= 0.5
    want = whole_maps.surface_layers(layer["o"], layer["f"], layer["c"], 0.2, s["robot_size"])
    assert np.allclose(dense(cells.collect(), n, m), want)
    assert want.max() > 0


def test_rays_free_the_way_to_a_wall(spark):
    # an optical frame that looks along x: a wall at 2 m
    poses = spark.createDataFrame([("a", k, 0.0, 0.0, 0.5, -0.5, 0.5, -0.5, 0.5) for k in (0, 1)], POSE)
    frames = spark.createDataFrame([("a", k, 9, 9, [2000] * 81, 4.0, 4.0, 4.0, 4.0) for k in (3, 7)], FRAME)
    s = resolve({"cloud_source": "raycast_2d", "voxel_size": 0.1, "is_flat_ground": False, "depth_raycast_ray_pixel_stride": 1, "depth_raycast_hit_pixel_stride": 1, "map_sigma_smooth": 0.0, "robot_size": 0.15})
    cells, params = maps.build_map(s, poses, frames)
    p = params.first()
    grid = dense(cells.collect(), p["num_x"], p["num_y"])
    cell = lambda x, y: (round((x - p["start_x"]) / 0.1), round((y - p["start_y"]) / 0.1))
    assert grid[cell(2.0, 0.0)] == 1 and grid[cell(2.0, 1.0)] == 1
    assert grid[cell(1.0, 0.0)] < 0.01 and grid[cell(1.0, 0.5)] < 0.01
    assert grid[cell(2.5, 0.0)] == 1 and grid[cell(0.5, -1.5)] == 1  # never seen
    grown = dense(maps.build_map(s | {"depth_raycast_occupancy_inflation_radius": 0.2}, poses, frames)[0].collect(), p["num_x"], p["num_y"])
    assert grown[cell(1.8, 0.0)] == 1 and grid[cell(1.8, 0.0)] < 1


def test_unknown_sources_are_errors(spark):
    with pytest.raises(ValueError):
        maps.build_map(resolve({"cloud_source": "sonar"}), spark.createDataFrame([], POSE))


def thick_line(a, b, thickness):
    """Cells of the line by its closed form, step by step, and all within half the thickness of one."""
    if b[1] < a[1]:
        a, b = b, a
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    thin = set()
    for k in range(n + 1):
        at = []
        for c in (0, 1):
            d = b[c] - a[c]
            at.append(a[c] + (d > 0) * 0 + (0 if n == 0 else (k if abs(d) == n else math.ceil(k * abs(d) / n - 0.5)) * (1 if d > 0 else -1 if d < 0 else 0)))
        thin.add(tuple(at))
    if thickness <= 1:
        return thin
    r = range(-thickness, thickness + 1)
    return {(x + i, y + j) for x, y in thin for i in r for j in r if math.hypot(i, j) <= thickness / 2}


@pytest.mark.parametrize("thickness", [1, 2, 3, 5])
def test_rays_cell_by_cell(thickness):
    rng = np.random.default_rng(4)
    for margin in (1, 3):
        start = (20, 12)
        ends = rng.integers(0, (40, 30), (60, 2))
        want = set()
        for e in {tuple(e) for e in ends.tolist()}:
            length = math.hypot(e[0] - start[0], e[1] - start[1])
            if length > margin + 1:
                clear = tuple(round(s + (c - s) * (length - margin) / length) for s, c in zip(start, e))
                want |= {(x, y) for x, y in thick_line(start, clear, thickness) if 0 <= x < 40 and 0 <= y < 30}
        got = rays.free_cells(start, ends, margin, thickness, 40, 30)
        assert sorted(got.tolist()) == sorted(x * 30 + y for x, y in want)


def test_frame_votes_equal_the_exploded_form(spark):
    """Pixels, cells and lines as rows of Spark give the same votes as the drawing within tasks."""
    from pyspark.sql import functions as F

    from navprep.functions import geometry as g
    from navprep.operators import frames as fr, points as P

    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        q = rng.normal(size=4)
        rows.append((f"e{i % 2}", i, 6, 8, [int(v) for v in rng.integers(0, 6000, 48)], 5.0, 5.0, 3.5, 2.5, (*map(float, rng.normal(size=3)), *map(float, q / np.linalg.norm(q))), 0.1, 0.9))
    rows.append(("e0", 99, 6, 8, None, 5.0, 5.0, 3.5, 2.5, rows[0][9], 0.1, 0.9))
    f = spark.createDataFrame(rows, "env string, frame_id long, height int, width int, data array<int>, fx double, fy double, cx double, cy double, camera struct<x:double,y:double,z:double,qx:double,qy:double,qz:double,qw:double>, ground_z double, robot_height double")
    px = {k: rays.Pixels(n, 1, 0.4, 5.0) for k, n in (("hit", 1), ("ray", 2), ("bounds", 2))}

    def cloud(k):
        p = fr.sample_pixels(f, px[k].stride, 1, 0.4, 5.0)
        return P.back_project(p, *(F.col(c) for c in ("fx", "fy", "cx", "cy")), F.col("camera")).withColumn("cam_x", F.col("camera.x")).withColumn("cam_y", F.col("camera.y"))

    cams = f.where("data is not null").select("env", F.col("camera.x").alias("x"), F.col("camera.y").alias("y"))
    params = P.raycast_bounds(cloud("bounds"), cams, 0.1, 0.5)
    got = rays.frame_bounds(f, px["bounds"], 0.1, 0.5)
    assert sorted(map(tuple, got.drop("start_x", "start_y").collect())) == sorted(map(tuple, params.drop("start_x", "start_y").collect()))
    params = params.withColumn("num_x", F.col("num_x") - 10)  # some points are outside
    z = F.col("z") - F.col("ground_z")
    hits = P.hit_votes(P.to_cells(cloud("hit").where((z > 0.2) & (z < 1.5 * F.col("robot_height"))), params))
    start = lambda a: F.rint((F.col(f"cam_{a}") - F.col(f"start_{a}")) / F.col("voxel")).cast("int").alias(f"c{a}")
    ends = P.to_cells(cloud("ray"), params).where("inside").select("env", "frame_id", "ix", "iy", start("x"), start("y"), "num_x", "num_y")
    free = P.free_votes(P.ray_cells(ends.where("cx >= 0 and cx < num_x and cy >= 0 and cy < num_y"), 2))
    want = hits.join(free, ["env", "ix", "iy"], "full_outer").na.fill(0).select("env", "ix", "iy", "hit_votes", "free_votes")
    got = rays.frame_votes(f, params, px["hit"], px["ray"], 0.2, 0.15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("free_votes > 1").count()


def test_dilate():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    i, j = np.indices(mask.shape)
    assert (whole_maps.dilate(mask, 2) == (np.hypot(i - 4, j - 4) <= 2)).all()
    assert not whole_maps.dilate(np.zeros((3, 3), bool), 2).any()


@pytest.mark.parametrize("name", ["map_from_fused_depth"])  # the others have oracles
def test_map_queries(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).collect()
    assert rows and all(np.isfinite(r["value"]) for r in rows)


def test_flat_cameras_in_steps(spark):
    from pyspark.sql import functions as F

    from navprep.functions import geometry as g

    poses = spark.createDataFrame([("a", 0, 1.0, 2.0, 0.4, 0.1, 0.2, 0.3, 0.9), ("a", 1, 0.0, 1.0, 0.8, -0.2, 0.1, 0.5, 0.8)], POSE)
    frames = spark.createDataFrame([("a", k, 1, 1, [1], 1.0, 1.0, 0.0, 0.0) for k in (0, 1)], FRAME)
    e = spark.createDataFrame([("a", (0.1, 0.2, 0.3, -0.5, 0.5, -0.5, 0.5))], "env string, extrinsic struct<x double, y double, z double, qx double, qy double, qz double, qw double>")
    got = maps.with_camera(frames, poses, e, flat=True).orderBy("frame_id").select("camera.*").collect()
    pose = poses.select("env", "frame_id", F.struct(*g.POSE).alias("p")).join(e, "env")
    want = pose.orderBy("frame_id").select(g.camera_pose(F.col("p"), F.col("extrinsic"), F.lit(0.6)).alias("c")).select("c.*").collect()
    assert np.allclose(np.array(got, float), np.array(want, float))
