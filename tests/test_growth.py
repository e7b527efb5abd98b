"""Steps whose work or memory must not outgrow the input, and queries that must take all of it."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql.functions import lit

from navprep.jobs import frame_queries, map_queries, maps, report_queries, settings
from navprep.jobs.catalog import QUERIES
from navprep.operators import fusion, outliers, points, rays, scoring

SMALL = "/root/testdata/sf0.001"


def test_depth_cloud_takes_every_measured_pixel(spark):
    mm = np.floor(np.abs(np.array(pq.read_table(f"{SMALL}/embeddings.parquet")["embedding"].to_pylist(), float)) * 20000)
    n = QUERIES["depth_cloud"](spark, SMALL).agg({"n": "sum"}).first()[0]
    assert n == ((mm >= 1) & (mm <= 10000)).sum() > ((mm >= 200) & (mm <= 10000)).sum()


def test_blocks_of_fused_frames_meet_in_a_stream(spark):
    frames = frame_queries._frames(spark, SMALL).where("frame_id < 4")
    plan = fusion.surface_points(fusion.fuse(frames, 0.2, 0.8, 10.0), 0.2)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # a call for each block cost more than its work
    whole = sorted(map(tuple, fusion.surface_points(fusion.fuse(frames, 0.2, 0.8, 10.0), 0.2).collect()))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "3")  # a block's rows lie across batches
    try:
        cut = sorted(map(tuple, fusion.surface_points(fusion.fuse(frames, 0.2, 0.8, 10.0), 0.2).collect()))
    finally:
        spark.conf.unset(batch)
    assert len(whole) > 100 and [x[0] for x in cut] == [x[0] for x in whole] and np.allclose([x[1:] for x in cut], [x[1:] for x in whole])


def test_fusing_shuffles_pixels_not_voxels(spark, monkeypatch):
    f = map_queries._frames(spark, SMALL).where("frame_id < 4")
    f = fusion.stored(maps.with_camera(f, map_queries._poses(spark, SMALL)), "test-frames")
    written = lambda: {p: p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    fused = []

    def measured(df, name):
        old, n = written(), df.count()
        fused.append((n, sum(size for p, size in written().items() if p not in old)))
        return df

    monkeypatch.setattr(fusion, "stored", measured)
    fusion.fused_cloud(f, 0.045, 0.2, 10.0)
    (n, size), = fused
    assert n > 50_000 and size < 30_000 * f.count()  # the voxels that a frame touches are over a million bytes


def test_cubes_meet_without_a_gap(spark, monkeypatch):
    frames = frame_queries._frames(spark, SMALL).where("frame_id < 12")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(fusion.surface_points(fusion.fuse(frames, 0.2, 0.8, 10.0), 0.2))  # by blocks that meet in a shuffle
    for held in (1, 27, 512):
        monkeypatch.setattr(fusion, "HELD", held)
        points = fusion.fused_points(frames, 0.2, 0.8, 10.0)
        got = rows(points.drop("low"))
        assert len(got) == len(whole) > 1000 and [x[0] for x in got] == [x[0] for x in whole] and np.allclose([x[1:] for x in got], [x[1:] for x in whole])
        lows = [sorted(map(tuple, df.groupBy("env").agg({"x": "min", "y": "min", "z": "min"}).collect())) for df in (points, points.where("low"))]
        assert lows[0] == lows[1]


def test_pixels_of_every_kind_fuse_alike(spark):
    frames = frame_queries._frames(spark, SMALL).where("frame_id < 3")
    rows = lambda f, most: sorted(map(tuple, fusion.fused_points(f, 0.2, 0.8, most).collect()))
    want = rows(frames, 12.0)
    broken = frames.unionByName(frames.selectExpr("env", "frame_id", "height", "width", "transform(data, x -> cast(null as int)) data", "fx", "fy", "cx", "cy", "camera"))
    for f, most in ((frames.selectExpr("*").withColumn("data", frames["data"].cast("array<double>")), 12.0), (frames, 70.0), (frames, 1e7), (frames, float("inf")), (broken, 12.0)):
        got = rows(f, most)  # no pixel is beyond 12 m
        assert len(got) == len(want) > 100 and [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:4] for x in got], [x[1:4] for x in want])
    assert fusion.fused_points(frames.withColumn("camera", frames["camera"].withField("qx", lit(None).cast("double"))), 0.2, 0.8, 12.0).count() == 0


def test_only_points_near_the_terrain_are_thinned(spark, monkeypatch):
    """The cloud of the terrain's heights is that of all points, while others aren't kept but for an env's least."""
    poses = map_queries._poses(spark, SMALL)
    s = settings.resolve({**map_queries._SETTINGS, "cloud_source": "depth_tsdf"})
    frames, kept, clouds, store = map_queries._frames(spark, SMALL).where("frame_id < 3"), [], [], fusion.stored

    def counted(df, name):
        out = store(df, name)
        kept.append(out.count())
        return out

    def seen(cloud, poses, s):
        clouds.append(maps._terrain(cloud, poses, s).select("env", "x", "y", "z").toPandas().sort_values(["env", "x", "y", "z"]))
        raise StopIteration

    monkeypatch.setattr(fusion, "stored", counted)
    monkeypatch.setattr(maps, "surface_from_cloud", seen)
    plain = fusion.fused_cloud
    for cut in (True, False):
        if not cut:
            monkeypatch.setattr(fusion, "fused_cloud", lambda *a, near: plain(*a))
        with pytest.raises(StopIteration):
            maps.build_map(s, poses, frames)
    assert len(clouds[0]) == len(clouds[1]) > 1000 and (clouds[0]["env"].values == clouds[1]["env"].values).all()
    assert np.allclose(clouds[0][["x", "y", "z"]], clouds[1][["x", "y", "z"]], atol=1e-12) and kept[0] < kept[1] / 2


def test_parts_of_a_frame_count_as_the_whole_of_it():
    """A cube's sums from the pixels that it was dealt are those from the whole image, exactly, at pixels' edges too and behind the camera."""
    r = np.random.default_rng(3)
    for n in range(6):
        mm = r.integers(300, 2500, (6, 9)) * (r.random((6, 9)) < 0.8)
        q = r.normal(size=4) if n else np.array([0, 0, 0, 1.0])
        view, parts = np.r_[5.0, 4.0, 4.5, 2.5, r.normal(0, 0.1, 3) * (n > 0), q], 0
        for cube, blocks, v, u in fusion.frame_cubes(mm / 1000, tuple(view[:4]), view[4:], 0.1, 0.25, 2, True):
            a, b = fusion._Cube(0.1, 0.25, 2), fusion._Cube(0.1, 0.25, 2)
            a.add(cube, view, blocks, v.start, u.start, mm[v, u] / 1000)
            b.add(cube, view, blocks, 0, 0, mm / 1000)
            assert (a.total == b.total).all() and (a.weight == b.weight).all()
            parts += mm[v, u].size < mm.size
        assert parts > 3


def test_a_dense_block_is_searched_by_cells(monkeypatch):
    cloud = np.random.default_rng(4).uniform(0, 1.8, (8000, 3))
    own = cloud[((cloud > 0.3) & (cloud < 1.5)).all(1)]
    want, far, _ = outliers.nearest_means(own, cloud, 50)
    work, plain = [], outliers._distances
    monkeypatch.setattr(outliers, "_distances", lambda a, b, n: work.append(len(a) * len(b)) or plain(a, b, n))
    mean, near, n = outliers.block_means(own, cloud, 50, 0.3)
    assert np.allclose(mean, want) and np.allclose(near, far) and (n == 50).all()
    assert sum(work) < 0.2 * len(own) * len(cloud)
    lone = np.r_[own[:30], [[9.0, 9.0, 9.0]]]
    assert np.isinf(outliers.block_means(lone, lone, 20, 0.01)[1]).all()


def test_waypoints_of_a_tile_are_shared_out(spark, monkeypatch):
    r = np.random.default_rng(5)
    cells = spark.createDataFrame(pd.DataFrame([("e", i, j, float(r.random())) for i in range(20) for j in range(12)], columns=["env", "ix", "iy", "value"]))
    params = spark.createDataFrame([("e", 20, 12, -1.0, -1.0, 0.25)], "env string, num_x int, num_y int, start_x double, start_y double, voxel double")
    rows = [(n, 0, "e" if n % 9 else "none", float(x), float(y)) for n, (x, y) in enumerate(r.uniform(-2, 5, (400, 2)))]
    w = spark.createDataFrame(rows, "traj_id long, wp_idx int, env string, wx double, wy double")
    whole = sorted(map(tuple, scoring.lookup(w, cells, params).collect()))
    monkeypatch.setattr(scoring, "WAYPOINTS", 16)
    shared = sorted(map(tuple, scoring.lookup(w, cells, params).collect()))
    assert len(whole) == 400 and shared == whole
    assert all((x[5] is None and x[6] is False) == (x[2] == "none") for x in whole)


def test_scores_sort_waypoints_once(spark):
    kp = spark.createDataFrame([(t, i, float(i), float(i * t), 0.5) for t in (1, 2) for i in (1, 2, 3)], "traj_id long, kp_idx int, x double, y double, z double")
    goals = kp.where("kp_idx = 3").select("traj_id", "x", "y", "z").toDF("traj_id", "gx", "gy", "gz")
    s = scoring.score(scoring.densify(kp), goals, path=True)
    plan = s._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "max_by(struct" not in plan
    assert s._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Sort [") <= 2  # waypoints, goals
    assert all(x["path"] > 3 and x["goal"] < 1e-9 for x in s.collect())


def test_votes_are_summed_before_a_batch_ends(spark, monkeypatch):
    f = map_queries._frames(spark, SMALL).where("frame_id < 8")
    s = settings.resolve({**map_queries._SETTINGS, "cloud_source": "depth_raycast_2d"})
    poses = map_queries._poses(spark, SMALL)
    with_camera = maps.with_camera(f, poses, by_position=True)
    whole = sorted(map(tuple, maps.ray_votes(with_camera, poses, s)[0].collect()))
    monkeypatch.setattr(rays, "HELD", 10)
    assert sorted(map(tuple, maps.ray_votes(with_camera, poses, s)[0].collect())) == whole and len(whole) > 1000


def test_scans_meet_poses_and_lattices_without_a_shuffle(spark):
    most = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(most, "-1")  # sizes that Spark can't know
    try:
        posed = report_queries._posed(spark, SMALL)
        for df in (posed, points.voxel_downsample(posed.select("env", "x", "y", "z"), 0.5), map_queries._scans(spark, SMALL)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(most)
