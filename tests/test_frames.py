"""Frames, files, fusion and joystick goals against brute force and round trips."""

import itertools
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navprep.functions.geometry import POSE
from navprep.jobs import settings
from navprep.operators import frames as fr, fusion
from navprep.sources import files, store
from navprep.streaming import robot

FRAME = "env string, frame_id long, height int, width int, data array<double>"


def frame(spark, image, n=0):
    return spark.createDataFrame([("e", n, image.shape[0], image.shape[1], [float(x) for x in image.reshape(-1)])], FRAME)


def image_of(df):
    r = df.first()
    return np.array(r.data).reshape(r.height, r.width)


def test_png(spark, tmp_path):
    r = np.random.default_rng(0)
    image = r.integers(0, 65536, (5, 7))
    assert (files.decode_png(files.encode_png(image)) == image).all()
    raw = np.ascontiguousarray(image, ">u2").view(np.uint8).reshape(5, 14)
    above = np.zeros(14, np.uint8)
    for kind, row in zip((0, 1, 2, 3, 4), raw):  # filter each row by definition, undo it
        left, corner = np.r_[np.zeros(2, int), row[:-2]], np.r_[np.zeros(2, int), above[:-2]]
        p = left.astype(int) + above - corner
        plane = [min((abs(v - a), i, a) for i, a in enumerate((x, y, z)))[2] for v, x, y, z in zip(p, left.astype(int), above.astype(int), corner.astype(int))]
        guess = {0: 0, 1: left, 2: above.astype(int), 3: (left.astype(int) + above) // 2, 4: np.array(plane)}[kind]
        assert (files._unfilter(kind, ((row.astype(int) - guess) & 255).astype(np.uint8), above, 2) == row).all()
        above = row
    d = tmp_path / "env1"
    d.mkdir()
    for name, body in (("2.PNG", files.encode_png(image)), ("10.png", b"no image"), ("x.png", files.encode_png(image))):
        (d / name).write_bytes(body)
    got = files.read_depth_frames(spark, str(d)).collect()
    assert [(x.env, x.frame_id, x.height, x.width) for x in got] == [("env1", 2, 5, 7)] and list(got[0].data) == image.reshape(-1).tolist()


def test_text_files(spark, tmp_path):
    d = tmp_path / "env1"
    d.mkdir()
    (d / "poses.txt").write_text("[1, 2, 3, 0, 0, 0, 1]\n\n[4.5, 5, 6, 0, 0, 1, 0]\n")
    got = files.read_poses(spark, str(d / "poses.txt")).orderBy("frame_id").collect()
    assert [(x.env, x.frame_id, x.x, x.qz, x.qw) for x in got] == [("env1", 0, 1.0, 0.0, 1.0), ("env1", 1, 4.5, 1.0, 0.0)]
    for n in (12, 16):
        (d / f"k{n}.txt").write_text("(" + ", ".join(str(i) for i in range(n)) + ")")
        k = files.read_intrinsics(spark, str(d / f"k{n}.txt")).first().k
        assert k[:12] == [float(i) for i in range(12)] and k[12:] == ([0, 0, 0, 1] if n == 12 else [12, 13, 14, 15])
    (d / "k11.txt").write_text(str(list(range(11))))
    with pytest.raises(Exception, match="intrinsics"):
        files.read_intrinsics(spark, str(d / "k11.txt")).collect()
    (d / "t.txt").write_text("[0, 0, 0, 1, 7, 8, 9]")
    assert tuple(files.read_extrinsics(spark, str(d / "t.txt")).first().extrinsic) == (7, 8, 9, 0, 0, 0, 1)
    (d / "log.txt").write_text("start\nEpoch: 3 | Training Loss: 0.5 | Val Loss: 1e-2 | Duration: 4.0\n")
    assert [tuple(x) for x in files.read_training_log(spark, str(d / "log.txt")).collect()] == [("env1", 3, 0.5, 0.01, 4.0)]
    files.write_env_list(spark.createDataFrame([("b",), ("a",)], "env string"), str(tmp_path / "list"))
    assert [x.env for x in files.read_env_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]


def test_map_and_env_round_trip(spark, tmp_path):
    params = spark.createDataFrame([("e", 3, 2, -1.0, -2.0, 0.5, 1.0)], "env string, num_x int, num_y int, start_x double, start_y double, voxel double, clear_dist double")
    cells = spark.createDataFrame([("e", 2, 1, 7.5), ("e", 0, 0, 1.0)], "env string, ix int, iy int, value double")
    files.write_map(cells, params, str(tmp_path / "m"))
    back, p = files.read_map(spark, str(tmp_path / "m"))
    assert back.count() == 6 and {(x.env, x.ix, x.iy, x.value) for x in back.where("value <> 0").collect()} == {("e", 2, 1, 7.5), ("e", 0, 0, 1.0)}
    assert p.first().asDict() == params.first().asDict()
    f = spark.createDataFrame([("a", i, i * 10) for i in range(6)] + [("b", 5, 50)], "env string, frame_id long, v int")
    files.write_training_env(f, str(tmp_path / "t"))
    files.write_training_env(f.where("env = 'a'"), str(tmp_path / "t"), 2, 4)
    assert sorted((x.env, x.frame_id, x.v) for x in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 0, 20), ("a", 1, 30), ("b", 5, 50)]
    report = spark.createDataFrame([("x", 1)], "bag string, n int")
    files.write_reports(report, str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists"):
        files.write_reports(report, str(tmp_path / "r"))
    files.write_reports(report, str(tmp_path / "r"), overwrite=True)


def test_raw_and_ply(spark, tmp_path):
    grey = np.arange(6, dtype=">u2").reshape(2, 3)
    padded = b"".join(row.tobytes() + b"\xff\xff" for row in grey)
    assert np.allclose(files.decode_raw("16UC1", 2, 3, 8, True, padded), grey / 1000)
    color = np.arange(16, dtype=np.uint8)
    assert files.decode_raw("rgba8", 2, 2, 8, False, color.tobytes())[0, 1].tolist() == [6, 5, 4] and files.decode_raw("bgra8", 2, 2, 8, False, color.tobytes())[0, 1].tolist() == [4, 5, 6]
    with pytest.raises(ValueError):
        files.decode_raw("yuv", 1, 1, 1, False, b"0")
    m = spark.createDataFrame([("b", 0, "mono8", 1, 2, 4, False, bytearray(b"\x01\x02\x00\x00"))], "bag string, msg_idx long, encoding string, height int, width int, step int, is_bigendian boolean, data binary")
    assert list(files.decode_raw_images(m).first().data) == [1.0, 2.0]
    d = tmp_path / "scans"
    d.mkdir()
    head = "ply\nformat {} 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar i\nend_header\n"
    (d / "1.ply").write_bytes(head.format("binary_little_endian", 2).encode() + struct.pack("<fffBfffB", 1, 2, 3, 9, float("nan"), 0, 0, 9))
    (d / "2.ply").write_bytes(head.format("ascii", 1).encode() + b"4 5 6 1\n")
    (d / "3.ply").write_bytes(head.format("ascii", 0).encode())
    assert sorted(tuple(x) for x in files.read_scans(spark, str(d)).collect()) == [("scans", 1, 1, 2, 3), ("scans", 2, 4, 5, 6)]


def test_pixels_and_flips(spark):
    image = np.arange(12.0).reshape(3, 4)
    f = frame(spark, image)
    assert (image_of(fr.flip_horizontal(f)) == image[:, ::-1]).all() and (image_of(fr.flip_vertical(f)) == image[::-1]).all() and (image_of(fr.rotate_180(f)) == image[::-1, ::-1]).all()
    assert (image_of(fr.roll(f, F.lit(1), F.lit(-1))) == np.roll(image, (1, -1), (0, 1))).all()
    got = {(r.u, r.v, r.depth) for r in fr.sample_pixels(f, 2, 1, 2.0, 8.0, 1.0).collect()}
    assert got == {(2, 0, 2.0)} and fr.sample_pixels(f, 2, 3).count() == 0
    odd = spark.createDataFrame([([None, float("nan"), float("inf"), 500.0, 20000.0],)], "d array<double>")
    assert odd.select(fr.clean_depth(F.col("d"))).first()[0] == [0, 0, 0, 0.5, 0]
    mm = spark.createDataFrame([([0.0005, 0.0015, 0.0019, 99.0],)], "d array<double>").select(fr.encode_mm(F.col("d"), True), fr.encode_mm(F.col("d"), False)).first()
    assert mm[0] == [0, 2, 2, 65535] and mm[1] == [0, 1, 1, 99000 & 65535]


def test_crop_and_shrink(spark):
    r = np.random.default_rng(3)
    image = r.random((6, 9)) * (r.random((6, 9)) < 0.7)
    got = image_of(fr.crop_resize(frame(spark, image), 4, 3))  # 4 : 3 of 9 x 6 is 8 x 6, no offset
    crop = image[:, 0:8]
    want = [[1000 * b[b > 0].mean() if (b > 0).any() else 0 for b in (crop[i : i + 2, j : j + 2] for j in range(0, 8, 2))] for i in range(0, 6, 2)]
    assert np.abs(got - np.array(want)).max() <= 0.5 + 1e-6
    black = spark.createDataFrame([("e", 0, 6, 9, None)], FRAME)
    assert list(fr.crop_resize(black, 2, 2, color=True).first().data) == [0] * 12
    p = spark.range(1).select(fr.crop_params(F.lit(1600), F.lit(1296), 640, 360).alias("c"), F.array(*(F.lit(float(v)) for v in (800, 0, 790, 0, 0, 810, 650, 0, 0, 0, 1, 0))).alias("p"))
    c = p.first().c
    assert (c.x, c.y, c.w, c.h) == (0, 198, 1600, 900) and np.isclose(c.scale_x, 0.4)
    assert np.allclose(p.select(fr.rescale_projection(F.col("p"), F.col("c"))).first()[0], [320, 0, 316, 0, 0, 324, (650 - 198) * 0.4, 0, 0, 0, 1, 0])
    cal = spark.createDataFrame([("a", 4, 3, 1.0, 0.0, 2.0, 5.0, 6.0, [0.1]), ("b", 0, 3, 1.0, 0.0, 2.0, 5.0, 6.0, [0.1])], "camera string, width int, height int, fx double, skew double, fy double, cx double, cy double, distortion array<double>")
    info = fr.camera_info(cal).collect()
    assert len(info) == 1 and info[0].k == [1, 0, 5, 0, 2, 6, 0, 0, 1] and info[0].p == [1, 0, 5, 0, 0, 2, 6, 0, 0, 0, 1, 0]


def test_tiles_and_blur(spark):
    r = np.random.default_rng(4)
    image = np.rint(r.random((4, 6)) * 100)
    t = fr.split_tiles(frame(spark, image), 2, 3, centre=True)
    got = {x.tile: np.array(x.data).reshape(2, 3) for x in t.collect()}
    assert (got[3] == image[2:, 3:]).all() and (got[4] == image[1:3, 1:4]).all() and len(got) == 5
    assert (image_of(fr.merge_tiles(t, 4, 6, 2, 3)) == image).all()
    many = frame(spark, image)
    for n in range(1, 40):
        many = many.unionByName(frame(spark, image, n))
    steps = {0: (0, 1), 1: (1, 0), 2: (1, 1), 3: (-1, 1)}
    pad = np.pad(image, 2)
    options = [(0, image)] + [(k, sum(pad[2 + i * dy : 6 + i * dy, 2 + i * dx : 8 + i * dx] for i in range(-k, k + 1)) / (2 * k + 1 if n < 2 else 1)) for k in (1, 2) for n, (dy, dx) in steps.items()]
    seen = set()
    for x in fr.motion_blur(many.coalesce(4), (0.3, 0.4, 0.3)).collect():
        assert any(k == x.reach and np.allclose(np.array(x.data).reshape(4, 6), o) for k, o in options)
        seen.add(x.reach)
    assert seen == {0, 1, 2}
    pairs = spark.createDataFrame([(1, 4, 6, image.reshape(-1).tolist(), np.roll(image, (1, 2), (0, 1)).reshape(-1).tolist())], "pair_id long, height int, width int, a array<double>, b array<double>")
    s = fr.best_shifts(pairs).first()
    assert np.isclose(s.value, 1) and (s.down, s.right) == (1, 2) and np.isclose(s.loss, 0) and s.still < 1


def test_shifts_of_channels_and_blocks(spark):
    """Raw norms, channels summed, blocks of any size, frames of another size and of zeros."""
    r = np.random.default_rng(6)
    images = {i: r.random((2, 3, 4)) + (i % 3) for i in range(9)} | {20: np.zeros((2, 3, 4)), 21: r.random((2, 4, 3)), 22: r.random((1, 3, 4))}
    rows = [(i, a.shape[1], a.shape[2], a.reshape(-1).tolist()) for i, a in images.items()] + [(30, 3, 4, None)]
    x = spark.createDataFrame(rows, "id long, height int, width int, data array<double>")
    want = {}
    for i, a in images.items():
        for j, b in images.items():
            if a.shape == b.shape and j % 2 == 0:
                c = {(s, t): (a * np.roll(b, (-s, -t), (1, 2))).sum() for s in range(a.shape[1]) for t in range(a.shape[2])}
                scale = np.linalg.norm(a) * np.linalg.norm(b)
                want[i, j] = max(c.values()) / scale if scale else 0.0
                if scale:
                    want[i, j, "at"] = [k for k, v in c.items() if np.isclose(v, max(c.values()))]
    for block in (2, 64):
        got = fr.pairwise_shifts(x, x.where("id % 2 = 0"), block).collect()
        assert len(got) == len([k for k in want if len(k) == 2])
        for g in got:
            assert np.isclose(g.value, want[g.x_id, g.y_id]) and (g.down, g.right) in want.get((g.x_id, g.y_id, "at"), [(0, 0)])


def test_fusion_of_a_plane(spark):
    h = w = 16
    flat = [2000] * (h * w)
    cam = dict(zip(POSE, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    rows = [("e", h, w, flat, 12.0, 12.0, 7.5, 7.5, tuple(cam[c] for c in POSE))] * 2 + [("e", h, w, [0] * (h * w), 12.0, 12.0, 7.5, 7.5, tuple(cam[c] for c in POSE))]
    f = spark.createDataFrame(rows, "env string, height int, width int, data array<int>, fx double, fy double, cx double, cy double, camera struct<" + ",".join(f"{c}:double" for c in POSE) + ">")
    v = fusion.fuse(f, 0.1, 0.4, 10.0)
    assert set(r.weight for r in fusion.voxels(v).collect()) == {2}
    cloud = fusion.surface_points(v, 0.1).toPandas()
    assert len(cloud) > 50 and np.abs(cloud["z"] - 2).max() < 0.05
    assert fusion.fuse(f.where("false"), 0.1, 0.4, 10.0).count() == 0
    small = fusion.fused_cloud(f, 0.1, 0.4, 10.0, (8, 8)).toPandas()
    assert 0 < len(small) < len(cloud) and np.abs(small["z"] - 2).max() < 0.05


def test_fusion_voxel_by_voxel(spark, monkeypatch):
    """Every voxel of every block near a surface by its definition, frame by frame, and the crossings between neighbours."""
    monkeypatch.setattr(fusion, "HELD", 64)
    r = np.random.default_rng(8)
    voxel, trunc, k = 0.1, 0.25, (5.0, 5.5, 2.4, 1.9)
    rows, total, weight = [], {}, {}
    for n in range(5):
        env, q = f"e{n % 2}", r.normal(size=4)
        cam = np.r_[r.normal(0, 0.2, 3), q / np.linalg.norm(q)]
        mm = r.integers(300, 1500, (4, 5)) * (r.random((4, 5)) < 0.8)
        rows.append((env, 4, 5, mm.reshape(-1).tolist(), *k, tuple(map(float, cam))))
        rot, depth = fusion.rotation(cam[3:]), np.where(mm <= 1200, mm, 0) / 1000
        blocks = set()
        for v, u in zip(*np.nonzero(depth)):
            p = rot @ [(u - k[2]) / k[0] * depth[v, u], (v - k[3]) / k[1] * depth[v, u], depth[v, u]] + cam[:3]
            lo, hi = (np.floor((p + d) / (voxel * fusion.BLOCK)).astype(int) for d in (-trunc, trunc))
            blocks |= set(itertools.product(*(range(a, b + 1) for a, b in zip(lo, hi))))
        for b in blocks:
            for i in itertools.product(range(fusion.BLOCK), repeat=3):
                at = tuple(np.array(b) * fusion.BLOCK + i)
                c = rot.T @ ((np.array(at) + 0.5) * voxel - cam[:3])
                if c[2] <= 0:
                    continue
                u, v = np.rint(c[0] / c[2] * k[0] + k[2]), np.rint(c[1] / c[2] * k[1] + k[3])
                if 0 <= u < 5 and 0 <= v < 4 and depth[int(v), int(u)] > 0:
                    far = (depth[int(v), int(u)] - c[2]) * np.sqrt(1 + ((u - k[2]) / k[0]) ** 2 + ((v - k[3]) / k[1]) ** 2)
                    if far > -trunc:
                        total[env, at] = total.get((env, at), 0) + min(1.0, far / trunc)
                        weight[env, at] = weight.get((env, at), 0) + 1
    f = spark.createDataFrame(rows, "env string, height int, width int, data array<int>, fx double, fy double, cx double, cy double, camera struct<" + ",".join(f"{c}:double" for c in POSE) + ">")
    volume = fusion.fuse(f, voxel, trunc, 1.2)
    got = {(x.env, (x.ix, x.iy, x.iz)): (x.weight, x.tsdf) for x in fusion.voxels(volume).collect()}
    assert {key: w for key, (w, _) in got.items()} == weight and all(np.isclose(got[key][1], t / weight[key]) for key, t in total.items())
    mean, want = {key: t / weight[key] for key, t in total.items()}, []
    for (env, at), a in mean.items():
        for axis in range(3):
            b = mean.get((env, tuple(np.add(at, np.eye(3, dtype=int)[axis]))))
            if b is not None and all(-0.98 <= x < 0.98 for x in (a, b)) and a * b < 0:
                want.append((env, *((np.array(at) + 0.5 + np.eye(3)[axis] * abs(a) / (abs(a) + abs(b))) * voxel)))
    have = sorted(map(tuple, fusion.surface_points(volume, voxel).collect()))
    assert len(want) > 50 and [x[0] for x in have] == [x[0] for x in sorted(want)] and np.allclose([x[1:] for x in have], [x[1:] for x in sorted(want)])


def test_joystick(spark):
    r = np.random.default_rng(5)
    rows = [(int(u), i, i // 3, str(r.choice(["enable", "goal", "stick"], p=[0.2, 0.2, 0.6])), float(r.normal() * 0.3), float(r.normal() * 0.3), int(r.integers(1, 4))) for i, u in enumerate(r.integers(0, 3, 200))]
    e = spark.createDataFrame(rows, "robot_id long, event_id long, ts long, kind string, stick_x double, stick_y double, n_axes int")
    e = e.withColumn("pressed", F.col("kind") == "enable").withColumn("kind", F.when(F.col("kind") == "goal", "goal").otherwise("joy"))
    got = {x.event_id: x for x in robot.joystick_goals(e, 5.0, 0.3).collect()}
    state = {}
    for u, i, _, kind, a, b, n in rows:
        smart, goal = state.get(u, (False, None))
        if kind == "goal":
            smart, goal = False, (a, b)
        elif n >= 2:
            smart = smart or kind == "enable"
            if smart:
                goal = (5 * a, 5 * b) if (a * a + b * b) ** 0.5 >= 0.3 else None
        state[u] = smart, goal
        assert (got[i].smart, got[i].active) == (smart, goal is not None) and (goal is None or np.allclose((got[i].goal_x, got[i].goal_y), goal))
    p = spark.createDataFrame([([1, 2], True, True), ([1, 2], True, False), ([1, 2], False, True)], "path array<int>, active boolean, reacting boolean")
    assert [(x.main, x.fear_path) for x in robot.published_paths(p).collect()] == [([1], [1, 2]), ([1, 2], []), ([], [])]


def test_settings():
    s = settings.resolve({"map_source": "Depth_TSDF", "robot_width": 0.5, "ground_height": 0.1, "depth_tsdf_frame_stride": 3})
    assert (s["cloud_source"], s["robot_size"], s["terrain_ground_height"], s["depth_raycast_frame_stride"], s["depth_raycast_bounds_pixel_stride"]) == ("depth_tsdf", 0.25, 0.1, 3, 8)
    assert np.isclose(s["depth_tsdf_truncation"], 0.2) and np.isclose(s["cloud_voxel"], 0.045)


def test_environments_are_committed_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    poses = spark.createDataFrame([("007", 0, 1.0), ("b", 0, 2.0), ("b", 1, 3.0)], "env string, frame_id long, x double")
    ground = spark.createDataFrame([("b", 0, 0, 0.5)], "env string, ix int, iy int, z double")
    assert store.read_table(spark, path, "poses") is None
    store.write_environments({"poses": poses, "ground": ground}, path)
    rows = lambda name: sorted(map(tuple, store.read_table(spark, path, name).select("env", *[c for c in ("frame_id", "x", "z", "split") if c in store.read_table(spark, path, name).columns]).collect()))
    assert rows("poses") == [("007", 0, 1.0), ("b", 0, 2.0), ("b", 1, 3.0)] and rows("ground") == [("b", 0.5)]
    # a new write of one env replaces all its tables; the other stays
    store.write_environments({"poses": spark.createDataFrame([("b", 5, 9.0)], poses.schema)}, path)
    assert rows("poses") == [("007", 0, 1.0), ("b", 5, 9.0)] and rows("ground") == []
    # a write that fails before its commit is never seen
    broken = poses.withColumn("x", F.raise_error(F.lit("no disk")).cast("double"))
    with pytest.raises(Exception):
        store.write_environments({"ground": ground, "poses": broken}, path)
    assert rows("poses") == [("007", 0, 1.0), ("b", 5, 9.0)] and rows("ground") == []
    with pytest.raises(ValueError):
        store.write_environments({"poses": poses.withColumn("env", F.lit(None).cast("string"))}, path)


def test_a_split_is_kept_while_its_size_is(spark, tmp_path):
    path = str(tmp_path / "split")
    pairs = lambda **n: spark.createDataFrame([(e, i) for e, k in n.items() for i in range(k)], "env string, pair_id long")
    read = lambda x: {(r.env, r.pair_id): r.split for r in x.collect()}
    first = read(store.kept_split(spark, pairs(a=50, b=30), path, seed=1))
    assert sum(v == "train" for (e, _), v in first.items() if e == "a") == 45
    again = read(store.kept_split(spark, pairs(a=50, b=31), path, seed=2))
    assert {k: v for k, v in again.items() if k[0] == "a"} == {k: v for k, v in first.items() if k[0] == "a"}
    assert sum(v == "train" for (e, _), v in again.items() if e == "b") == 27 and None not in again.values()
    assert store.kept_split(spark, pairs(a=0), str(tmp_path / "none")).collect() == []


def png(image, bits, color, interlaced=False, palette=None, filters=(0, 1, 2, 3, 4)):
    """A PNG of samples (height, width, channels), rows filtered in turn by the given kinds."""
    def filtered(part):
        h, w, n = part.shape
        packed = part.reshape(h, -1).astype(">u2").view(np.uint8).reshape(h, -1) if bits == 16 else part.reshape(h, -1).astype(np.uint8)
        if bits < 8:
            each = (packed[..., None] >> np.arange(bits - 1, -1, -1)) & 1
            packed = np.packbits(each.reshape(h, -1), axis=1)
        step, out, above = max(1, n * bits // 8), b"", np.zeros(packed.shape[1], int)
        for i, row in enumerate(packed.astype(int)):
            kind = filters[i % len(filters)]
            left, corner = (np.r_[np.zeros(step, int), x][: len(x)] for x in (row, above))
            est = left + above - corner
            near = np.where((abs(est - left) <= abs(est - above)) & (abs(est - left) <= abs(est - corner)), left, np.where(abs(est - above) <= abs(est - corner), above, corner))
            guess = (np.zeros(len(row), int), left, above, (left + above) // 2, near)[kind]
            out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            above = row
        return out

    starts = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if interlaced else ((0, 0, 1, 1),)
    parts = [image[y::dy, x::dx] for y, x, dy, dx in starts]
    raw = b"".join(filtered(p) for p in parts if p.size)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], bits, color, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_of_every_kind(interlaced):
    r = np.random.default_rng(3)
    for h, w in ((1, 1), (3, 5), (9, 8), (17, 13)):
        for bits in (1, 2, 4, 8, 16):
            grey = r.integers(0, 1 << bits, (h, w, 1))
            want = grey[..., 0] * (255 // ((1 << bits) - 1) if bits < 8 else 1)
            assert (files.png_pixels(png(grey, bits, 0, interlaced)) == want).all()
        for bits, color in ((8, 2), (16, 2), (8, 6), (16, 6), (8, 4)):
            image = r.integers(0, 1 << bits, (h, w, files.CHANNELS[color]))
            want = image[..., 0] if color == 4 else np.rint(image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114)
            assert (files.png_pixels(png(image, bits, color, interlaced)) == want).all()
        palette, index = r.integers(0, 256, (4, 3)), r.integers(0, 4, (h, w, 1))
        assert (files.png_pixels(png(index, 2, 3, interlaced, palette)) == np.rint(palette[index[..., 0]] @ [0.299, 0.587, 0.114])).all()


def test_files_that_are_no_images(spark, tmp_path):
    d = tmp_path / "env"
    d.mkdir()
    good = png(np.arange(6).reshape(2, 3, 1), 16, 0)
    for n, data in enumerate((good, b"text", good[:40], png(np.full((2, 2, 1), 3), 2, 3, palette=np.zeros((2, 3))), b"")):
        (d / f"{n}.png").write_bytes(data)
    assert [x.frame_id for x in files.read_depth_frames(spark, str(d)).collect()] == [0]
    why = {x.frame_id: x.reason for x in files.skipped_frames(spark, str(d)).collect()}
    assert set(why) == {1, 2, 3} and why[1] == "no PNG" and why[3] == "palette too short"  # Spark lists no file without bytes


def test_numbers_over_ranges(spark):
    from navprep.operators import folds, vectors

    r = np.random.default_rng(1)
    rows = [(int(x), f"n{i}") for i, x in enumerate(r.integers(0, 9, 60))]
    for parts in (1, 13):
        got = folds.numbered(spark.createDataFrame(rows, "a long, b string"), ["a", "b"], parts).collect()
        assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.number)] == sorted(rows) and sorted(x.number for x in got) == list(range(60))
    v = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    both = [sorted((x.vec_id, x.proto_id, round(x.similarity, 9)) for x in vectors.prototype_similarity(v, v.where("vec_id < 7"), block).collect()) for block in (100, 2)]
    assert both[0] == both[1] and len(both[0]) == 140


def test_pixels_of_maps_and_places(spark):
    from navprep.functions import geometry as g
    from navprep.operators import grids

    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 2, 3.0), ("a", 0, 1, 2.0), ("a", 1, 0, float("nan")), ("b", 0, 0, 5.0), ("b", 0, 1, float("inf"))], "env string, ix int, iy int, value double")
    params = spark.createDataFrame([("a", 3), ("b", 2)], "env string, num_y int")
    got = sorted(map(tuple, grids.normalised_cells(cells, params).collect()))
    assert got == sorted([("a", 2, 0, 0), ("a", 0, 1, 255), ("a", 1, 0, 127), ("a", 2, 1, 0), ("b", 1, 0, 0), ("b", 0, 0, 0)])
    p = spark.createDataFrame([(1.3, -2.0, 0.05, 130)], "p double, s double, v double, n int")
    u = p.withColumn("u", g.grid_index(F.col("p"), F.col("s"), F.col("v"), F.col("n"))[0])
    assert np.isclose(u.select(g.grid_place(F.col("u"), F.col("s"), F.col("v"), F.col("n"))).first()[0], 1.3)


def test_legacy_clouds_keep_what_is_out_of_range(spark):
    """Pixels out of range a millimetre before the camera, and a frame's worth of points at the origin; without the flag neither."""
    cam = dict(zip(POSE, (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)))
    f = spark.createDataFrame([("e", 2, 2, [1000, 100, 20000, 0], 2.0, 2.0, 0.5, 0.5, tuple(cam[c] for c in POSE))], "env string, height int, width int, data array<int>, fx double, fy double, cx double, cy double, camera struct<" + ",".join(f"{c}:double" for c in POSE) + ">")
    rows = lambda **m: sorted((round(x.x, 3), round(x.y, 3), round(x.z, 3), x.n) for x in fr.depth_cloud(f, 0.1, **m).collect())
    assert rows() == [(0.75, 1.75, 4.0, 1)]
    assert rows(legacy=True) == [(0.0, 0.0, 0.0, 4), (0.75, 1.75, 4.0, 1), (1.0, 2.0, 3.001, 3)]
