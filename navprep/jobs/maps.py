"""Cost maps of environments from any source of points, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g
from ..operators import frames as fr, fusion, grids, outliers, pairs, points as P, rays
from ..operators.tables import sized, stored

# Names of sources that a job's settings may give.
DEPTH = ("depth",)
DEPTH_FUSED = ("depth_tsdf", "raycast_depth", "raycast_depth_tsdf", "open3d_depth_tsdf")
SCAN = ("scan", "pointcloud", "point_cloud", "deskewed_scan")
DEPTH_RAYCAST = ("depth_raycast_2d", "depth_raycast2d", "raycast_2d", "raycast_depth_2d", "direct_depth_raycast")


def _with_extrinsic(rows: DataFrame, extrinsics: DataFrame | None) -> DataFrame:
    """rows with extrinsic, the identity where their env has none."""
    identity = g.pose((F.lit(0.0),) * 3, (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    if extrinsics is None:
        return rows.withColumn("extrinsic", identity)
    return rows.join(extrinsics.select("env", "extrinsic"), "env", "left").withColumn("extrinsic", F.coalesce("extrinsic", identity))


def with_camera(frames: DataFrame, poses: DataFrame, extrinsics: DataFrame | None = None, flat: bool = False, by_position: bool = False) -> DataFrame:
    """Frames with camera (a pose struct) and position (the frame's place, from 0): paired with poses of the same id, or by place in order.

    extrinsics: env, extrinsic (a pose struct). flat: the base stands level at the env's mean height. Only ids are sorted; cameras are brought to the frames, whose pixels stay where they are while a broadcast can hold them."""
    p = poses.select("env", "frame_id", F.struct(*g.POSE).alias("base"))
    ids = frames.select("env", "frame_id")
    if by_position:
        met = pairs.pair_by_position(ids, p).select("env", "frame_id", "position", "base")
    else:
        met = ids.join(p, ["env", "frame_id"]).withColumn("position", F.col("frame_id"))
    met = _with_extrinsic(met.join(P.mean_height(poses), "env"), extrinsics)
    if flat:  # in steps over plain columns: one nested expression would be repeated wherever the camera is used
        roll, _, yaw = g.euler_xyz(g.quaternion(F.col("base")))
        met = met.withColumn("roll", roll).withColumn("yaw", yaw)
        met = met.withColumns(dict(zip(("lx", "ly", "lz", "lw"), g.from_euler_xyz(F.col("roll"), F.lit(0.0), F.col("yaw")))))
        met = met.withColumn("base", g.pose((F.col("base.x"), F.col("base.y"), F.col("mean_z")), tuple(F.col(c) for c in ("lx", "ly", "lz", "lw"))))
    camera = g.camera_pose(F.col("base"), F.col("extrinsic"))
    met = stored(met.select("env", "frame_id", "position", camera.alias("camera")), "map-cameras")
    return frames.join(sized(met), ["env", "frame_id"])


def with_heights(rows: DataFrame, poses: DataFrame, s: dict) -> DataFrame:
    """rows with robot_height and ground_z of their env; both follow the mean pose height where settings don't fix them."""
    robot, ground, offset = (s.get(k) for k in ("robot_height", "ground_z", "ground_z_offset"))
    r = rows.join(P.mean_height(poses), "env")
    height = F.col("mean_z") if robot is None else F.lit(float(robot))
    level = F.lit(float(ground)) if ground is not None else F.lit(0.0) if offset is None else F.col("mean_z") + float(offset)
    return r.withColumn("robot_height", height).withColumn("ground_z", level).drop("mean_z")


def _terrain(points: DataFrame, poses: DataFrame, s: dict) -> DataFrame:
    t = P.classify_terrain(with_heights(points, poses, s), F.col("ground_z"), s["terrain_ground_height"], F.col("robot_height"))
    return t.drop("ground_z", "robot_height")


def _near_terrain(points: DataFrame, levels: DataFrame, s: dict, size: float) -> DataFrame:
    """points with near: false where no voxel of that size that holds them can have its mean among the terrain. levels: with_heights of envs.

    A voxel's points differ by size at most: where one lies farther from the terrain, the mean of all and of any others lies outside."""
    z, h, margin = F.col("z") - F.col("ground_z"), abs(s["terrain_ground_height"]), 1.01 * size
    near = (z > -h - margin) & (z < F.greatest(F.lit(h), 1.5 * F.col("robot_height")) + margin)
    return points.join(sized(levels), "env").withColumn("near", near).drop("ground_z", "robot_height")


def surface_from_cloud(cloud: DataFrame, poses: DataFrame, s: dict) -> tuple[DataFrame, DataFrame]:
    """(cells, params) of a cloud in the world. Obstacles are thinned to a point a voxel, then lose their statistical outliers; these bound the map and fill its
    obstacle layer. Free points count as they are."""
    t = stored(_terrain(cloud.select("env", "x", "y", "z"), poses, s), "map-terrain")
    obstacles = P.voxel_downsample(t.where("terrain = 'obstacle'").select("env", "x", "y", "z"), s["voxel_size"]).select("env", "x", "y", "z")
    obstacles = stored(outliers.remove_outliers(obstacles, s["voxel_size"]).withColumn("terrain", F.lit("obstacle")), "map-obstacles")
    params = stored(P.map_bounds(obstacles, s["voxel_size"], s["clear_dist"]), "map-bounds")
    kept = obstacles.unionByName(t.where("terrain = 'free'"))
    layers = P.to_cells(kept, params).where("inside").select("env", "ix", "iy", F.col("terrain").alias("layer")).distinct()
    if s["trajectory_clear_radius"] > 0:
        way = P.corridor(poses.select("env", "frame_id", "x", "y", "z"), params, s["trajectory_clear_radius"], s["voxel_size"])
        layers = layers.unionByName(way.withColumn("layer", F.lit("corridor")))
    cells = grids.surface_map(layers, params, s["robot_size"], s["map_sigma_smooth"], s["obstacle_reassign_threshold"], s["free_space_threshold"])
    return cells, params


def ray_votes(frames: DataFrame, poses: DataFrame, s: dict) -> tuple[DataFrame, DataFrame]:
    """(votes, params) of frames with cameras: hits of obstacle pixels, and at most one free vote of a frame for each cell that its rays cross."""
    r = lambda k: s[f"depth_raycast_{k}"]
    f = frames.where(F.col("position") % r("frame_stride") == 0).drop("position")
    pixels = lambda k: rays.Pixels(r(f"{k}_pixel_stride"), r("ignore_bottom_rows"), r("min_depth"), s["max_depth_range"], r("depth_scale"))
    params = stored(rays.frame_bounds(f, pixels("bounds"), s["voxel_size"], s["clear_dist"]), "map-bounds")
    levels = stored(with_heights(poses.select("env").distinct(), poses, s), "map-heights")
    votes = rays.frame_votes(f.join(sized(levels), "env"), params, pixels("hit"), pixels("ray"), s["terrain_ground_height"], r("endpoint_clearance"), r("ray_thickness"))
    votes = P.occupancy(stored(votes, "map-sums"), r("min_hit_votes"), r("hit_ratio_threshold"), r("min_free_votes"))
    return P.carve(votes, r("free_carve_min_votes"), r("free_carve_max_hit_ratio")), params


def build_map(s: dict, poses: DataFrame, frames: DataFrame | None = None, scans: DataFrame | None = None, extrinsics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells: env, ix, iy, value; params) of every env by the source that resolved settings name; another name is an error.

    poses: env, frame_id, x, y, z, qx, qy, qz, qw. frames: env, frame_id, height, width, data (mm), fx, fy, cx, cy. scans: env, frame_id, x, y, z in the frame of
    scan_transform_mode. An env without an obstacle (or, by rays, without a point) has no map. Frames without a pose and scans without one take no part."""
    source = s["cloud_source"]
    flat = s["is_flat_ground"]
    if source in DEPTH:
        cloud = fr.depth_cloud(with_camera(frames, poses, extrinsics, flat), s["cloud_voxel"], high=s["max_depth_range"], legacy=s.get("legacy", False))
    elif source in DEPTH_FUSED:
        f = with_camera(frames, poses, extrinsics, flat, by_position=True)
        f = f.where(F.col("position") % s["depth_tsdf_frame_stride"] == 0).drop("position")
        levels = stored(with_heights(poses.select("env").distinct(), poses, s), "map-heights")
        near = lambda rows: _near_terrain(rows, levels, s, s["cloud_voxel"])
        cloud = fusion.fused_cloud(f, s["cloud_voxel"], s["depth_tsdf_truncation"], s["max_depth_range"], near=near)
    elif source in SCAN:
        base = _with_extrinsic(poses.select("env", "frame_id", F.struct(*g.POSE).alias("base")), extrinsics)
        x = scans.join(sized(stored(base, "scan-poses")), ["env", "frame_id"])
        mode = s["scan_transform_mode"]
        origin = tuple(F.col(f"base.{c}") for c in "xyz") if mode == "world" else None
        x = P.to_world(P.range_filter(x, s["max_scan_range"], origin), mode, F.col("base"), F.col("extrinsic"))
        cloud = P.voxel_downsample(x.select("env", "x", "y", "z"), s["cloud_voxel"])
    elif source in DEPTH_RAYCAST:
        votes, params = ray_votes(with_camera(frames, poses, extrinsics, flat, by_position=True), poses, s)
        r = lambda k: s[f"depth_raycast_{k}"]
        cells = grids.raycast_map(
            votes, params, s["robot_size"], r("collision_cost_transition"), r("unknown_cost"), r("obstacle_min_component_cells"), s["map_sigma_smooth"],
            r("occupancy_inflation_radius"), r("collision_cost_power"), r("surface_thinning_radius"),
        )
        return cells.select("env", "ix", "iy", "value"), params
    else:
        raise ValueError(f"unknown source {source}")
    return surface_from_cloud(cloud, poses, s)
