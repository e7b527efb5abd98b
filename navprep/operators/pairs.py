"""Training pairs of frames and relative goals, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g


def pair_by_position(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames and poses of an env zipped in order of frame_id; the longer list's rest goes."""
    n = lambda d: d.withColumn("position", F.row_number().over(W.partitionBy("env").orderBy("frame_id")) - 1)
    return n(frames).join(n(poses).withColumnRenamed("frame_id", "pose_id"), ["env", "position"])


def goal_pairs(poses: DataFrame, max_episode: int, step: int, offset: float = 0.0) -> DataFrame:
    """env, pair_id, ahead, frame_id, pose, goal: for ahead = 1, 1 + step, .. <= max_episode the pose that many frames on (the last at most), in the frame's own coordinates.

    poses: env, frame_id (0 .. n - 1), pose struct. One equi-join on (env, frame)."""
    p = poses.select("env", "frame_id", g.forward_offset(F.col("pose"), offset).alias("pose") if offset else F.col("pose"))
    last = p.groupBy("env").agg(F.max("frame_id").alias("last"))
    a = p.join(last, "env").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(max_episode), F.lit(step)))).withColumn("goal_id", F.least(F.col("frame_id") + F.col("ahead"), F.col("last")))
    b = p.select("env", F.col("frame_id").alias("goal_id"), F.col("pose").alias("goal_pose"))
    # ahead first, then frame
    pair_id = F.floor((F.col("ahead") - 1) / step) * (F.col("last") + 1) + F.col("frame_id")
    return a.join(b, ["env", "goal_id"]).select("env", pair_id.cast("long").alias("pair_id"), F.col("ahead").cast("int").alias("ahead"), "frame_id", "pose", g.relative(F.col("pose"), F.col("goal_pose")).alias("goal"))


def exact_split(pairs: DataFrame, share: float = 0.9, seed: int = 0) -> DataFrame:
    """split = 'train' for exactly int(share * n) pairs of each env, in the order of a seeded hash; the rest 'test'.

    Ranks are taken within hash ranges and carried on, so an env of any size is not one task's."""
    h = F.xxhash64("pair_id", F.lit(seed))
    p = pairs.withColumn("h", h).withColumn("range", F.shiftright(F.col("h"), 56))
    counts = p.groupBy("env", "range").agg(F.count("*").alias("c"))
    w = W.partitionBy("env").orderBy("range")
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy("env")))
    rank = F.row_number().over(W.partitionBy("env", "range").orderBy("h", "pair_id"))
    p = p.withColumn("rank", rank).join(counts, ["env", "range"])
    return p.withColumn("split", F.when(F.col("rank") + F.col("before") <= F.floor(F.col("n") * share), "train").otherwise("test")).drop("h", "range", "rank", "c", "before", "n")


def select_envs(table: DataFrame, envs: DataFrame, test_env_id: int | None = None) -> DataFrame:
    """Rows of the listed envs (env, position); in a test only of the one at min(test_env_id, n - 1)."""
    if test_env_id is not None:
        n = envs.count()
        envs = envs.where(F.col("position") == min(test_env_id, n - 1))
    return table.join(envs.select("env").distinct(), "env", "left_semi")


def env_profile(env: Column, offset: float, tilt: float) -> Column:
    """robot_frame, offset and tilt by the name as written: all three for names with 'anymal', the tilt alone for others with 'tilt'."""
    robot = env.contains("anymal")
    return F.struct(robot.alias("robot_frame"), F.when(robot, offset).otherwise(0.0).alias("offset"), F.when(robot | env.contains("tilt"), tilt).otherwise(0.0).alias("tilt"))


def dataset_counts(frames: DataFrame, max_episode: int, step: int) -> DataFrame:
    """env, images and goal pairs (images times the whole steps of an episode)."""
    return frames.groupBy("env").agg(F.count("*").alias("images"), (F.count("*") * (max_episode // step)).alias("pairs"))
