"""Per-robot state over a stream of planner events: fear hysteresis, goal status and motion de-duplication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..operators.folds import ordered_fold
from .ordered import fold_in_order

BUFFER, NEAR = 3, 1e-2
#: Metres to a goal that has been reached, metres that a full stick means, and the part of a stick's way that counts for nothing.
CONVERGED, SCALE, DEADBAND = 0.5, 5.0, 0.05
EVENT = "robot_id long, event_id long, ts long, kind string, fear double, forward boolean, distance double, stick_x double, stick_y double, n_axes int, n_buttons int, pressed boolean"
_RESULT = "fear_count int, reacting boolean, status int, active boolean, smart boolean"
START = [0, False, 0, False, False]
#: Goal status: under way, arrived, failed.
UNDER_WAY, ARRIVED, FAILED = 0, 1, -1


def step(state: list, kind: str, fear: float, forward: bool, distance: float | None = None, stick: tuple[float, float] | None = None, pressed: bool = False, buffer: int = BUFFER, converged: float = CONVERGED, deadband: float = DEADBAND) -> list:
    """[fear count, reacting, status, active, smart] of a robot's planner after an event.

    'goal': a waypoint; all starts anew, joystick mode ends. 'joy': a stick (None: one with too few axes or buttons, ignored); the button latches the mode and
    clears fear; in the mode a stick within the dead-band clears fear and the goal, another sets a goal. 'tick': a plan, made only while a goal is active. A goal
    nearer than converged is reached, but not in joystick mode: status 0 becomes 1, and no plan follows until a new goal. Fear ahead raises the count up to the
    reaction; while reacting, fear ahead leaves it, each other plan lowers it, and the reaction ends at 0. Without a reaction it never falls. A reaction turns
    status 0 to -1; an arrival stays one."""
    count, reacting, status, active, smart = state
    if kind == "goal":
        return [0, False, UNDER_WAY, True, False]
    if kind == "joy":
        if stick is None:
            return list(state)
        if pressed:
            count, reacting, smart = 0, False, True
        if smart:
            active = math.hypot(*stick) >= deadband
            if not active:
                count, reacting = 0, False
        return [count, reacting, status, active, smart]
    if kind != "tick" or not active:
        return list(state)
    if distance is not None and distance < converged and not smart:
        active = False
        status = ARRIVED if status == UNDER_WAY else status
    if fear > 0.5 and forward:
        count += not reacting
    elif reacting:
        count -= 1
    reacting = count > buffer or reacting and count > 0
    if reacting and status == UNDER_WAY:
        status = FAILED
    return [count, reacting, status, active, smart]


def all_states(buffer: int = BUFFER) -> list[list]:
    """Every state that the planner can reach: few, so that logs can be folded by tables. A count above buffer means a reaction, and a reaction a count above 0."""
    flags = (False, True)
    return [[c + r, r, s, a, m] for c in range(buffer + 1) for r in flags for s in (UNDER_WAY, ARRIVED, FAILED) for a in flags for m in flags]


def stick_ok(e) -> bool:
    """Whether a stick's message has the axes and buttons that are read; absent counts are taken for enough."""
    return not (e.n_axes < 2 or e.n_buttons < 1)


def fold_rows(rows: pd.DataFrame, state: list, buffer: int = BUFFER, converged: float = CONVERGED, deadband: float = DEADBAND) -> tuple[dict, list]:
    """Results and last state of a robot's events (columns of EVENT) in order."""
    out = []
    for e in rows.itertuples(index=False):
        distance = None if pd.isna(e.distance) else e.distance
        stick = (e.stick_x, e.stick_y) if e.kind == "joy" and stick_ok(e) and not pd.isna(e.stick_x + e.stick_y) else None
        state = step(state, e.kind, 0.0 if pd.isna(e.fear) else e.fear, e.forward is not None and not pd.isna(e.forward) and bool(e.forward), distance, stick, not pd.isna(e.pressed) and bool(e.pressed), buffer, converged, deadband)
        out.append(state)
    return {n: np.array([s[i] for s in out], kind) for i, (n, kind) in enumerate((("fear_count", np.int32), ("reacting", bool), ("status", np.int32), ("active", bool), ("smart", bool)))}, state


def completed(events: DataFrame) -> DataFrame:
    """events with all columns of EVENT, absent ones null."""
    return events.select(*(F.col(n).cast(t).alias(n) if n in events.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in EVENT.split(", "))))


def with_goals(states: DataFrame, scale: float = SCALE) -> DataFrame:
    """goal_x, goal_y of states with the events' columns, while a goal is active: the last waypoint's place (stick_x, stick_y), or the stick's in the mode, times scale."""
    w = W.partitionBy("robot_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    stick = (F.col("kind") == "joy") & F.col("smart") & ~((F.col("n_axes") < 2) | (F.col("n_buttons") < 1)).eqNullSafe(True)
    k = F.when(F.col("kind") == "joy", scale).otherwise(1.0)
    mine = F.when((F.col("kind") == "goal") | stick, F.struct((F.col("stick_x") * k).alias("x"), (F.col("stick_y") * k).alias("y")))
    x = states.withColumn("g", F.last(mine, ignorenulls=True).over(w))
    return x.withColumn("goal_x", F.when(F.col("active"), F.col("g.x"))).withColumn("goal_y", F.when(F.col("active"), F.col("g.y"))).drop("g")


def fold_batch(events: DataFrame, buffer: int = BUFFER, converged: float = CONVERGED, deadband: float = DEADBAND, parts: int | None = None) -> DataFrame:
    """robot_id, event_id, fear_count, reacting, status, active, smart after each event (columns of EVENT; absent ones null), in order of ts and event_id within a
    robot. A robot's log may span many tasks: its states are few, so stretches of it are composed as tables."""
    fold = lambda rows, state: fold_rows(rows, state, buffer, converged, deadband)
    return ordered_fold(completed(events), "robot_id", ["ts", "event_id"], fold, START, _RESULT, ["robot_id", "event_id"], all_states(buffer), parts)


def fold_stream(events: DataFrame, lateness: str = "10 seconds", buffer: int = BUFFER, converged: float = CONVERGED, deadband: float = DEADBAND) -> DataFrame:
    """fold_batch over a streaming DataFrame (append mode); an event's result comes once the watermark, lateness behind the latest event, has passed it."""
    fold = lambda rows, state: fold_rows(rows, state, buffer, converged, deadband)
    return fold_in_order(completed(events), "robot_id", ["ts", "event_id"], fold, START, _RESULT, ["robot_id", "event_id"], lateness)


_POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")


def keep_moved(rows: pd.DataFrame, state: list | None, near: float = NEAR) -> tuple[dict, list | None]:
    """Whether each pose is saved, its number, and the state: the last saved pose and the next number."""
    v = rows[list(_POSE)].to_numpy(float)
    last, n = (None, 0) if state is None else (np.array(state[:-1]), state[-1])
    saved, number = np.zeros(len(v), bool), np.zeros(len(v), np.int64)
    for i, row in enumerate(v):
        if last is None or ((row - last) ** 2).sum() ** 0.5 >= near:
            saved[i], number[i], last, n = True, n, row, n + 1
    return {"saved": saved, "sample": number}, None if last is None else [*map(float, last), int(n)]


def deduplicate_motion(poses: DataFrame, near: float = NEAR, parts: int | None = None) -> DataFrame:
    """env, frame_id, sample: poses at least near (over all seven values) away from the last one saved, numbered from 0: a true fold, as the last saved isn't the
    row before. An env's log may span many tasks."""
    kept = ordered_fold(poses.select("env", F.col("frame_id").cast("long").alias("frame_id"), *_POSE), "env", ["frame_id"], lambda rows, state: keep_moved(rows, state, near), None, "saved boolean, sample long", ["env", "frame_id"], parts=parts)
    return kept.where("saved").drop("saved")


def deduplicate_stream(poses: DataFrame, lateness: str = "10 seconds", near: float = NEAR) -> DataFrame:
    """deduplicate_motion over a streaming DataFrame of env, ts (microseconds), frame_id and the pose, in order of ts and frame_id; numbers go on over micro-batches."""
    rows = poses.select("env", F.col("ts").cast("long").alias("ts"), F.col("frame_id").cast("long").alias("frame_id"), *(F.col(c).cast("double").alias(c) for c in _POSE))
    kept = fold_in_order(rows, "env", ["ts", "frame_id"], lambda own, state: keep_moved(own, state, near), None, "saved boolean, sample long", ["env", "frame_id"], lateness)
    return kept.where("saved").drop("saved")


def rate_limit(samples: DataFrame, seconds: float) -> DataFrame:
    """The latest sample of each tick, per robot; for a stream give samples a watermark first."""
    tick = F.window("ts", f"{int(seconds * 1_000_000)} microseconds")
    return samples.groupBy("robot_id", tick.alias("tick")).agg(F.max_by("sample_id", F.struct("ts", "sample_id")).alias("sample_id"))


def span_gate(synced: DataFrame, stamps: tuple[str, ...], slop: float) -> DataFrame:
    """Samples whose stamps span at most slop (and 1e-6)."""
    return synced.where(F.greatest(*stamps) - F.least(*stamps) <= slop + 1e-6)


def latency(plans: DataFrame, window: str = "1 minute") -> DataFrame:
    """Count, mean and maximum of milliseconds in tumbling windows."""
    return plans.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))


def joystick_goals(events: DataFrame, scale: float = SCALE, deadband: float = DEADBAND) -> DataFrame:
    """robot_id, event_id, smart, goal_x, goal_y, active, fear_count, reacting after each event: the planner's fold, with the goal that a stick set last."""
    e = completed(events)
    states = fold_batch(e, deadband=deadband).join(e.select("robot_id", "event_id", "ts", "kind", "stick_x", "stick_y", "n_axes", "n_buttons"), ["robot_id", "event_id"])
    return with_goals(states, scale).select("robot_id", "event_id", "smart", "goal_x", "goal_y", "active", "fear_count", "reacting")


def published_paths(plans: DataFrame) -> DataFrame:
    """main and fear paths of plans (path, active, reacting): none without a goal; on a reaction the whole path goes to fear and its first point to main."""
    none = F.slice("path", 1, 0)
    main = F.when(~F.col("active"), none).when(F.col("reacting"), F.slice("path", 1, 1)).otherwise(F.col("path"))
    return plans.withColumn("main", main).withColumn("fear_path", F.when(F.col("active") & F.col("reacting"), F.col("path")).otherwise(none))
