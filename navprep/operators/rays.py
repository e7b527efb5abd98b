"""Votes of depth frames for the cells of a map: each frame is read, projected and drawn within its task, and only cells with their sums leave it."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import points as P

#: Cells that a task holds before it sums them up.
HELD = 1 << 21
_FRAME = ("env", "height", "width", "data", "fx", "fy", "cx", "cy")
_POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")


class Pixels(NamedTuple):
    """Which pixels of a frame count: every stride-th, without the bottom rows, depth / scale within the closed range."""

    stride: int
    ignore_bottom: int
    low: float
    high: float
    scale: float = 1000.0


def rotation(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q / np.sqrt((q * q).sum())
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def world_points(f, px: Pixels) -> np.ndarray:
    """World coordinates (n, 3) of the pixels of a frame's row; a null pixel is none."""
    rows, cols = np.arange(0, max(0, int(f.height) - px.ignore_bottom), px.stride), np.arange(0, int(f.width), px.stride)
    image = np.asarray(f.data, float).reshape(int(f.height), int(f.width))
    depth = image[np.ix_(rows, cols)] / px.scale
    v, u = np.nonzero((depth >= px.low) & (depth <= px.high))
    d = depth[v, u]
    camera = np.stack([(cols[u] - f.cx) / f.fx * d, (rows[v] - f.cy) / f.fy * d, d], 1)
    pose = np.array([getattr(f, f"cam_{c}") for c in _POSE], float)
    return camera @ rotation(pose[3:]).T + pose[:3]


def line_cells(start: tuple[int, int], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ix, iy) of the 8-connected lines from start to each of ends, in no order and with repeats.

    Step k of the longer axis moves ceil(k * minor / major - 0.5) along the other, from the end of smaller iy on (the start where these are equal)."""
    a, b = np.broadcast_to(np.array(start), ends.shape), ends
    swap = (b[:, 1] < a[:, 1])[:, None]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    delta = b - a
    n = np.abs(delta).max(1)
    line = np.repeat(np.arange(len(n)), n + 1)
    k = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    out = []
    for c in (0, 1):
        d, most = delta[line, c], np.maximum(n[line], 1)
        step = np.where(np.abs(d) == n[line], k, np.ceil(k * np.abs(d) / most - 0.5).astype(int))
        out.append(a[line, c] + np.sign(d) * step)
    return out[0], out[1]


def free_cells(start: tuple[int, int], ends: np.ndarray, margin: int, thickness: int, nx: int, ny: int) -> np.ndarray:
    """Distinct ix * ny + iy of the cells that a frame's rays cross: lines to the distinct ends, shortened by margin cells (none where no longer than
    margin + 1), and with thickness all cells of the map within half of it from a cell of the line. The bitmap spans the rays, not the map."""
    ends = np.unique(ends, axis=0)
    delta = (ends - start).astype(float)
    length = np.sqrt((delta * delta).sum(1))
    far = length > margin + 1
    if not far.any():
        return np.zeros(0, np.int64)
    delta, length = delta[far], length[far]
    ends = np.rint(start + delta * ((length - margin) / length)[:, None]).astype(int)
    ix, iy = line_cells(start, ends)
    grow = int(thickness / 2) if thickness > 1 else 0
    x0, y0 = ix.min() - grow, iy.min() - grow
    seen = np.zeros((ix.max() + grow - x0 + 1, iy.max() + grow - y0 + 1), bool)
    seen[ix - x0, iy - y0] = True
    if grow:
        thin = seen.copy()
        a, b = np.nonzero(thin)
        for i in range(-grow, grow + 1):
            for j in range(-grow, grow + 1):
                if math.hypot(i, j) <= thickness / 2:
                    seen[a + i, b + j] = True
    ix, iy = np.nonzero(seen)
    ix, iy = ix + x0, iy + y0
    ok = (ix >= 0) & (ix < nx) & (iy >= 0) & (iy < ny)
    return ix[ok].astype(np.int64) * ny + iy[ok]


def _rows(frames: DataFrame, *more: str) -> DataFrame:
    return frames.where("data is not null").select(*_FRAME, *(F.col(f"camera.{c}").cast("double").alias(f"cam_{c}") for c in _POSE), *more)


def frame_bounds(frames: DataFrame, px: Pixels, voxel: float, clear: float) -> DataFrame:
    """A params row for each env with a point: extent of all frames' points and cameras, and clear on each side, at least 10 cells a side."""

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                p = world_points(f, px)
                both = np.r_[p[:, :2], [[f.cam_x, f.cam_y]]]
                out.append((f.env, len(p), *both.min(0), *both.max(0)))
            yield pd.DataFrame(out, columns=["env", "n", "lo_x", "lo_y", "hi_x", "hi_y"])

    e = _rows(frames).mapInPandas(extent, "env string, n long, lo_x double, lo_y double, hi_x double, hi_y double")
    e = e.groupBy("env").agg(F.sum("n").alias("n"), F.min("lo_x").alias("lo_x"), F.min("lo_y").alias("lo_y"), F.max("hi_x").alias("hi_x"), F.max("hi_y").alias("hi_y")).where("n > 0")
    ends = e.select("env", F.explode(F.array(F.struct(F.col("lo_x").alias("x"), F.col("lo_y").alias("y")), F.struct(F.col("hi_x").alias("x"), F.col("hi_y").alias("y")))).alias("p")).select("env", "p.x", "p.y")
    return P.raycast_bounds(ends, ends.limit(0), voxel, clear)


def frame_votes(frames: DataFrame, params: DataFrame, hit: Pixels, ray: Pixels, ground_height: float, clearance: float, thickness: int = 1) -> DataFrame:
    """env, ix, iy, hit_votes, free_votes of cells with any.

    frames: env, height, width, data, fx, fy, cx, cy, camera (a pose), ground_z, robot_height. Every hit pixel between ground and robot votes for its cell; a
    frame votes at most once for each cell that its rays cross. Frames whose camera is outside the map have no rays, ends outside it are left out. Sums of
    some frames (HELD cells, or a batch) leave the task, so pixels and lines are never shuffled."""

    def sums(seen: dict) -> Iterator[pd.DataFrame]:
        for (env, ny), votes in seen.items():
            parts = [np.unique(np.concatenate([*v, np.zeros(0, np.int64)]), return_counts=True) for v in votes]
            at = np.union1d(parts[0][0], parts[1][0])
            n = np.zeros((2, len(at)), np.int64)
            for row, (cell, times) in zip(n, parts):
                row[np.searchsorted(at, cell)] = times
            yield pd.DataFrame({"env": np.full(len(at), env, object), "ix": (at // ny).astype(np.int32), "iy": (at % ny).astype(np.int32), "hit_votes": n[0], "free_votes": n[1]})
        seen.clear()

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict = defaultdict(lambda: ([], []))
            held = 0
            for f in pdf.itertuples(index=False):
                nx, ny, start = int(f.num_x), int(f.num_y), np.array([f.start_x, f.start_y])

                def cells(p):
                    at = np.rint((p[:, :2] - start) / f.voxel).astype(np.int64)
                    return at[(at >= 0).all(1) & (at[:, 0] < nx) & (at[:, 1] < ny)]

                p = world_points(f, hit)
                z = p[:, 2] - f.ground_z
                at = cells(p[(z > ground_height) & (z < 1.5 * f.robot_height)])
                seen[f.env, ny][0].append(at[:, 0] * ny + at[:, 1])
                camera = cells(np.array([[f.cam_x, f.cam_y]]))
                ends = cells(world_points(f, ray)) if len(camera) else camera
                if len(ends):
                    seen[f.env, ny][1].append(free_cells(tuple(camera[0]), ends, max(1, math.ceil(clearance / f.voxel)), thickness, nx, ny))
                held += len(at) + (len(seen[f.env, ny][1][-1]) if len(ends) else 0)
                if held > HELD:
                    yield from sums(seen)
                    held = 0
            yield from sums(seen)

    rows = _rows(frames.join(params.select("env", "num_x", "num_y", "start_x", "start_y", "voxel"), "env"), "num_x", "num_y", "start_x", "start_y", "voxel", "ground_z", "robot_height")
    votes = rows.mapInPandas(vote, "env string, ix int, iy int, hit_votes long, free_votes long")
    return votes.groupBy("env", "ix", "iy").agg(F.sum("hit_votes").alias("hit_votes"), F.sum("free_votes").alias("free_votes"))
