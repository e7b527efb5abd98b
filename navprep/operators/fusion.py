"""Projective truncated-distance fusion of depth frames, in packed blocks of voxels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import POSE
from .points import voxel_downsample
from .rays import rotation
from .tables import stored

#: Voxels of a block's side, blocks that a task holds at once (a cube of them), and rows of blocks that are packed or crossed at once.
BLOCK, HELD, STEP = 8, 1 << 9, 512
#: Blocks whose voxels are projected at once: their arrays stay in a core's cache.
FEW = 64
#: Mean distances at or beyond it have no crossings.
EDGE = 0.98
_BLOCK_KEY = ("env", "bx", "by", "bz")
_CUBE_KEY = ("env", "gx", "gy", "gz")
#: A frame's part of a cube: view is its intrinsics and pose, blocks their places in the cube, pixels those that the blocks project onto, from top and left on.
_PARTS = "env string, gx int, gy int, gz int, view binary, blocks binary, top int, left int, width int, pixels binary"


def frame_cubes(depth: np.ndarray, k: tuple[float, float, float, float], camera: np.ndarray, voxel: float, trunc: float, side: int, halo: bool) -> Iterator[tuple[np.ndarray, np.ndarray, slice, slice]]:
    """(cube, places of blocks in it, rows, columns of the pixels that these may project onto) of the blocks near a frame's surface (metres, 0: nothing).

    A cube is side blocks wide and has side + 1 places a side: with halo, the last are those of the next cubes' first blocks, of which a cube sees the first layer."""
    fx, fy, cx, cy = k
    r, t = rotation(camera[3:]), camera[:3]
    v, u = np.nonzero(depth > 0)
    d = depth[v, u]
    world = np.stack([(u - cx) / fx * d, (v - cy) / fy * d, d], 1) @ r.T + t
    world = world[np.isfinite(world).all(1)]
    if not len(world):
        return
    edge = BLOCK * voxel
    lo, hi = np.floor((world - trunc) / edge).astype(np.int64), np.floor((world + trunc) / edge).astype(np.int64)
    low, span = lo.min(0), np.ptp(np.r_[lo, hi], axis=0) + 1
    unit = np.array([span[1] * span[2], span[2], 1])
    found = [np.unique((np.minimum(lo + step, hi) - low) @ unit) for step in np.ndindex(*((hi - lo).max(0) + 1))]
    blocks = np.stack(np.unravel_index(np.unique(np.concatenate(found)), span), 1) + low
    # a block's voxels project between its corners, if these lie before the camera
    corner = ((blocks[:, None] + np.array(list(np.ndindex(2, 2, 2)))) * edge - t) @ r
    z, size = corner[..., 2], np.array(depth.shape[::-1])
    with np.errstate(all="ignore"):
        at = corner[..., :2] / z[..., None] * (fx, fy) + (cx, cy)
    before = (z.min(1) > 0)[:, None]
    first, last = np.where(before, np.floor(at.min(1)), 0), np.where(before, np.ceil(at.max(1)), size - 1)
    first, last = np.maximum(first, 0), np.minimum(last, size - 1)
    seen = np.flatnonzero((z.max(1) > 0) & (first <= last).all(1))
    if not len(seen):
        return
    cube, place = blocks[seen] // side, blocks[seen] % side
    cubes, places, whose = [cube], [place], [seen]
    for axis in range(3 * halo):
        edge_ = place[:, axis] == 0
        cubes.append(cube[edge_] - np.eye(3, dtype=np.int64)[axis])
        places.append(np.where(np.arange(3) == axis, side, place[edge_]))
        whose.append(seen[edge_])
    cube, place, whose = map(np.concatenate, (cubes, places, whose))
    order = np.lexsort(cube.T)
    cube, place, whose = cube[order], place[order] @ ((side + 1) ** 2, side + 1, 1), whose[order]
    starts = np.flatnonzero(np.r_[True, (cube[1:] != cube[:-1]).any(1)])
    first, last = np.minimum.reduceat(first[whose], starts).astype(int), np.maximum.reduceat(last[whose], starts).astype(int)
    for i, j, a, b in zip(starts, [*starts[1:], len(cube)], first, last):
        yield cube[i], place[i:j], slice(a[1], b[1] + 1), slice(a[0], b[0] + 1)


class _Cube:
    """Sums of the truncated distances of a cube's voxels, and of the next cubes' first layers."""

    def __init__(self, voxel: float, trunc: float, side: int):
        self.voxel, self.trunc, self.side, self.wide = voxel, trunc, side, side * BLOCK + 1
        self.total, self.weight = np.zeros((self.wide,) * 3), np.zeros((self.wide,) * 3, np.int32)
        inner, unit = np.array(list(np.ndindex((BLOCK,) * 3))), (self.wide**2, self.wide, 1)
        self.centres, self.at = (inner + 0.5) * voxel, inner @ unit
        #: voxels of a block of the cube, and of a first layer along each axis; which of these a block has, by its place
        self.inner = [np.arange(BLOCK**3), *(np.flatnonzero(inner[:, axis] == 0) for axis in range(3))]
        self.place = np.array(list(np.ndindex((side + 1,) * 3)))
        self.first, last = self.place @ unit * BLOCK, self.place == side
        self.kind = np.where(last.any(1), last.argmax(1) + 1, 0)

    def clear(self) -> None:
        self.total.fill(0)
        self.weight.fill(0)

    def add(self, cube: tuple[int, int, int], view: np.ndarray, blocks: np.ndarray, top: int, left: int, depth: np.ndarray) -> None:
        """A voxel counts if its centre projects into the image onto a measured pixel and lies at most trunc behind it."""
        fx, fy, cx, cy = view[:4]
        r, t = rotation(view[7:]), view[4:7]
        high, wide = depth.shape
        # with a border; beyond it and where nothing is measured, nothing counts
        measured = np.full((high + 2, wide + 2), -np.inf)
        measured[1:-1, 1:-1] = np.where(depth > 0, depth, -np.inf)
        col, row = (np.arange(left - 1, left + wide + 1) - cx) / fx, (np.arange(top - 1, top + high + 1) - cy) / fy
        along = np.sqrt(1 + col**2 + (row**2)[:, None])
        kind = self.kind[blocks]
        base = np.ascontiguousarray((((self.place[blocks] + np.multiply(cube, self.side)) * (BLOCK * self.voxel) - t) @ r).T)
        some = [(mine[i : i + FEW], inner) for k, inner in enumerate(self.inner) for mine in [np.flatnonzero(kind == k)] for i in range(0, len(mine), FEW)]
        for mine, inner in some:
            x, y, z = xyz = np.empty((3, len(mine) * len(inner)))
            np.add(base[:, mine, None], np.ascontiguousarray((self.centres[inner] @ r).T)[:, None], out=xyz.reshape(3, len(mine), -1))
            voxel = (self.first[blocks[mine]][:, None] + self.at[inner]).ravel()
            if z.min() <= 0:
                x, y, z, voxel = (a[z > 0] for a in (x, y, z, voxel))
            for p, f, c, low, most in ((x, fx, cx, left, wide), (y, fy, cy, top, high)):
                p /= z
                p *= f
                p += c
                np.rint(p, out=p)
                p -= low - 1
                np.clip(p, 0, most + 1, out=p)
            y *= wide + 2
            y += x
            pixel = y.astype(np.intp)
            far = measured.ravel()[pixel]
            far -= z
            far *= along.ravel()[pixel]
            near = np.flatnonzero(far > -self.trunc)
            voxel = voxel[near]  # each once
            self.total.ravel()[voxel] += np.minimum(far[near], self.trunc) / self.trunc
            self.weight.ravel()[voxel] += 1

    def blocks(self, env: str, cube: tuple[int, int, int]) -> Iterator[pd.DataFrame]:
        """The blocks that have voxels which count, packed."""
        n = self.side
        total, weight = (a[:-1, :-1, :-1].reshape(n, BLOCK, n, BLOCK, n, BLOCK).transpose(0, 2, 4, 1, 3, 5).reshape(n**3, -1) for a in (self.total, self.weight))
        any_ = np.flatnonzero(weight.any(1))
        for i in range(0, len(any_), STEP):
            some = any_[i : i + STEP]
            tsdf = np.divide(total[some], weight[some], out=np.zeros((len(some), BLOCK**3)), where=weight[some] > 0)
            bx, by, bz = (p + g * n for p, g in zip(np.unravel_index(some, (n,) * 3), cube))
            yield pd.DataFrame({"env": np.full(len(some), env, object), "bx": bx, "by": by, "bz": bz, "tsdf": [x.tobytes() for x in tsdf], "weight": [x.tobytes() for x in weight[some]]})

    def crossings(self, env: str, cube: tuple[int, int, int], edge: float) -> Iterator[pd.DataFrame]:
        """The points where the distance changes sign between a voxel of the cube and its next one along an axis; low: the cube's least along x, y or z."""
        mean = np.divide(self.total, self.weight, out=np.full(self.total.shape, np.nan), where=self.weight > 0)
        mean[~((mean < edge) & (mean >= -edge))] = np.nan
        origin = np.multiply(cube, self.wide - 1)
        found = pd.concat(_crossings(mean[None], np.array([env], object), origin[None].astype(float), self.voxel), ignore_index=True)
        if len(found):
            yield found.assign(low=found.index.isin([found[c].argmin() for c in "xyz"]))


def nearest_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    if image.shape == (height, width):
        return image
    return image[np.arange(height) * image.shape[0] // height][:, np.arange(width) * image.shape[1] // width]


def _stack(arrays: pd.Series, kind: type = np.float64) -> np.ndarray:
    """Packed arrays of one length as rows."""
    return np.frombuffer(b"".join(arrays), kind).reshape(len(arrays), -1)


def _starts(keys: pd.DataFrame) -> np.ndarray:
    """Where a run of equal rows begins."""
    before = keys.shift()
    new = ~((keys == before) | (keys.isna() & before.isna())).all(axis=1).to_numpy(bool)
    new[:1] = True
    return np.flatnonzero(new)


def _by_key(rows: DataFrame, key: tuple[str, ...], *then: str) -> DataFrame:
    """rows with those of a block or cube together, in order: a task reads many as a stream, as a call for each would cost more than its work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).sortWithinPartitions(*key, *then)


def _crossings(grid: np.ndarray, env: np.ndarray, places: np.ndarray, voxel: float) -> Iterator[pd.DataFrame]:
    """Where grids (one more voxel a side than they answer for; NaN: takes no part) of envs at places, in voxels, change sign: some points at a time."""
    n = grid.shape[1] - 1
    here = grid[:, :n, :n, :n]
    for axis in range(3):
        ahead = [slice(0, n)] * 3
        ahead[axis] = slice(1, n + 1)
        nxt = grid[(slice(None), *ahead)]
        at = np.argwhere(here * nxt < 0)
        f0, f1 = np.abs(here[tuple(at.T)]), np.abs(nxt[tuple(at.T)])
        p = at[:, 1:] + 0.5 + places[at[:, 0]]
        p[:, axis] += f0 / (f0 + f1)
        p *= voxel
        yield pd.DataFrame({"env": env[at[:, 0]], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


def _fused(frames: DataFrame, voxel: float, trunc: float, max_range: float, shape: tuple[int, int] | None, halo: bool, out: Callable[[_Cube, str, tuple], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What out makes of each cube of space, after all frames that touch it.

    A frame's pixels are far fewer than the voxels that it touches. So not sums of voxels are shuffled, but pixels: each cube gets those that its own voxels project
    onto, and a task holds the sums of one cube at a time, whatever number of frames there is."""
    side = max(1, round(HELD ** (1 / 3)))
    whole = frames.schema["data"].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    most = max_range * 1000 if whole else np.inf  # pixels beyond are 0
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.float64

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, names = [], 0, [f.split()[0] for f in _PARTS.split(", ")]
        for b in batches:
            for row in b.itertuples(index=False):
                mm = np.asarray(row.data, float).reshape(row.height, row.width)
                mm = nearest_resize(mm, *shape) if shape else mm
                mm = np.where((mm > 0) & (mm / 1000 <= max_range), mm, 0)
                view = np.array([row.fx, row.fy, row.cx, row.cy, *(getattr(row, c) for c in POSE)], float)
                for cube, blocks, v, u in frame_cubes(mm / 1000, tuple(view[:4]), view[4:], voxel, trunc, side, halo):
                    pixels = mm[v, u].astype(kind).tobytes()
                    rows.append((row.env, *cube, view.tobytes(), blocks.astype(np.uint16).tobytes(), v.start, u.start, u.stop - u.start, pixels))
                    held += len(pixels)
                if len(rows) >= 4 * STEP or held > 1 << 24:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, key = _Cube(voxel, trunc, side), None  # the last cube's sums: more of it may come
        for b in batches:
            for *at, view, blocks, top, left, width, pixels in b.itertuples(index=False, name=None):
                if key != at:
                    if key:
                        yield from out(sums, key[0], tuple(key[1:]))
                        sums.clear()
                    key = at
                sums.add(tuple(at[1:]), np.frombuffer(view), np.frombuffer(blocks, np.uint16), top, left, np.frombuffer(pixels, kind).reshape(-1, width) / 1000)
        if key:
            yield from out(sums, key[0], tuple(key[1:]))

    f = frames.where("data is not null").select("env", "height", "width", "data", "fx", "fy", *(F.col(f"camera.{c}").alias(c) for c in POSE), F.col("cx"), F.col("cy"))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _by_key(f.repartition(parts).mapInPandas(deal, _PARTS), _CUBE_KEY).mapInPandas(gather, schema)


def fuse(frames: DataFrame, voxel: float, trunc: float, max_range: float, shape: tuple[int, int] | None = None) -> DataFrame:
    """env, bx, by, bz, tsdf, weight: the mean truncated distance of each voxel over frames (height, width, data in mm, fx, fy, cx, cy, camera), packed in blocks
    of BLOCK voxels a side (arrays in order of x, y, z; weight 0: never seen).

    A frame of another shape is resized to it by nearest pixels; one without depth in range changes nothing."""
    return _fused(frames, voxel, trunc, max_range, shape, False, lambda sums, *at: sums.blocks(*at), "env string, bx int, by int, bz int, tsdf binary, weight binary")


def voxels(volume: DataFrame) -> DataFrame:
    """env, ix, iy, iz, tsdf, weight of the voxels that were seen, from packed blocks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                tsdf, weight = np.frombuffer(r.tsdf), np.frombuffer(r.weight, np.int32)
                at = np.flatnonzero(weight)
                x, y, z = np.unravel_index(at, (BLOCK,) * 3)
                yield pd.DataFrame({"env": np.full(len(at), r.env, object), "ix": r.bx * BLOCK + x, "iy": r.by * BLOCK + y, "iz": r.bz * BLOCK + z, "tsdf": tsdf[at], "weight": weight[at]})

    return volume.mapInPandas(unpack, "env string, ix int, iy int, iz int, tsdf double, weight long")


def surface_points(volume: DataFrame, voxel: float, edge: float = EDGE) -> DataFrame:
    """env, x, y, z where the distance changes sign between a voxel and its neighbour along an axis, by linear interpolation; values at the limit take no part.

    A block goes to itself and its first layers to its three lower neighbours, behind their last; rows of a block's place then hold all the neighbours that it needs."""
    n = BLOCK

    def layers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), STEP):
                some = b.iloc[i : i + STEP]
                a = _stack(some["tsdf"])
                a = np.where((_stack(some["weight"], np.int32) > 0) & (a < edge) & (a >= -edge), a, np.nan).reshape(-1, n, n, n)
                for role, part in enumerate([a, *(np.take(a, 0, axis) for axis in (1, 2, 3))]):
                    part = part.reshape(len(a), -1)
                    any_ = ~np.isnan(part).all(1)  # a layer without values crosses nothing
                    out = some.loc[any_, list(_BLOCK_KEY)].assign(role=np.int32(role), part=[x.tobytes() for x in part[any_]])
                    if role:
                        out["b" + "xyz"[role - 1]] -= 1
                    yield out

    def crossings(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        """Of the blocks whose rows begin at first."""
        group, role = np.repeat(np.arange(len(first)), np.diff([*first, len(rows)])), rows["role"].to_numpy()
        grid = np.full((len(first), *(n + 1,) * 3), np.nan)
        for r in range(4):
            if (role == r).any():
                at = [slice(0, n)] * 3
                if r:
                    at[r - 1] = n
                grid[(group[role == r], *at)] = _stack(rows["part"][role == r]).reshape(-1, *(n,) * (2 if r else 3))
        places = rows[["bx", "by", "bz"]].iloc[first].to_numpy(float) * n
        return pd.concat(_crossings(grid, rows["env"].to_numpy(object)[first], places, voxel))

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last block's rows: more of them may come
        for b in batches:
            for i in range(0, len(b), STEP):
                some = pd.concat([rest, b.iloc[i : i + STEP]], ignore_index=True)
                first = _starts(some[list(_BLOCK_KEY)])
                rest = some.iloc[first[-1] :]
                if len(first) > 1:
                    yield crossings(some.iloc[: first[-1]], first[:-1])
        if rest is not None:
            yield crossings(rest.reset_index(drop=True), np.zeros(1, int))

    parts = volume.mapInPandas(layers, "env string, bx int, by int, bz int, role int, part binary")
    return _by_key(parts, _BLOCK_KEY, "role").mapInPandas(cross, "env string, x double, y double, z double")


def fused_points(frames: DataFrame, voxel: float, trunc: float, max_range: float, shape: tuple[int, int] | None = None, edge: float = EDGE) -> DataFrame:
    """The surface points of the frames' volume, without the volume: a cube also sums up the first layers of the next ones, so no voxel leaves its task.

    low: one of some points that hold the least coordinates of an env."""
    return _fused(frames, voxel, trunc, max_range, shape, True, lambda sums, *at: sums.crossings(*at, edge), "env string, x double, y double, z double, low boolean")


def fused_cloud(frames: DataFrame, voxel: float, trunc: float, max_range: float, shape: tuple[int, int] | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The fused surface, thinned to the mean point of each voxel.

    near adds to points the column near: whether their voxel is wanted, for all of a wanted voxel's points. Of the others only those that set the lattice are stored."""
    points = fused_points(frames, voxel, trunc, max_range, shape)
    points = near(points).where("near or low") if near else points
    return voxel_downsample(stored(points.drop("low"), "fused-points"), voxel, "near" if near else None)
