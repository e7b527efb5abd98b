"""Dense maps in packed tiles, so that no task holds a map.

A region is a tile with a halo of its neighbours' cells, or a strip: a tile wide and as long as the map. A stage groups what is addressed to a region, puts it
together as arrays, computes, and cuts its result into pieces for the regions of the next stage. A task's memory follows the region, not the map.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Cells of a tile's side.
SIDE = 256
#: Cells of a map's longest side, for exact distances in 64 bits.
MOST_CELLS = 1 << 19
#: Cells that one step of the distance works on at once.
BLOCK_CELLS = 1 << 19
_KEY = ["env", "tx", "ty"]
_PIECE = "env string, tx int, ty int, num_x int, num_y int, voxel double, x0 int, y0 int, nx int, ny int"


class Shape(NamedTuple):
    """'tile' with a halo, or 'x' or 'y': strips along that axis (their own coordinate of the key is -1)."""

    kind: str
    halo: int = 0


class Region(NamedTuple):
    """x0, y0: the first cell of the arrays; core: (x0, x1, y0, y1) of the cells that are the region's own; more: columns that pieces carry."""

    env: str
    num_x: int
    num_y: int
    voxel: float
    x0: int
    y0: int
    core: tuple[int, int, int, int]
    more: dict[str, Any]

    def own(self, a: np.ndarray) -> np.ndarray:
        x0, x1, y0, y1 = self.core
        return a[x0 - self.x0 : x1 - self.x0, y0 - self.y0 : y1 - self.y0]


def _extent(t: int, n: int, side: int, halo: int = 0) -> tuple[int, int]:
    return (0, n) if t < 0 else (max(0, t * side - halo), min(n, (t + 1) * side + halo))


def _keys(shape: Shape, along: str, lo: int, hi: int, n: int, side: int) -> range:
    """The keys on one axis of the regions that cells lo..hi-1 are part of."""
    if shape.kind == along:
        return range(-1, 0)
    return range(max(0, (lo - shape.halo) // side), min(-(-n // side), (hi - 1 + shape.halo) // side + 1))


def address(cells: DataFrame, params: DataFrame, shape: Shape, column: str, side: int = SIDE) -> DataFrame:
    """Sparse cells (env, ix, iy, column; one row a cell) for the regions that hold them, and a row without a cell for every region of each env's map."""
    p = params.select("env", "num_x", "num_y", "voxel")
    tile = lambda c, d: F.floor((F.col(c) + d) / side).cast("int")
    last = lambda n: F.floor((F.col(n) - 1) / side).cast("int")
    one = F.array(F.lit(-1))

    def near(c: str, n: str, along: str):
        return one if shape.kind == along else F.sequence(F.greatest(tile(c, -shape.halo), F.lit(0)), F.least(tile(c, shape.halo), last(n)))

    def every(n: str, along: str):
        return one if shape.kind == along else F.sequence(F.lit(0), last(n))

    inside = cells.join(p, "env").where("ix >= 0 and ix < num_x and iy >= 0 and iy < num_y")
    own = inside.withColumn("tx", F.explode(near("ix", "num_x", "x"))).withColumn("ty", F.explode(near("iy", "num_y", "y")))
    mark = p.withColumn("tx", F.explode(every("num_x", "x"))).withColumn("ty", F.explode(every("num_y", "y")))
    mark = mark.withColumn("ix", F.lit(None).cast("int")).withColumn("iy", F.lit(None).cast("int")).withColumn(column, F.lit(None).cast(cells.schema[column].dataType))
    names = [*_KEY, "num_x", "num_y", "voxel", "ix", "iy", column]
    return own.select(*names).unionByName(mark.select(*names))


def _assemble(pdf: pd.DataFrame, source: Shape, columns: dict[str, str], side: int, more: tuple[str, ...]) -> tuple[Region, dict[str, np.ndarray]]:
    p = pdf.iloc[0]
    tx, ty, num_x, num_y = (int(p[c]) for c in ("tx", "ty", "num_x", "num_y"))
    (x0, x1), (y0, y1) = _extent(tx, num_x, side, source.halo), _extent(ty, num_y, side, source.halo)
    core = (*_extent(tx, num_x, side), *_extent(ty, num_y, side))
    arrays = {c: np.zeros((x1 - x0, y1 - y0), kind) for c, kind in columns.items()}
    if "ix" in pdf:
        own = pdf[pdf["ix"].notna()]
        at = own["ix"].to_numpy(int) - x0, own["iy"].to_numpy(int) - y0
        for c in columns:
            arrays[c][at] = own[c].to_numpy(columns[c])
    else:
        for i, (px, py, nx, ny) in enumerate(zip(pdf["x0"] - x0, pdf["y0"] - y0, pdf["nx"], pdf["ny"])):
            for c, kind in columns.items():
                arrays[c][px : px + nx, py : py + ny] = np.frombuffer(pdf[c].iloc[i], kind).reshape(nx, ny)
    return Region(p["env"], num_x, num_y, float(p["voxel"]), x0, y0, core, {c: p[c] for c in more}), arrays


def _cut(region: Region, values: dict[str, Any], target: Shape, columns: dict[str, str], numbers: tuple[str, ...], side: int) -> list[tuple]:
    a0, a1, b0, b1 = region.core
    rows = []
    for tx in _keys(target, "x", a0, a1, region.num_x, side):
        for ty in _keys(target, "y", b0, b1, region.num_y, side):
            (x0, x1), (y0, y1) = _extent(tx, region.num_x, side, target.halo), _extent(ty, region.num_y, side, target.halo)
            x0, x1, y0, y1 = max(x0, a0), min(x1, a1), max(y0, b0), min(y1, b1)
            parts = (np.ascontiguousarray(values[c][x0 - a0 : x1 - a0, y0 - b0 : y1 - b0], kind).tobytes() for c, kind in columns.items())
            rows.append((region.env, tx, ty, region.num_x, region.num_y, region.voxel, x0, y0, x1 - x0, y1 - y0, *parts, *(float(values[n]) for n in numbers)))
    return rows


def stage(pieces: DataFrame, source: Shape, columns: dict[str, str], fn: Callable, target: Shape, out: dict[str, str], numbers: tuple[str, ...] = (), more: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """Pieces for target's regions from fn(region, arrays) -> arrays (named and typed by out) of the region's core, and numbers. Pieces may be sparse (of address)."""
    schema = _PIECE + "".join(f", {c} binary" for c in out) + "".join(f", {c} double" for c in numbers)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        region, arrays = _assemble(pdf, source, columns, side, more)
        return pd.DataFrame(_cut(region, fn(region, arrays), target, out, numbers, side), columns=names)

    return pieces.groupBy(*_KEY).applyInPandas(run, schema)


def to_cells(pieces: DataFrame, source: Shape, columns: dict[str, str], fn: Callable, schema: str, more: tuple[str, ...] = (), side: int = SIDE, where: bool = False) -> DataFrame:
    """Rows env, ix, iy and the columns of schema from fn(region, arrays) -> arrays of the region's core. where: only cells where the first of them isn't 0."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        region, arrays = _assemble(pdf, source, columns, side, more)
        values = fn(region, arrays)
        first = values[names[0]]
        at = np.nonzero(first) if where else np.unravel_index(np.arange(first.size), first.shape)
        place = {"env": np.full(len(at[0]), region.env, object), "ix": (at[0] + region.core[0]).astype(np.int32), "iy": (at[1] + region.core[2]).astype(np.int32)}
        return pd.DataFrame(place | {c: values[c][at] for c in names})

    return pieces.groupBy(*_KEY).applyInPandas(run, f"env string, ix int, iy int, {schema}")


def reach(sigma: float) -> int:
    """Cells on each side that a Gaussian of sigma needs."""
    return int(4 * sigma + 0.5) if sigma > 0 else 0


def smooth(a: np.ndarray, region: Region, sigma: float) -> np.ndarray:
    """A separable Gaussian over the region's core from its cells and the halo's, reflected at the map's edges."""
    r = reach(sigma)
    if not r:
        return region.own(a)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis, n, origin, (lo, hi) in ((0, region.num_x, region.x0, region.core[:2]), (1, region.num_y, region.y0, region.core[2:])):
        at = np.arange(lo - r, hi + r) % (2 * n)  # d c b a | a b c d | d c b a
        x = np.take(a, np.where(at < n, at, 2 * n - 1 - at) - origin, axis)
        a = sum(w * np.take(x, np.arange(i, i + hi - lo), axis) for i, w in enumerate(k))
    return a


def along_x(zero: np.ndarray) -> np.ndarray:
    """Cells to the nearest zero along the first axis, -1 where the line has none."""
    n = len(zero)
    at, far = np.arange(n)[:, None], 4 * MOST_CELLS
    back = at - np.maximum.accumulate(np.where(zero, at, -far), 0)
    fore = np.minimum.accumulate(np.where(zero, at, far)[::-1], 0)[::-1] - at
    d = np.minimum(back, fore)
    return np.where(d >= n, -1, d).astype(np.int32)


def far_squared(region: Region) -> int:
    """More than any squared distance of the map: it stands for none."""
    return (region.num_x + region.num_y + 1) ** 2


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over j of f[:, j] + (i - j)**2 for each i, for whole numbers, line by line.

    The least j never falls as i grows, so the middle of a stretch is looked for between the winners at its ends only: n log n steps a line, all lines at once."""
    lines, n = f.shape
    if n > MOST_CELLS:
        raise ValueError(f"maps have at most {MOST_CELLS} cells a side")
    out = np.empty_like(f)
    bits = MOST_CELLS.bit_length()
    for top in range(0, lines, max(1, BLOCK_CELLS // n)):
        g = f[top : top + max(1, BLOCK_CELLS // n)]
        m = len(g)
        win = np.full((m, n + 2), n - 1)  # winners at places 1..n, and the ends of all
        win[:, 0] = 0
        step = 1 << n.bit_length()
        while step > 1:
            half = step // 2
            at = np.arange(half, n + 1, step)
            lo = win[:, at - half]
            hi = win[:, np.minimum(at + half, n + 1)]
            size = (hi - lo + 1).reshape(-1)
            first = np.cumsum(size) - size
            line = np.repeat(np.repeat(np.arange(m), len(at)), size)
            j = np.arange(len(line)) - np.repeat(first - lo.reshape(-1), size)
            i = np.repeat(np.tile(at - 1, m), size)
            best = np.minimum.reduceat(((g[line, j] + (i - j) ** 2) << bits) | j, first).reshape(m, len(at))
            win[:, at] = best & ((1 << bits) - 1)
            out[top : top + m, at - 1] = best >> bits
            step = half
    return out


def squared(d: np.ndarray, region: Region) -> np.ndarray:
    """Squared distances over a strip along y from those along x; far_squared where the map has no zero."""
    f = d.astype(np.int64)
    return lower_envelope(np.where(f < 0, far_squared(region), f * f))
