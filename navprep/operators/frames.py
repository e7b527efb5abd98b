"""Depth and colour frames: rows env, frame_id, height, width, data (row by row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import points as P
from .scoring import best_shift, correlations, spectrum
from .tables import stored


def clean_depth(data: Column, scale: float = 1000.0, max_depth: float = 10.0) -> Column:
    """Metres; null, non-finite and values beyond max_depth become 0."""

    def one(x: Column) -> Column:
        v = x.cast("double") / scale
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v > max_depth), 0.0).otherwise(v)

    return F.transform(data, one)


def encode_mm(data: Column, rounded: bool) -> Column:
    """Metres to 0..65535 mm: rounded half to even and clipped, or cut off towards zero."""
    if rounded:
        return F.transform(data, lambda x: F.least(F.greatest(F.rint(x * 1000), F.lit(0.0)), F.lit(65535.0)).cast("int"))
    return F.transform(data, lambda x: (x * 1000).cast("int").bitwiseAND(65535))


def rotate_180(frames: DataFrame) -> DataFrame:
    return frames.withColumn("data", F.reverse("data"))


def _rearranged(frames: DataFrame, source) -> DataFrame:
    i = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    return frames.withColumn("data", F.transform(i, lambda k: F.get("data", source(F.floor(k / F.col("width")), k % F.col("width")).cast("int"))))


def flip_horizontal(frames: DataFrame) -> DataFrame:
    return _rearranged(frames, lambda v, u: v * F.col("width") + F.col("width") - 1 - u)


def flip_vertical(frames: DataFrame) -> DataFrame:
    return _rearranged(frames, lambda v, u: (F.col("height") - 1 - v) * F.col("width") + u)


def roll(frames: DataFrame, down: Column, right: Column) -> DataFrame:
    """Circular shift of each frame."""
    return _rearranged(frames, lambda v, u: F.pmod(v - down, F.col("height")) * F.col("width") + F.pmod(u - right, F.col("width")))


def sample_pixels(frames: DataFrame, stride: int, ignore_bottom: int = 0, low: float = 0.0, high: float = float("inf"), scale: float = 1000.0) -> DataFrame:
    """All other columns of frames with u, v, depth of the pixels of the grid whose depth lies in [low, high].

    Pixels are picked inside the array, so a row that leaves it doesn't carry the frame."""
    rows = F.filter(F.sequence(F.lit(0), F.col("height"), F.lit(stride)), lambda v: v < F.col("height") - ignore_bottom)
    cols = F.filter(F.sequence(F.lit(0), F.col("width"), F.lit(stride)), lambda u: u < F.col("width"))
    at = lambda v, u: F.struct(u.alias("u"), v.alias("v"), (F.get("data", v * F.col("width") + u).cast("double") / scale).alias("depth"))
    picked = F.filter(F.flatten(F.transform(rows, lambda v: F.transform(cols, lambda u: at(v, u)))), lambda p: (p["depth"] >= low) & (p["depth"] <= high))
    rest = [c for c in frames.columns if c not in ("data", "height", "width")]
    return frames.select(*rest, F.explode(picked).alias("p")).select(*rest, "p.u", "p.v", "p.depth")


def depth_cloud(frames: DataFrame, voxel: float, stride: int = 1, low: float = 0.2, high: float = 10.0, legacy: bool = False) -> DataFrame:
    """Mean point of each voxel over all pixels of low to high metres. frames carry fx, fy, cx, cy and camera (a pose struct).

    legacy: as the published job has it, other pixels stand a millimetre before the camera, and each env has a frame's worth of points at the world's origin."""
    px = sample_pixels(frames, stride, 0, *((low, high) if not legacy else (float("-inf"), float("inf"))))
    if legacy:
        px = px.withColumn("depth", F.when((F.col("depth") < low) | (F.col("depth") > high), 0.001).otherwise(F.col("depth")))
    pts = P.back_project(px, *(F.col(c) for c in ("fx", "fy", "cx", "cy")), F.col("camera")).select("env", "x", "y", "z")
    if legacy:
        n = frames.groupBy("env").agg(F.max(F.col("height") * F.col("width")).alias("n"))
        pts = pts.unionByName(n.select("env", F.explode(F.array_repeat(F.lit(0.0), F.col("n"))).alias("x")).select("env", "x", F.col("x").alias("y"), F.col("x").alias("z")))
    return P.voxel_downsample(pts, voxel)


def crop_params(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """The centred crop of the target's aspect (half-even rounding) and the scales to the target."""
    aspect = target_w / target_h
    wide = width / height > aspect
    w = F.when(wide, F.rint(height * aspect)).otherwise(width).cast("int")
    h = F.when(wide, height).otherwise(F.rint(width / aspect)).cast("int")
    half = lambda a, b: F.floor((a - b) / 2).cast("int")
    return F.struct(half(width, w).alias("x"), half(height, h).alias("y"), w.alias("w"), h.alias("h"), (F.lit(float(target_w)) / w).alias("scale_x"), (F.lit(float(target_h)) / h).alias("scale_y"))


def rescale_projection(p: Column, crop: Column) -> Column:
    """A 3 x 4 projection (12 values) for the cropped and scaled image."""

    def one(x: Column, i: Column) -> Column:
        row, col = F.floor(i / 4), i % 4
        shift = F.when(col == 2, F.when(row == 0, crop["x"]).when(row == 1, crop["y"])).otherwise(0)
        scale = F.when(row == 0, crop["scale_x"]).when(row == 1, crop["scale_y"]).otherwise(1.0)
        return (x - F.coalesce(shift, F.lit(0))) * scale

    return F.transform(p, one)


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n: the share of each of n cells in each of m, by the length of their overlap."""
    edge = np.arange(m + 1) * n / m
    lo, hi = np.arange(n), np.arange(1, n + 1)
    cover = np.clip(np.minimum(edge[1:, None], hi) - np.maximum(edge[:-1, None], lo), 0, None)
    return cover / cover.sum(1, keepdims=True)


def shrink_depth(depth: np.ndarray, target_w: int, target_h: int) -> np.ndarray:
    """Millimetres of the area mean of valid pixels (finite, above 0), 0 where none is."""
    ok = np.isfinite(depth) & (depth > 0)
    rows, cols = area_weights(depth.shape[0], target_h), area_weights(depth.shape[1], target_w)
    total, cover = rows @ np.where(ok, depth, 0.0) @ cols.T, rows @ ok.astype(float) @ cols.T
    mean = np.divide(total, cover, out=np.zeros_like(total), where=cover > 1e-6)
    return np.clip(np.rint(mean * 1000), 0, 65535).astype(np.int32)


def crop_resize(frames: DataFrame, target_w: int, target_h: int, color: bool = False) -> DataFrame:
    """Frames centred, cropped and shrunk by area means: depth in metres to mm, or colour (channels last, three values a pixel; grey is repeated; null data give black)."""
    f = frames.withColumn("crop", crop_params(F.col("width"), F.col("height"), target_w, target_h))
    f = f.select("env", "frame_id", "height", "width", "data", *(F.col(f"crop.{c}").alias(f"c{c}") for c in "xywh"))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, data, x, y, cw, ch in b[["height", "width", "data", "cx", "cy", "cw", "ch"]].itertuples(index=False):
                if data is None:
                    out.append(np.zeros(target_h * target_w * (3 if color else 1), np.int32))
                    continue
                image = np.asarray(data, float).reshape(h, w, -1)[y : y + ch, x : x + cw]
                if not color:
                    out.append(shrink_depth(image[..., 0], target_w, target_h).reshape(-1))
                    continue
                image = np.repeat(image, 3, 2) if image.shape[2] == 1 else image
                small = np.einsum("ij,jkc,lk->ilc", area_weights(ch, target_h), image, area_weights(cw, target_w))
                out.append(np.clip(np.rint(small), 0, 255).astype(np.int32).reshape(-1))
            yield b[["env", "frame_id"]].assign(height=target_h, width=target_w, data=out)

    return f.mapInPandas(shrink, "env string, frame_id long, height int, width int, data array<int>")


def camera_info(calibration: DataFrame) -> DataFrame:
    """camera, width, height, k, p, d of calibration rows; rows without a positive size and focal lengths are rejected."""
    at = lambda *names: F.array(*(F.col(n).cast("double") if isinstance(n, str) else F.lit(float(n)) for n in names))
    ok = calibration.where("width > 0 and height > 0 and fx > 0 and fy > 0")
    k = at("fx", "skew", "cx", 0, "fy", "cy", 0, 0, 1)
    p = at("fx", "skew", "cx", 0, 0, "fy", "cy", 0, 0, 0, 1, 0)
    return ok.select("camera", "width", "height", k.alias("k"), p.alias("p"), F.col("distortion").alias("d"))


def split_tiles(frames: DataFrame, h: int, w: int, centre: bool = False) -> DataFrame:
    """Tiles (env, frame_id, tile, data) of a frame in row order, parts that don't fill a tile left out; with centre also the centred crop, as the last tile."""
    down, across = F.floor(F.col("height") / h).cast("int"), F.floor(F.col("width") / w).cast("int")
    cut = lambda y, x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.slice("data", (y + i) * F.col("width") + x + 1, F.lit(w))))
    tiles = F.transform(F.sequence(F.lit(0), down * across - 1), lambda t: cut(F.floor(t / across).cast("int") * h, (t % across).cast("int") * w))
    if centre:
        tiles = F.concat(tiles, F.array(cut(F.floor((F.col("height") - h) / 2).cast("int"), F.floor((F.col("width") - w) / 2).cast("int"))))
    return frames.select("env", "frame_id", F.posexplode(tiles).alias("tile", "data"))


def merge_tiles(tiles: DataFrame, height: int, width: int, h: int, w: int) -> DataFrame:
    """Frames of height x width from their tiles (a tile that is missing leaves zeros)."""
    across = width // w
    whole = tiles.where(F.col("tile") < (height // h) * across).groupBy("env", "frame_id").agg(F.map_from_entries(F.collect_list(F.struct("tile", "data"))).alias("m"))

    def pixel(k: Column) -> Column:
        y, x = F.floor(k / width).cast("int"), (k % width).cast("int")
        tile = F.try_element_at("m", (F.floor(y / h) * across + F.floor(x / w)).cast("int"))
        return F.coalesce(F.get(tile, (y % h) * w + x % w), F.lit(0))

    data = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), pixel)
    return whole.select("env", "frame_id", F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"))


def worst_patch(pairs: DataFrame, h: int, w: int, stride_h: int, stride_w: int) -> DataFrame:
    """pair_id, value, row, col: the window of the largest mean absolute difference of two frames a and b (height, width), the first in row order of equals."""
    diff = pairs.select("pair_id", "height", "width", F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))).alias("d"))
    rows = F.filter(F.sequence(F.lit(0), F.col("height"), F.lit(stride_h)), lambda y: y + h <= F.col("height"))
    cols = F.filter(F.sequence(F.lit(0), F.col("width"), F.lit(stride_w)), lambda x: x + w <= F.col("width"))
    row_sum = lambda y, x: F.aggregate(F.slice("d", y * F.col("width") + x + 1, F.lit(w)), F.lit(0.0), lambda s, v: s + v)
    total = lambda y, x: F.aggregate(F.sequence(F.lit(0), F.lit(h - 1)), F.lit(0.0), lambda s, i: s + row_sum(y + i, x))
    windows = F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct((total(y, x) / (h * w)).alias("value"), (-y).alias("up"), (-x).alias("left")))))
    best = diff.select("pair_id", F.array_max(windows).alias("m"))
    return best.select("pair_id", "m.value", (-F.col("m.up")).alias("row"), (-F.col("m.left")).alias("col"))


def motion_blur(frames: DataFrame, shares: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 0) -> DataFrame:
    """Each frame unchanged, or blurred along one of four directions over 3 or 5 pixels (zeros beyond the edge), by these shares. Drawn from a hash of env, frame_id and seed: reruns agree.

    Rows and columns are means; diagonals are sums, as their kernels are unit matrices that aren't divided by their size. Steps along a direction are shifts of the array, so no frame leaves the JVM."""
    draw = lambda salt: F.pmod(F.xxhash64("env", "frame_id", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    f = frames.withColumn("reach", F.when(draw(0) < shares[0], 0).when(draw(0) < shares[0] + shares[1], 1).otherwise(2)).withColumn("way", F.floor(draw(1) * 4).cast("int"))
    dy = F.when(F.col("way") == 0, 0).when(F.col("way") == 3, -1).otherwise(1)
    dx = F.when(F.col("way") == 1, 0).otherwise(1)

    def pixel(k: Column) -> Column:
        y, x = F.floor(k / F.col("width")).cast("int"), (k % F.col("width")).cast("int")

        def at(i: Column) -> Column:
            v, u = y + i * dy, x + i * dx
            inside = (v >= 0) & (v < F.col("height")) & (u >= 0) & (u < F.col("width"))
            return F.when(inside, F.get("data", v * F.col("width") + u).cast("double")).otherwise(0.0)

        return F.aggregate(F.sequence(-F.col("reach"), F.col("reach")), F.lit(0.0), lambda s, i: s + at(i)) / F.when(F.col("way") < 2, 2 * F.col("reach") + 1).otherwise(1)

    plain = F.transform("data", lambda x: x.cast("double"))
    return f.withColumn("data", F.when(F.col("reach") == 0, plain).otherwise(F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), pixel))).drop("way")


def _image(data, h: int, w: int) -> np.ndarray:
    return np.asarray(data, float).reshape(-1, h, w)


def best_shifts(pairs: DataFrame) -> DataFrame:
    """pair_id, value, down, right, still, loss: the largest circular correlation of two frames a and b (height, width; one or more channels, one after another)
    over both norms, b's shift against a that gives it, the value without a shift, and (1 - value) / 2. No mean is taken off. A frame of zeros has value 0."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, x, y in b[["height", "width", "a", "b"]].itertuples(index=False):
                x, y = _image(x, h, w), _image(y, h, w)
                scale = float(np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
                c = correlations(spectrum(x), spectrum(y), (h, w))
                value, i, j = best_shift(c, scale)
                out.append((value, i, j, float(np.clip(c[0, 0] / scale, -1, 1)) if scale > 0 else 0.0, (1 - value) / 2))
            yield pd.concat([b[["pair_id"]], pd.DataFrame(out, columns=["value", "down", "right", "still", "loss"], index=b.index)], axis=1)

    return pairs.select("pair_id", "height", "width", "a", "b").mapInPandas(one, "pair_id long, value double, down int, right int, still double, loss double")


#: Frames of each side that meet in a task.
SHIFT_BLOCK = 64


def pairwise_shifts(x: DataFrame, y: DataFrame, block: int = SHIFT_BLOCK) -> DataFrame:
    """x_id, y_id, value, down, right of every frame of x (id, height, width, data) with every one of y of equal size: y is a stated set to hold x against.

    Each frame's spectrum is taken once; blocks of both sides meet, so that a task holds two blocks, whatever the sides hold."""
    schema = "id long, height int, width int, channels int, norm double, spectrum binary"

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [_image(d, h, w) for h, w, d in b[["height", "width", "data"]].itertuples(index=False)]
            yield b[["id", "height", "width"]].assign(channels=[len(i) for i in images], norm=[float(np.sqrt((i * i).sum())) for i in images], spectrum=[spectrum(i).tobytes() for i in images])

    sides = [stored(s.where("data is not null").select("id", "height", "width", "data").mapInPandas(spectra, schema), "shift-spectra") for s in (x, y)]
    n = [max(1, -(-s.count() // block)) for s in sides]
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(n[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    left = sides[0].withColumn("bx", own(0)).withColumn("by", every(1))
    right = sides[1].withColumn("by", own(1)).withColumn("bx", every(0))
    keys = ("bx", "by", "height", "width", "channels")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            h, w, c = (int(a[k].iloc[0]) for k in ("height", "width", "channels"))
            read = lambda s: np.frombuffer(s, complex).reshape(c, h, w // 2 + 1)
            others = np.stack([read(s) for s in b["spectrum"]])
            for i, norm, s in a[["id", "norm", "spectrum"]].itertuples(index=False):
                for j, other, surface in zip(b["id"], b["norm"], correlations(read(s), others, (h, w))):
                    out.append((i, j, *best_shift(surface, norm * other)))
        return pd.DataFrame(out, columns=["x_id", "y_id", "value", "down", "right"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "x_id long, y_id long, value double, down int, right int")
