"""Files of recorded environments: poses, calibration, frames, clouds, maps, logs and lists. An env is the directory that holds its files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import POSE, parse_list, stem_number

LOG_LINE = r"Epoch:\s*(\d+)\s*\|\s*Training Loss:\s*([-+.\deE]+)\s*\|\s*Val Loss:\s*([-+.\deE]+)\s*\|\s*Duration:\s*([-+.\deE]+)"


def _env() -> Column:
    return F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """env and value: whole small text files."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).withColumn("env", _env())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """env, n, line: non-blank lines numbered from 0 in their file's order."""
    kept = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return _texts(spark, path).select("env", F.posexplode(kept).alias("n", "line"))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """env, frame_id, x .. qw from files of one bracketed list a line; a line without seven numbers is an error."""
    v = _lines(spark, path).select("env", F.col("n").cast("long").alias("frame_id"), parse_list(F.trim(F.regexp_replace("line", r"[()\[\]]", " "))).alias("v"))
    v = v.withColumn("v", _sized("v", (7,), "pose"))
    return v.select("env", "frame_id", *(F.col("v")[i].alias(c) for i, c in enumerate(POSE)))


def _sized(name: str, sizes: tuple[int, ...], what: str) -> Column:
    c = F.col(name)
    bad = ~F.size(c).isin(*sizes) | F.exists(c, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: wrong list of "), F.size(c).cast("string"), F.lit(" values")))).otherwise(c)


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """env, k: the 16 values of a 4 x 4 matrix from 12 or 16; other counts are an error."""
    v = _texts(spark, path).select("env", parse_list("value").alias("k")).withColumn("k", _sized("k", (12, 16), "intrinsics"))
    last = F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))
    return v.withColumn("k", F.when(F.size("k") == 12, F.concat("k", last)).otherwise(F.col("k")))


def read_extrinsics(spark: SparkSession, path: str) -> DataFrame:
    """env, extrinsic: a pose struct from a list with the quaternion first."""
    v = _texts(spark, path).select("env", parse_list("value").alias("v")).withColumn("v", _sized("v", (7,), "extrinsics"))
    order = (4, 5, 6, 0, 1, 2, 3)
    return v.select("env", F.struct(*(F.col("v")[i].alias(c) for i, c in zip(order, POSE))).alias("extrinsic"))


def indexed_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """env, frame_id, path, content of the files with an integer name and a suffix of any case. Unused contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select("path", "content").where(F.lower("path").endswith(suffix.lower()))
    return f.withColumn("env", _env()).withColumn("frame_id", stem_number(F.col("path"))).where("frame_id is not null")


# Fixed values of the PNG format: channels by colour type; first row and column, and steps, of the seven passes of an interlaced image.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


class BadImage(ValueError):
    """Why a file is no image."""


def _samples(raw: bytes, at: int, height: int, width: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """(rows of samples, where the next begins) of a filtered image part."""
    size, step = (width * channels * bits + 7) // 8, max(1, channels * bits // 8)
    if at + height * (size + 1) > len(raw):
        raise BadImage("data end early")
    rows = np.frombuffer(raw, np.uint8, height * (size + 1), at).reshape(height, size + 1)
    out = np.zeros((height, size), np.uint8)
    above = np.zeros(size, np.uint8)
    for i, row in enumerate(rows):
        out[i] = above = _unfilter(int(row[0]), row[1:], above, step)
    if bits == 16:
        samples = out.view(">u2").astype(np.int32)
    elif bits == 8:
        samples = out.astype(np.int32)
    else:  # several samples in a byte, the first in its high bits
        each = np.unpackbits(out, axis=1).reshape(height, -1, bits)
        samples = (each * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.int32)
    return samples[:, : width * channels].reshape(height, width, channels), at + height * (size + 1)


def png_pixels(data: bytes) -> np.ndarray:
    """Grey values of a PNG of any colour type and depth, interlaced or not: grey as it is (depths below 8 bits spread over 0..255), colour as
    0.299 red + 0.587 green + 0.114 blue, rounded; transparency is left out. BadImage says what is wrong with other data."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise BadImage("no PNG")
    at, body, head, palette = 8, [], None, None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3).astype(np.int32)
            elif kind == b"IDAT":
                body.append(part)
            at += 12 + size
        raw = zlib.decompress(b"".join(body))
    except (struct.error, zlib.error) as e:
        raise BadImage(f"broken: {e}") from None
    if head is None:
        raise BadImage("no header")
    width, height, bits, color, _, _, interlaced = head
    if color not in CHANNELS or bits not in (1, 2, 4, 8, 16) or interlaced > 1 or not width * height:
        raise BadImage(f"colour type {color} of {bits} bits")
    n = CHANNELS[color]
    image, at = np.zeros((height, width, n), np.int32), 0
    for y, x, down, right in PASSES if interlaced else ((0, 0, 1, 1),):
        h, w = len(range(y, height, down)), len(range(x, width, right))
        if h and w:
            image[y::down, x::right], at = _samples(raw, at, h, w, bits, n)
    if color == 3:
        if palette is None or image.max() >= len(palette):
            raise BadImage("palette too short")
        image = palette[image[..., 0]]
    elif bits < 8:
        image = image * (255 // ((1 << bits) - 1))
    if image.shape[2] < 3:
        return image[..., 0]
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.int32)


def decode_png(data: bytes) -> np.ndarray | None:
    """png_pixels, or None for what is no image."""
    try:
        return png_pixels(data)
    except BadImage:
        return None


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise BadImage("unknown filter")
    x, up, out = row.tolist(), above.tolist(), [0] * len(row)
    for i, v in enumerate(x):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:  # the neighbour nearest to the plane's estimate; ties: left, above, corner
            guess = min((left, up[i], corner), key=lambda n: abs(left + up[i] - corner - n))
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A 16-bit grey PNG."""
    rows = np.ascontiguousarray(image, ">u2").view(np.uint8).reshape(image.shape[0], -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def skipped_frames(spark: SparkSession, path: str) -> DataFrame:
    """env, frame_id, reason of the PNG files that read_depth_frames skips. Files without a byte are in neither, as Spark lists none."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for env, frame, content in b.itertuples(index=False):
                try:
                    png_pixels(content)
                except BadImage as e:
                    bad.append((env, frame, str(e)))
            yield pd.DataFrame(bad, columns=["env", "frame_id", "reason"])

    return indexed_files(spark, path, ".png").select("env", "frame_id", "content").mapInPandas(judge, "env string, frame_id long, reason string")


def read_depth_frames(spark: SparkSession, path: str) -> DataFrame:
    """env, frame_id, height, width, data (mm, row by row) of PNG files; files that can't be decoded are skipped (skipped_frames says why)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [decode_png(c) for c in b["content"]]
            ok = [i for i, m in enumerate(images) if m is not None]
            kept = b.iloc[ok][["env", "frame_id"]].reset_index(drop=True)
            data = pd.Series([images[i].reshape(-1) for i in ok], dtype=object)  # a type for no rows, too
            yield kept.assign(height=[images[i].shape[0] for i in ok], width=[images[i].shape[1] for i in ok], data=data)

    return indexed_files(spark, path, ".png").select("env", "frame_id", "content").mapInPandas(decode, "env string, frame_id long, height int, width int, data array<int>")


def decode_raw(encoding: str, height: int, width: int, step: int, big: bool, data: bytes) -> np.ndarray:
    """Rows of padded length step to height x width (x 3, blue first): 16 bits become metres; an unknown encoding is an error."""
    kinds = {"32fc1": ("f4", 1), "32fc": ("f4", 1), "16uc1": ("u2", 1), "mono16": ("u2", 1), "8uc1": ("u1", 1), "mono8": ("u1", 1), "bgr8": ("u1", 3), "rgb8": ("u1", 3), "bgra8": ("u1", 4), "rgba8": ("u1", 4)}
    name = encoding.lower()
    if name not in kinds:
        raise ValueError(f"unsupported encoding {encoding}")
    kind, channels = kinds[name]
    item = np.dtype((">" if big else "<") + kind)
    flat = np.frombuffer(data, np.uint8).reshape(height, step)[:, : width * channels * item.itemsize]
    image = np.ascontiguousarray(flat).view(item).reshape(height, width, channels)
    if channels == 1:
        return image[..., 0].astype(np.float32) / 1000 if kind == "u2" else image[..., 0].astype(np.float32)
    return (image[..., 2::-1] if name.startswith("rgb") else image[..., :3]).astype(np.float32)


def decode_raw_images(messages: DataFrame) -> DataFrame:
    """bag, msg_idx, height, width, channels, data of message buffers (encoding, height, width, step, is_bigendian, data)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [decode_raw(*r) for r in b[["encoding", "height", "width", "step", "is_bigendian", "data"]].itertuples(index=False)]
            yield b[["bag", "msg_idx", "height", "width"]].assign(channels=[1 if m.ndim == 2 else 3 for m in images], data=[m.reshape(-1) for m in images])

    m = messages.select("bag", "msg_idx", "encoding", "height", "width", "step", "is_bigendian", "data")
    return m.mapInPandas(decode, "bag string, msg_idx long, height int, width int, channels int, data array<float>")


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def decode_ply(data: bytes) -> np.ndarray:
    """x, y, z of the vertices of a text or little-endian PLY whose first element they are."""
    head, _, body = data.partition(b"end_header\n")
    fields, count, kind, inside = [], 0, "", False
    for words in (line.split() for line in head.decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            fields.append((words[2], "<" + _PLY[words[1]]))
    if not count:
        return np.zeros((0, 3))
    if kind == "ascii":
        rows = np.array([line.split()[: len(fields)] for line in body.decode("ascii").splitlines()[:count]], float)
        return rows[:, [[n for n, _ in fields].index(c) for c in "xyz"]]
    if kind != "binary_little_endian":
        raise ValueError(f"unsupported PLY format {kind}")
    rows = np.frombuffer(body, np.dtype(fields), count)
    return np.stack([rows[c].astype(float) for c in "xyz"], 1)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """env, frame_id, x, y, z of PLY clouds; empty clouds give no row, points with NaN go."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for env, frame, content in zip(b["env"], b["frame_id"], b["content"]):
                p = decode_ply(content)
                p = p[~np.isnan(p).any(1)]
                yield pd.DataFrame({"env": env, "frame_id": frame, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return indexed_files(spark, path, ".ply").select("env", "frame_id", "content").mapInPandas(decode, "env string, frame_id long, x double, y double, z double")


def write_map(cells: DataFrame, params: DataFrame, path: str, column: str = "value") -> None:
    """For each env a text matrix (a line for each ix; cells that aren't listed are 0) and four lines of voxel, start_x, start_y, clear_dist."""
    rows = params.select("env", "num_y", F.explode(F.sequence(F.lit(0), F.col("num_x") - 1)).alias("ix"))
    given = cells.groupBy("env", "ix").agg(F.map_from_entries(F.collect_list(F.struct("iy", F.col(column).cast("double").alias("v")))).alias("m"))
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("string")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("num_y") - 1), value), " ")
    out = rows.join(given, ["env", "ix"], "left").select("env", "ix", line.alias("value"))
    out.repartition("env").sortWithinPartitions("env", "ix").select("env", "value").write.partitionBy("env").mode("overwrite").text(f"{path}/map")
    four = F.concat_ws("\n", *(F.col(c).cast("string") for c in ("voxel", "start_x", "start_y", "clear_dist")))
    params.select("env", four.alias("value")).repartition("env").write.partitionBy("env").mode("overwrite").text(f"{path}/params")


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells env, ix, iy, value; params) as write_map left them."""
    name = F.regexp_replace("env", "^env=", "")
    lines = _lines(spark, f"{path}/map/*").select(name.alias("env"), F.col("n").alias("ix"), F.split(F.trim("line"), r"\s+").alias("v"))
    cells = lines.select("env", "ix", F.posexplode("v").alias("iy", "value")).withColumn("value", F.col("value").cast("double"))
    sizes = lines.groupBy("env").agg((F.max("ix") + 1).alias("num_x"), F.max(F.size("v")).alias("num_y"))
    p = _lines(spark, f"{path}/params/*").groupBy(name.alias("env")).agg(*(F.max(F.when(F.col("n") == i, F.col("line").cast("double"))).alias(c) for i, c in enumerate(("voxel", "start_x", "start_y", "clear_dist"))))
    return cells, sizes.join(p, "env")


def write_training_env(frames: DataFrame, path: str, start: int = 0, end: int | None = None) -> None:
    """Frames of the id range, numbered from 0, as Parquet by env; what an env held before goes, other envs stay."""
    f = frames.where(F.col("frame_id") >= start)
    f = f if end is None else f.where(F.col("frame_id") < end)
    f = f.withColumn("frame_id", F.col("frame_id") - start)
    f.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env").parquet(path)


def write_reports(reports: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON by bag; existing reports are an error unless overwrite is asked for."""
    reports.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("bag").json(path)


def write_votes(votes: DataFrame, stats: DataFrame, path: str) -> None:
    """All vote layers as Parquet by env, and the statistics as JSON."""
    votes.write.mode("overwrite").partitionBy("env").parquet(f"{path}/votes")
    stats.write.mode("overwrite").json(f"{path}/stats")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, train_loss, val_loss, duration; other lines are skipped. The run is the log's directory."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.col("value").rlike(LOG_LINE))
    part = lambda i, kind: F.regexp_extract("value", LOG_LINE, i).cast(kind)
    return t.select(_env().alias("run"), part(1, "long").alias("epoch"), part(2, "double").alias("train_loss"), part(3, "double").alias("val_loss"), part(4, "double").alias("duration"))


def write_env_list(envs: DataFrame, path: str) -> None:
    """Environments, one a line, in order of name: they are few."""
    envs.select(F.col("env").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_env_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("env")).where("env <> ''")
