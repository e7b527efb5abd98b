"""One-permutation MinHash fingerprints of character shingles, densified optimally and packed to low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as T

#: Code points in a shingle; a shorter text is one shingle, filled up.
WIDTH = 8
BINS = 256
BITS = 4
_FILL = "\U0010ffff"
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS = T._Powers(0x9E3779B97F4A7C15)
#: Bins that an empty bin looks into, one attempt after another.
_PROBE = (T.mix(np.arange(BINS * 512, dtype=np.uint64) + np.uint64(77)) % np.uint64(BINS)).astype(np.int64).reshape(512, BINS)


def window_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of each text's windows of WIDTH code points; texts of 1 to WIDTH - 1 are filled up first."""
    padded = [t if not t or len(t) >= WIDTH else t + _FILL * (WIDTH - len(t)) for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _POWERS.get(n)
    c = (c + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    c *= up
    total = np.cumsum(c)
    total[WIDTH:] -= total[:-WIDTH].copy()
    h = T.mix(total[WIDTH - 1 :] * down[: n - WIDTH + 1])
    per = np.maximum(size - WIDTH + 1, 0)
    row = np.repeat(np.arange(len(texts)), per)
    first = np.cumsum(size) - size
    position = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return row, position, h[first[row] + position]


def bin_minima(rows: int, row: np.ndarray, h: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Least hash in each of BINS bins, dealt by the top bits; _EMPTY: none."""
    out = np.full((rows, BINS), _EMPTY) if into is None else into
    np.minimum.at(out.reshape(-1), row * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64((1 << 56) - 1))
    return out


def densify(m: np.ndarray) -> np.ndarray:
    """Each empty bin takes the value of the first full bin among its own sequence of random bins; rows of empty bins stay."""
    out = m.copy()
    row, b = np.nonzero((m == _EMPTY) & (m != _EMPTY).any(1, keepdims=True))
    for t in range(len(_PROBE)):
        if not len(row):
            return out
        got = m[row, _PROBE[t, b]]
        hit = got != _EMPTY
        out[row[hit], b[hit]] = got[hit]
        row, b = row[~hit], b[~hit]
    for r in np.unique(row):  # all but impossible: the next full bin in turn
        full = np.flatnonzero(m[r] != _EMPTY)
        own = b[row == r]
        out[r, own] = m[r, full[np.searchsorted(full, own) % len(full)]]
    return out


def low_bits(m: np.ndarray) -> np.ndarray:
    return (T.mix(m) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(low: np.ndarray, empty: np.ndarray) -> list[str]:
    """Hexadecimal digits, a digit for each bin; a text without shingles: an empty string."""
    both = (low[:, ::2] << 4) | low[:, 1::2]
    return ["" if e else x.tobytes().hex() for x, e in zip(both, empty)]


def likeness(a: np.ndarray, a_empty: np.ndarray, b: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimate of the shingle sets' Jaccard similarity: the share of equal values, less those that agree by chance."""
    chance = 2.0**-BITS
    x = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), x)


class _Slice:
    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.look = batch.column("doc_id"), batch.column("look").to_pylist()
        self.texts = batch.column("text").fill_null("").to_pylist()
        self.row, self.position, self.h = window_hashes(self.texts)
        m = bin_minima(len(self.texts), self.row, self.h)
        self.empty, self.low = (m == _EMPTY).all(1), low_bits(densify(m))

    def result(self, following: _Slice | None) -> pa.RecordBatch | None:
        n = sum(not x for x in self.look)  # look-ahead rows are the last
        if not n:
            return None
        texts, nexts = self.texts, self.texts[1:] + (following.texts[:1] if following else [])
        low, empty = self.low, self.empty
        low_next = np.concatenate([low[1:], following.low[:1]]) if following else low[1:]
        empty_next = np.concatenate([empty[1:], following.empty[:1]]) if following else empty[1:]
        kept = np.array([len(t) - len(t) // 4 for t in texts[:n]], np.int64)
        tails = [x[: len(t) // 4] for t, x in zip(texts[:n], nexts)]
        sha, joints = [], []
        for t, k, tail in zip(texts, kept.tolist(), tails):
            edited = t[:k] + tail
            sha.append(hashlib.sha256(edited.encode()).hexdigest())
            joint = edited if len(edited) < WIDTH else t[max(0, k - WIDTH + 1) : k] + tail
            joints.append(joint if len(edited) < WIDTH or len(joint) >= WIDTH else "")
        # windows wholly within the kept part are those of the text itself; the rest cross or follow the joint
        own = np.flatnonzero(self.row < n)
        own = own[self.position[own] + WIDTH <= kept[self.row[own]]]
        m = bin_minima(n, self.row[own], self.h[own])
        row, _, h = window_hashes(joints)
        m = bin_minima(n, row, h, m)
        e_empty, e_low = (m == _EMPTY).all(1), low_bits(densify(m))
        return pa.RecordBatch.from_arrays(
            [self.ids.slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), pa.array(packed(low[:n], empty[:n])), pa.array(packed(e_low, e_empty)),
             pa.array(likeness(low[:n], empty[:n], e_low, e_empty)), pa.array(likeness(low[:n], empty[:n], low_next[:n], empty_next[:n]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in T.slices(batches, "text", 1 << 20):
        now = _Slice(b)
        if held and (out := held.result(now)):
            yield out
        held = now
    if held and (out := held.result(None)):
        yield out


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents in ranges of ascending doc_id, each range in one partition in order, with the row after the range as a last row of look = true; the row after all is the first.

    Bounds are ids that occur, near the quantiles (their number follows the partitions, not the rows), so each range knows the row that follows it without a window over all rows. Null ids come last."""
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted({b for b in (x["q"] or []) if b > x["least"]})
    array = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    at = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(array, lambda b: b <= F.col("doc_id")))).cast("int")
    ahead = F.when(F.col("doc_id") == F.lit(x["least"]), len(bounds)).when(F.array_contains(array, F.col("doc_id")), at - 1)
    if x["least"] is None:  # no id at all: a text is followed by itself or its like
        ahead = F.lit(0)
    places = F.array_compact(F.array(F.struct(at.alias("at"), F.lit(False).alias("look")), F.when(ahead.isNotNull(), F.struct(ahead.cast("int").alias("at"), F.lit(True).alias("look")))))
    d = docs.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.at", "p.look")
    return d.repartitionById(len(bounds) + 1, F.col("at")).sortWithinPartitions("look", F.col("doc_id").asc_nulls_last(), "text").select("doc_id", "text", "look")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A null text is empty; an empty text has no shingle, an empty fingerprint, and likeness 1 to another empty one and 0 to the rest. Rows of one id stand
    in order of their texts, null ids after all others. A table of one row is followed by itself; an empty table gives an empty result.
    """
    T.small_batches(docs.sparkSession)
    d = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return d.mapInArrow(T.tidy(_run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
