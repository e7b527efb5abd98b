"""Vectorised word hashing over Arrow string columns: no Python object per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one numpy pass holds; a longer single text is one pass of its own.
SLICE_BYTES = 1 << 19

#: Rows and bytes in an Arrow batch: texts and shingle sets are large, so Spark's default of 10,000 rows takes hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20


def small_batches(spark) -> None:
    """Lower the session's rows and bytes in an Arrow batch to BATCH_ROWS and BATCH_BYTES; a larger single row is a batch of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = _WS.copy()
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables(seed: int) -> tuple[np.ndarray, int]:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    table[_WS] = 0
    return table, int(table[1]) | 1


class _Powers:
    """Powers of an odd base and of its inverse, grown as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inv, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(0, U64), np.ones(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))
        return self.up[:n], self.down[:n]


_SEEDS = (0x51ED2701, 0x2545F491)
_TABLE = [_tables(s) for s in _SEEDS]
_POWERS = [_Powers(b) for _, b in _TABLE]
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of column, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def tidy(run):
    """run, for mapInArrow, giving memory back to the system when a task's rows are through: workers outlive their tasks."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


class Words(NamedTuple):
    """Words of a slice in text order. doc: row in the slice; first: index of each row's first word, with one more at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    h: list[np.ndarray]


def words(texts: pa.Array, lower: bool = False, punct: bool = False, hashes: int = 1) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` (with punct: ASCII punctuation separates as well) with 64-bit hashes; lower folds A-Z in the hash."""
    data, offsets = utf8(texts)
    n = len(data)
    inside = ~(_PUNCT if punct else _WS)[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = []
    for (table, _), powers in zip(_TABLE[:hashes], _POWERS):
        if not len(start):
            out.append(np.zeros(0, U64))
            continue
        up, down = powers.get(n)
        if lower:
            table = table[_FOLD]
        if punct:
            table = np.where(_PUNCT, U64(0), table)
        # separators count nothing, so a sum that runs on to the next word's start is the word's own
        total = np.add.reduceat(table[data] * up, start)
        out.append(mix(total * down[start] + (end - start).astype(U64)))
    return Words(data, start, end, doc, first, out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, in order of row and hash; fewer words: the whole sequence as one."""
    h, rows = w.h[0], len(w.first) - 1
    n = len(h)
    counts = np.diff(w.first)
    full = max(n - k + 1, 0)
    total = np.zeros(full, U64)
    for i in range(k):
        total = total * U64(0x9E3779B97F4A7C15) + h[i : i + full]
    at = np.flatnonzero(w.doc[:full] == w.doc[k - 1 :]) if full else np.zeros(0, np.int64)
    row, value = w.doc[at], mix(total[at] + U64(k))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = []
        for r in short:
            x = 0
            for v in h[w.first[r] : w.first[r + 1]].tolist():
                x = (x * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
            own.append((x + int(counts[r])) & 0xFFFFFFFFFFFFFFFF)
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(np.array(own, U64))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def per_row(ufunc, values: np.ndarray, row: np.ndarray, rows: int, empty: int = 0) -> np.ndarray:
    """ufunc reduced over each row's values (row ascending); rows without values get empty."""
    out = np.full(rows, empty, values.dtype)
    if len(values):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] = ufunc.reduceat(values, at)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
