"""Substring deduplication by recompression: rounds of naming pairs and runs give equal passages equal interior symbols.

A name is a hash of its parts, so naming is global without a shuffle, and whether two neighbours form a pair depends on their names alone. Each symbol
carries its context: the words that its forming depended on. Equal windows hold the same symbols with contexts inside them, so the highest of these (by
level, then name) is the same for equal windows: their anchor. Spark counts anchors over documents; only windows of anchors shared by documents are then
named in full (128 bits) and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as T
from ._store import discard, keep_ids, sized, stored

U = np.uint64
WINDOW = 13
LEVELS = 6
#: Bits of the filter that says which anchors are shared, as a power of two. It only saves work: with more anchors than it can tell apart more windows are named.
MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 28
_OUT = np.int64(1) << 40


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return T.mix(a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F) + U(level * 2 + 1))


def anchors(w: T.Words, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of each window; key: the anchor's level in the top 6 bits and 58 bits of its name."""
    n = len(w.doc)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    # best[c]: by first word, the best symbol whose context is exactly c words
    best = np.zeros((window + 1, n + 1), U)
    best[1, :n] = w.h[0] >> U(6)
    name, doc = w.h[0], w.doc
    cl = np.arange(n)
    cr = cl.copy()
    for level in range(1, levels + 1):
        m = len(name)
        if m < 3:
            break
        right = (T.mix(name + U(level)) & U(1)).astype(bool)
        same = doc[1:] == doc[:-1]
        pair = same & ~right[:-1] & right[1:]
        at = np.flatnonzero(pair)
        made = _pair(name[at], name[at + 1], level)
        left, end = cl[at], cr[at + 1]
        _put(best, window, left, end, made, level)
        # what is left: single symbols and runs of one name; their contexts reach to the neighbours
        free = np.ones(m, bool)
        free[at] = False
        free[at + 1] = False
        equal = same & (name[1:] == name[:-1])
        joined = np.zeros(m, bool)
        joined[1:] = equal & free[1:] & free[:-1]
        head = np.flatnonzero(free & ~joined)
        run_end = np.append(np.flatnonzero(free & ~np.append(joined[1:], False)), 0)[:-1]
        length = run_end - head + 1
        reach = lambda i, step: np.where((i + step >= 0) & (i + step < m) & (doc[np.clip(i + step, 0, m - 1)] == doc[i]), i + step, -1)
        l1, r1 = reach(head, -1), reach(run_end, 1)
        l2, r2 = np.where((l1 >= 0) & (name[l1] == name[head]), reach(head, -2), l1), np.where((r1 >= 0) & (name[r1] == name[run_end]), reach(run_end, 2), r1)
        f_cl, f_cr = np.where(l2 >= 0, np.minimum(cl[l2], cl[head]), -_OUT), np.where(r2 >= 0, np.maximum(cr[r2], cr[run_end]), _OUT)
        f_name = np.where(length > 1, T.mix(name[head] + length.astype(U) * U(0x165667B19E3779F9) + U(level * 2)), name[head])
        runs = length > 1
        _put(best, window, f_cl[runs], f_cr[runs], f_name[runs], level)
        order = np.argsort(np.concatenate([at, head]), kind="stable")
        name, doc = np.concatenate([made, f_name])[order], np.concatenate([doc[at], doc[head]])[order]
        cl, cr = np.concatenate([left, f_cl])[order], np.concatenate([end, f_cr])[order]
    top = best[1]
    for c in range(2, window + 1):
        top = np.maximum(np.maximum(top, np.append(top[1:], U(0))), best[c])
    first = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    return first, top[first]


def _put(best: np.ndarray, window: int, left: np.ndarray, end: np.ndarray, name: np.ndarray, level: int) -> None:
    ok = np.flatnonzero((left >= 0) & (end < _OUT) & (end - left < window))
    np.maximum.at(best, (end[ok] - left[ok] + 1, left[ok]), (U(level) << U(58)) | (name[ok] >> U(6)))


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches, "text"):
        w = T.words(b.column("text"), hashes=2)
        n = b.num_rows
        sums = [_text_key(w, n, i) for i in (0, 1)]
        data, offsets = T.utf8(b.column("text"))
        raw = data.tobytes()
        sha = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(n)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), *(pa.array(T.signed(s)) for s in sums), pa.array(sha)], names=["doc_id", "n_words", "t1", "t2", "sha"])


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            w = T.words(b.column("text"))
            first, key = anchors(w, window)
            ids = np.asarray(b.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            doc = w.doc[first]
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, np.int64)
            key, doc = key[change], ids[doc[change]] if len(change) else np.zeros(0, np.int64)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            lo, hi = (doc[at], doc[np.append(at[1:], len(key)) - 1]) if len(key) else (doc, doc)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(key[at])), pa.array(lo), pa.array(hi)], names=["key", "lo", "hi"])

    return run


def _bits(key: np.ndarray, bits: int) -> list[np.ndarray]:
    h = T.mix(key ^ U(0x5BD1E995))
    return [(h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)]


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << (bits - 6), U)
        for b in batches:
            for p in _bits(b.column("key").to_numpy().view(U), bits):
                np.bitwise_or.at(mine, p >> 6, U(1) << (p & 63).astype(U))
        at = np.flatnonzero(mine)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(T.signed(mine[at[i : i + 100_000]]))], names=["word", "mask"])

    return run


def _filter(keys: DataFrame, most: int = MAX_FILTER_BITS) -> tuple[int, np.ndarray]:
    """(bits, words) of a filter of two bits a key; its size is bounded by `most`."""
    n = keys.count()
    bits = int(min(most, max(MIN_FILTER_BITS, np.ceil(np.log2(max(1, n) * 24)))))
    parts = keys.mapInArrow(T.tidy(_filter_words(bits)), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    words = np.zeros(1 << (bits - 6), U)
    table = parts.toArrow()
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(U)
    return bits, words


def _text_key(w: T.Words, rows: int, which: int = 0) -> np.ndarray:
    """A hash of each row's words in order."""
    place = (np.arange(len(w.doc)) - w.first[w.doc]).astype(U)
    return T.per_row(np.add, T.mix(w.h[which] + place * U(0x9E3779B97F4A7C15)), w.doc, rows)


def _window_rows(window: int, repeated: bool, bits: int, words):
    """repeated: whether ids repeat, so that a row is told by its text, too (t; else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for b in T.slices(batches, "text"):
            w = T.words(b.column("text"), hashes=2)
            first, key = anchors(w, window)
            hit = np.ones(len(key), bool)
            for p in _bits(key, bits):
                hit &= (known[p >> 6] >> (p & 63).astype(U)) & U(1) > 0
            first = first[hit]
            names = []
            for h in w.h:
                x = np.zeros(len(first), U)
                for i in range(window):
                    x = x * U(0x9E3779B97F4A7C15) + h[first + i]
                names.append(T.mix(x))
            ids = np.asarray(b.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            doc = w.doc[first]
            t = _text_key(w, b.num_rows) if repeated else np.zeros(b.num_rows, U)
            yield pa.RecordBatch.from_arrays([*(pa.array(T.signed(x)) for x in names), pa.array(ids[doc]), pa.array(T.signed(t[doc])), pa.array((first - w.first[doc]).astype(np.int32))], names=["v1", "v2", "doc_id", "t", "at"])

    return run


def _remover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _text_key(T.words(b.column("text")), b.num_rows)
            n_words, removed, sha, kept_text = [], [], [], []
            for text, t, cuts in zip(b.column("text").to_pylist(), own, b.column("cuts")):
                ws = (text or "").encode().split()
                of, ats = (cuts.values.field(i).to_numpy() for i in (0, 1))
                ats = ats[(of == 0) | (of.view(U) == t)]
                gone = np.zeros(len(ws) + 1, np.int64)
                np.add.at(gone, ats, 1)
                np.add.at(gone, ats + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = b" ".join([x for x, k in zip(ws, keep.tolist()) if k])
                n_words.append(len(ws))
                removed.append(int(len(ws) - keep.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            rest = {c: b.column(c) for c in b.schema.names if c != "cuts"}
            yield pa.RecordBatch.from_pydict(rest | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept_text, pa.string())})

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shape, ids, cuts) for docs of doc_id (not null), text and any other columns.

    shape: doc_id, n_words, sha (of all words joined), copy (all words are those of a smaller doc_id; the id doesn't repeat), a row for each of docs.
    ids: those of all documents but copies that may lose words. cuts: for each row of these all its columns, n_words, n_removed, kept_sha256, kept_text. A
    document that copies another whole needs no comparing: each of its windows starts in the smaller one too, so if it has a window, all its words go.
    Rows of one id never remove each other's words, whether their texts are equal or not.
    """
    T.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    whole = shape = stored(texts.mapInArrow(T.tidy(_shape), "doc_id long, n_words long, t1 long, t2 long, sha string"), "sub-shape")
    firsts = shape.groupBy("t1", "t2", "n_words").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"))
    many = stored(firsts.where("own < last").drop("last"), "sub-firsts")
    twice = stored(shape.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("twice")), "sub-twice")
    repeated = not twice.isEmpty()
    shape = shape.join(many, ["t1", "t2", "n_words"], "left")
    shape = shape.join(twice, "doc_id", "left") if repeated else shape.withColumn("twice", F.lit(None).cast("boolean"))
    thin = shape.select("doc_id", "n_words", "sha", F.coalesce((F.col("own") < F.col("doc_id")) & F.col("twice").isNull(), F.lit(False)).alias("copy"))
    shape = stored(thin, "sub-copies")
    discard(whole, many, twice)
    texts = texts.join(sized(shape.where("copy").select("doc_id")), "doc_id", "left_anti")
    rows = texts.mapInArrow(T.tidy(_anchor_rows(window)), "key long, lo long, hi long")
    keys = stored(rows.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key"), "sub-anchors")
    bits, words = _filter(keys)
    discard(keys)
    named = texts.mapInArrow(T.tidy(_window_rows(window, repeated, bits, spark.sparkContext.broadcast(words))), "v1 long, v2 long, doc_id long, t long, at int")
    least = named.groupBy("v1", "v2").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).where("own < last").drop("last")
    cut = stored(named.join(least, ["v1", "v2"]).where("doc_id > own").select("doc_id", "t", "at"), "sub-cuts")
    cuts = cut.groupBy("doc_id").agg(F.collect_set(F.struct("t", "at")).alias("cuts"))  # of one id: no more than its words
    ids = stored(cut.select("doc_id").distinct(), "sub-ids")
    touched = keep_ids(docs, ids, "doc_id").join(cuts, "doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, kept_sha256 string, kept_text string"
    return shape, ids, touched.select(*docs.columns, "cuts").mapInArrow(T.tidy(_remover(window)), schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: the words that are left when each word goes that a window of `window` words covers whose
    sequence also starts in a document of smaller id.

    A null or empty text has no words. A document shorter than the window keeps all. A row without an id is compared with nothing and keeps all its words.
    Rows that repeat an id get a result each; they don't remove each other's words.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape, ids, cuts = repeats(d.where("doc_id is not null"), window)
    gone = F.col("copy") & (F.col("n_words") >= window)
    out = shape.join(sized(ids), "doc_id", "left_anti").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    rest = d.where("doc_id is null").mapInArrow(T.tidy(_shape), "doc_id long, n_words long, t1 long, t2 long, sha string")
    rest = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return out.unionByName(cuts.select(*out.columns)).unionByName(rest)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
