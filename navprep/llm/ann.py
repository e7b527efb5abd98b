"""Nearest neighbours by cosine: a vantage-point tree per shard, searched for blocks of queries at a time."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ._store import sized, stored

LEAF = 64
SHARD_ROWS, BLOCK_ROWS = 4096, 512
PAIRS = 16_384


class Tree:
    """Unit vectors in the order of a vantage-point tree, equal ones once with their sorted ids; nodes hold the ranges of distances of their two children.

    Rounding: squares of computed chords, and 2 - 2 * score, are within self.error of the true ones (sums of n products in any order, and the norms), so
    chords are within its root.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        raw = np.ascontiguousarray(vectors)
        _, first, entry = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
        by = np.lexsort((ids, entry))
        self.ids, self.raw = ids[by], raw[first]
        at = np.searchsorted(entry[by], np.arange(len(first) + 1))
        x = self.raw.astype(np.float64)
        self.x = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.error = 4.0 * (x.shape[1] + 8) * np.finfo(float).eps
        self.order = np.arange(len(first))
        self.nodes: list[tuple] = []  # (first, past the last) or (first, past the last, near, far, ranges)
        self._build(0, len(first), leaf, np.random.default_rng(7))
        self.x, self.raw = self.x[self.order], self.raw[self.order]
        self.first, self.end = at[:-1][self.order], at[1:][self.order]
        self.least, self.most = self.ids[self.first], self.ids[self.end - 1]

    def _build(self, lo: int, hi: int, leaf: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi))
        if hi - lo > leaf:
            own = self.order[lo:hi]
            pick = rng.integers(len(own))
            own[0], own[pick] = own[pick], own[0]
            d = np.sqrt(_squares(self.x[own[:1]], self.x[own[1:]])[0])
            by = np.argsort(d, kind="stable")  # halves by rank, so that equally far vectors split, too
            own[1:], d = own[1:][by], d[by]
            half = len(d) // 2
            ranges = (d[0], d[half - 1], d[half], d[-1])
            near = self._build(lo + 1, lo + 1 + half, leaf, rng)
            far = self._build(lo + 1 + half, hi, leaf, rng)
            self.nodes[me] = (lo, hi, near, far, ranges)
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of queries, ids, scores) of the k of largest score for each query but its own id, ties to smaller ids."""
        q = queries.astype(np.float64)
        self._q = q / np.sqrt((q * q).sum(1, keepdims=True))
        self._qid, self._k, self._factor = query_ids, k, factor
        self._d2 = np.full((len(q), k), np.inf)
        self._found: list[tuple] = []
        self._visit(0, np.arange(len(q)))
        row, at, d2 = (np.concatenate(x) for x in zip(*self._found))
        ok = d2 <= self._limit(row)
        row, at = row[ok], at[ok]
        score = np.concatenate([np.zeros(0), *(_scores(q[row[i : i + PAIRS]], self.raw[at[i : i + PAIRS]].astype(np.float64)) for i in range(0, len(row), PAIRS))])
        rows, ids, scores = [], [], []
        for i, j, s in zip(row, at, score):
            x = self.ids[self.first[j] : self.end[j]]  # sorted: the first k but the own id, however often that occurs
            lo, hi = np.searchsorted(x, query_ids[i]), np.searchsorted(x, query_ids[i], "right")
            x = np.concatenate([x[: min(lo, k)], x[hi : hi + max(0, k - lo)]])
            rows.append(np.full(len(x), i))
            ids.append(x)
            scores.append(np.full(len(x), s))
        return _first_k(*(np.concatenate([z, *y]) for z, y in ((np.zeros(0, int), rows), (np.zeros(0, self.ids.dtype), ids), (np.zeros(0), scores))), k)

    def _limit(self, qs: np.ndarray) -> np.ndarray:
        """The square of a chord up to which a vector's score can be among the k largest, whatever the rounding."""
        return self._d2[qs, -1] + 4 * self.error

    def _offer(self, qs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        seen = _squares(self._q[qs], self.x[lo:hi])
        qid = self._qid[qs][:, None]
        d2 = np.where((qid == self.least[lo:hi]) & (qid == self.most[lo:hi]), np.inf, seen)  # nothing but the query itself
        self._d2[qs] = np.sort(np.concatenate([self._d2[qs], d2], 1), axis=1)[:, : self._k]
        row, at = np.nonzero(np.isfinite(d2) & (d2 <= self._limit(qs)[:, None]))
        self._found.append((qs[row], at + lo, d2[row, at]))
        return np.sqrt(seen)

    def _visit(self, node: int, qs: np.ndarray) -> None:
        if not len(qs):
            return
        n = self.nodes[node]
        if len(n) == 2:
            if n[1] > n[0]:
                self._offer(qs, n[0], n[1])
            return
        d = self._offer(qs, n[0], n[0] + 1)[:, 0]
        bounds = ((n[4][0], n[4][1]), (n[4][2], n[4][3]))
        first = np.abs(d - n[4][2]) < np.abs(d - n[4][1])  # the far half is nearer
        slack = 6 * np.sqrt(self.error)
        for turn in (0, 1):
            for child in (0, 1):
                mine = (first.astype(int) == child) if turn == 0 else (first.astype(int) != child)
                lo, hi = bounds[child]
                # no point of the child is nearer than the triangle inequality allows; a factor over 1 takes that bound for larger
                least = np.maximum(0.0, np.maximum(d - hi, lo - d)) * self._factor
                self._visit(n[2 + child], qs[mine & (least <= np.sqrt(self._limit(qs)) + slack)])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared chord lengths of unit vectors; chords are a metric in the order of cosine."""
    return np.maximum(0.0, 2.0 - 2.0 * (a @ b.T))


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = table.combine_chunks()
    ids = t.column("id").to_numpy()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]) if len(ids) else np.zeros(0)
    return ids, flat.reshape(len(ids), -1)


def _plant(table):
    ids, v = _matrix(table)
    order = np.argsort(ids, kind="stable")
    return pa.table({"n": table.column("n")[:1], "part": table.column("part")[:1], "tree": pa.array([pickle.dumps(Tree(ids[order], v[order]), 5)], pa.binary())})


def _pack(table):
    return pa.table({"n": table.column("n")[:1], "block": table.column("part")[:1], "queries": pa.array([pickle.dumps(_matrix(table), 5)], pa.binary())})


def _search(k: int, factor: float):
    def run(batches):
        for b in batches:
            for tree, block in zip(b.column("tree"), b.column("queries")):
                t, (ids, v) = pickle.loads(tree.as_py()), pickle.loads(block.as_py())
                row, found, score = t.search(ids, v, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, n of the rows that take part: an id and a vector without null or non-finite components that isn't zero; n is its length."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return d.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).withColumn("n", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest cosine to each row of queries, the query's own id left out, ties to the smaller id.

    Every vector is in one of about count / shard_rows trees (dealt by a hash of the id, so copies of one vector spread). Blocks of queries meet every
    tree. factor 1 searches exactly; a larger one prunes as if the triangle inequality's bound were that much larger: faster, some neighbours missed.
    Rows that aren't usable take no part; vectors of each length are searched among those of that length, as others have no cosine with them; fewer than k candidates give fewer rows; repeated ids are candidates each; an empty table gives no row.
    """
    v, q = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    share = lambda d, most, name: d.groupBy("n").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    shards, blocks = stored(share(v, shard_rows, "shards"), "ann-shards"), stored(share(q, block_rows, "blocks"), "ann-blocks")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    trees = v.join(sized(shards), "n").withColumn("part", part("shards")).groupBy("n", "part").applyInArrow(_plant, "n int, part int, tree binary")
    packs = q.join(sized(blocks), "n").withColumn("part", part("blocks")).groupBy("n", "part").applyInArrow(_pack, "n int, block int, queries binary")
    meet = packs.join(sized(shards), "n").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(trees, ["n", "part"])
    found = meet.select("tree", "queries").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, e.where(F.col("vec_id") % 50 == 0))
