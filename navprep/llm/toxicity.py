"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _text as T
from ._store import stored

U = np.uint64
#: At most so many labelled rows are learned from (those of least hash); labels beyond it are held back, texts never are. So it bounds the words with a weight.
MAX_LABELS = 500_000
#: Texts' worth of each word's Dirichlet prior, dealt to the two classes by their shares of all counts.
PRIOR = 2.0
#: Posterior standard deviations by which log-odds are drawn towards none.
SURE = 2.0
#: Added to every token's log-odds, so that a segment must earn its length; a word without a label has this score alone.
DRIFT = -0.7
#: Most evidence of a text: beyond it nothing is more certain, and the logistic fit is of the texts in doubt.
MOST = 40.0
#: The extreme-value scale is counted from segments of at least TAIL / lam.
TAIL = 3.0
FOLDS = 5


class Model(NamedTuple):
    """Words' hashes (sorted) and weights (log-odds and drift); lam, k: E = k * n * exp(-lam * S) segments of score S are expected in n clean words; a, b: logistic of the evidence."""

    words: np.ndarray
    weights: np.ndarray
    lam: float
    k: float
    a: float
    b: float


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _gather(h: np.ndarray, n: np.ndarray, limit: int, held: list) -> tuple[np.ndarray, np.ndarray] | None:
    """Collects (hash, counts) blocks and returns their sum when enough are held."""
    held.append((h, n))
    if sum(len(x) for x, _ in held) < limit:
        return None
    return _summed(held)


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
    held.clear()
    own, at = np.unique(h, return_inverse=True)
    return own, np.stack([np.bincount(at, n[:, j], len(own)).astype(np.int64) for j in range(n.shape[1])], 1) if len(own) else n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    out = lambda h, n: pa.RecordBatch.from_arrays([pa.array(T.signed(h)), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["h", "toxic", "clean"])
    for b in T.slices(batches, "text"):
        w = T.words(b.column("text"), lower=True, punct=True)
        row, h = T.shingles(w, 1)  # each word once a text, so that one text's repetitions prove little
        y = np.asarray(b.column("toxic").to_numpy(zero_copy_only=False), np.int64)[row]
        h, at = np.unique(h, return_inverse=True)
        n = np.stack([np.bincount(at, y, len(h)), np.bincount(at, 1 - y, len(h))], 1).astype(np.int64) if len(h) else np.zeros((0, 2), np.int64)
        if got := _gather(h, n, 1_000_000, held):
            yield out(*got)
    if held:
        yield out(*_summed(held))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) in linear time (Ruzzo and Tompa). Segments have positive scores and are disjoint."""
    found: list[tuple[int, int, float, float]] = []  # first, past the last, sum before, sum up to the end
    best: list[int] = []  # for each found segment the nearest earlier one with a smaller sum before it, -1: none
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, right = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = best[j]
            if j < 0 or found[j][3] >= right:
                best.append(j)
                found.append((first, i + 1, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:], best[j:]
    return [(f, t, r - l) for f, t, l, r in found]


def passages(w: T.Words, model: Model) -> list[list[tuple[int, int, float]]]:
    """For each row its segments as (first word, past the last, score), in word numbers of the row. Neighbours of one sign are one step: no maximal segment
    parts them."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(w.first) - 1)]
    if not len(w.doc):
        return out
    h = T.mix(w.h[0] + U(1))  # as one-word shingles are hashed
    scores = np.full(len(h), DRIFT)
    if len(model.words):
        at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
        hit = model.words[at] == h
        scores[hit] = model.weights[at[hit]]
    up = scores > 0
    step = np.flatnonzero(np.r_[True, (up[1:] != up[:-1]) | (w.doc[1:] != w.doc[:-1])])
    sums, end = np.add.reduceat(scores, step).tolist(), np.append(step[1:], len(h))
    edge = np.searchsorted(step, w.first)
    first, end = (step - w.first[w.doc[step]]).tolist(), (end - w.first[w.doc[step]]).tolist()
    for row, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        out[row] = [(first[lo + f], end[lo + t - 1], s) for f, t, s in segments(sums[lo:hi])]
    return out


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, int]:
    """(evidence, significant segments): the sum over segments of -log E where E < 1; with none, -log E of the best (0 if there is none), at most 0."""
    if not found:
        return -20.0, 0
    each = [model.lam * s - math.log(model.k * max(n, 2)) for _, _, s in found]
    good = [x for x in each if x > 0]
    return (min(sum(good), MOST), len(good)) if good else (max(max(each), -20.0), 0)


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in T.slices(batches, "text"):
            w = T.words(b.column("text"), lower=True, punct=True)
            sizes = np.diff(w.first)
            found = passages(w, m)
            x = [evidence(f, int(n), m) for f, n in zip(found, sizes)]
            score = 1 / (1 + np.exp(-np.clip(m.a + m.b * np.array([e for e, _ in x]), -30, 30)))
            p = lambda n, s: 1 - math.exp(-min(700.0, m.k * max(int(n), 2) * math.exp(-m.lam * s)))
            spans = [[{"first": f, "to": t, "score": s, "p": p(n, s)} for f, t, s in fs if m.lam * s > math.log(m.k * max(int(n), 2))] for fs, n in zip(found, sizes)]
            keep = {c: b.column(c) for c in b.schema.names if c != "text"}
            tail = pa.array([sum(m.lam * s >= TAIL for _, _, s in fs) for fs in found], pa.int32())
            yield pa.RecordBatch.from_pydict(keep | {"score": pa.array(score), "evidence": pa.array([e for e, _ in x], pa.float64()), "n_passages": pa.array([g for _, g in x], pa.int32()), "tail": tail, "words": pa.array(sizes, pa.int32()), "passages": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("to", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])))})

    return run


_JUDGED = "score double, evidence double, n_passages int, tail int, words int, passages array<struct<first: int, to: int, score: double, p: double>>"


def _lambda(weights: np.ndarray, clean: np.ndarray, total: float) -> float:
    """The positive root of E[exp(lam * score)] = 1 over clean words, as for local alignment scores."""
    p = clean / max(total, 1.0)
    f = lambda lam: float((p * np.exp(np.minimum(lam * weights, 700))).sum() - 1)
    lo, hi = 1e-6, 1.0
    if f(lo) >= 0:
        return 0.05
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def fit(labelled: DataFrame) -> Model:
    """From text, toxic (0 or 1), part (0: words' weights, 1: calibration)."""
    spark = labelled.sparkSession
    labelled = stored(labelled, "tox-train")
    counts = stored(labelled.where("part = 0").select("text", "toxic").mapInArrow(T.tidy(_word_counts), "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tox-words")
    x = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    n1, n0 = float(x["t"] or 0), float(x["c"] or 0)
    if not n1 or not n0:
        return Model(np.zeros(0, U), np.zeros(0), 1.0, 1.0, -2.0, 0.0)
    # log-odds of each word under its Dirichlet prior, against those of all words
    share = n1 / (n1 + n0)
    a, b = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
    w, deviation = F.log(a / share) - F.log(b / (1 - share)), F.sqrt(1 / a + 1 / b)
    w = F.signum(w) * F.greatest(F.lit(0.0), F.abs(w) - SURE * deviation) + DRIFT
    words = counts.select("h", w.alias("w"), "clean").toArrow()  # those of max_labels texts at most
    hs = words.column("h").to_numpy().view(U)
    order = np.argsort(hs)
    weights = words.column("w").to_numpy()[order]
    lam = _lambda(weights, words.column("clean").to_numpy()[order].astype(float), n0)
    raw = Model(hs[order], weights, lam, 1.0, 0.0, 1.0)
    # the scale of the extreme-value distribution from the clean texts of the calibration part: the number of segments above s in n words has mean k n exp(-lam s)
    judged = labelled.where("part = 1 and toxic = 0").select("text").mapInArrow(T.tidy(_judge(spark.sparkContext.broadcast(raw))), _JUDGED)
    found = judged.agg(F.sum("tail").alias("tail"), F.sum("words").alias("words")).first()
    k = max(float(found["tail"] or 0), 0.5) * math.exp(TAIL) / max(float(found["words"] or 0), 1.0)
    model = raw._replace(k=k)
    scored = labelled.where("part = 1").select("text", "toxic").mapInArrow(T.tidy(_judge(spark.sparkContext.broadcast(model))), f"toxic int, {_JUDGED}")
    bins = scored.groupBy(F.round("evidence", 1).alias("x")).agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).toPandas()  # evidence is within -20 and MOST
    return model._replace(**dict(zip("ab", _logistic(bins["x"].to_numpy(float), bins["pos"].to_numpy(float), bins["n"].to_numpy(float)))))


def _logistic(x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with a weak pull to 0, by Newton steps on binned counts."""
    if not n.sum() or not 0 < pos.sum() < n.sum():
        return -2.0, 0.1
    s = np.stack([np.ones_like(x), x / 10], 1)
    theta, pull = np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(s @ theta, -30, 30)))
        g = s.T @ (pos - n * p) - pull @ theta
        step = np.linalg.solve((s * (n * p * (1 - p))[:, None]).T @ s + pull, g)
        theta = theta + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), max(0.0, float(theta[1]) / 10)


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), without the held-out fold. Fold 1 calibrates, the others give the weights."""
    T.small_batches(docs.sparkSession)
    fold = fold_of(F.col("doc_id"))
    use = labels.where("doc_id is not null and toxic in (0, 1)").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = use.limit(max_labels + 1).count()
    if n > max_labels:
        use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    # max_labels bounds what is broadcast
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(use), "doc_id")
    return fit(known.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.when(fold == 1, 1).otherwise(0).alias("part")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_passages, passages (spans in word numbers, score, p-value) of every row.

    A null or empty text has no passage and the least score; ids may be null (not held out) or repeat. Without labels of both kinds no word has a weight and
    every score is below one half.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold_of(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(T.tidy(_judge(d.sparkSession.sparkContext.broadcast(model))), f"doc_id {kind}, held_out boolean, {_JUDGED}")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).select("doc_id", "held_out", "score", "predicted", "evidence", "n_passages", "passages")


def keeper(model):
    """For mapInArrow: the rows, whatever their columns, whose text (a column text) scores below one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in T.slices(batches, "text"):
            w = T.words(b.column("text"), lower=True, punct=True)
            x = np.array([evidence(f, int(n), m)[0] for f, n in zip(passages(w, m), np.diff(w.first))])
            yield b.filter(pa.array(m.a + m.b * x < 0))

    return run


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
