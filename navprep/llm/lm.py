"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation in numpy, over whole-corpus counts.

Symbols are the words that occur sqrt(tokens) / RARE times or more (VOCAB places at least), the end of a text, and CLASSES classes of all other words (by
their last two bytes). The network predicts a symbol from the two before it in two steps: the end, a class or a block of about sqrt(words) words next to
each other in frequency; then the word within its block. A word of a class has the class's probability times its own add-one share of the class.
Probabilities are normalised exactly over all symbols, by matrix products over pairs of frequent words and over all other tokens. Training passes over every token of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _text as T
from ._store import stored

U = np.uint64
VOCAB, CLASSES, DIM = 127, 32, 32
#: Words whose counts tasks receive; the counts of the rest are joined.
MAX_FREQUENT = 400_000
#: A word with sqrt(tokens) / RARE occurrences has a symbol of its own.
RARE = 32
#: Training: rounds of parallel passes whose parameters are averaged. Every token is in one of the rounds, and small corpora are passed over up to
#: MAX_PASSES times for LEAST_DRAWS steps' trigrams. A worker has about sqrt(tokens * WORKER_TOKENS) tokens.
ROUNDS, BATCH, NOISE, NOISE_WORDS = 4, 4096, 32, 2
LEAST_DRAWS, MAX_PASSES, WORKER_TOKENS = 12_000_000, 12, 250_000
_CHUNK = 512
#: Scoring: tokens in one matrix product. For contexts of the PAIRED most frequent words, the end, the classes and the start, each task makes the sums over the first
#: step's targets and over the words of the first PAIRED_BLOCKS blocks once, as products of exponentials of their two words; logarithms above FAR and sums below
#: LEAST could lose digits there. These and all other contexts' sums are made token by token.
ROWS, PAIRED, PAIRED_BLOCKS, FAR, LEAST = 512, 2048, 2, 40.0, 1e-12
_END_HASH = U(0x5E4D0E4D5E4D0E40)
FOLDS, HELD = 7, 2


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Tokens(NamedTuple):
    """Tokens of a slice, each text's words and then its end. h: identity, with the class in its low bits."""

    h: np.ndarray
    doc: np.ndarray
    end: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = T.words(texts, lower=True)
    n, rows = len(w.doc), len(w.first) - 1
    last = w.data[w.end - 1].astype(U)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(U)
    fold = lambda c: np.where((c >= 65) & (c <= 90), c + U(32), c)
    cls = T.mix(fold(last) * U(256) + fold(before)) % U(CLASSES)
    # a word ends up before as many ends as rows precede its own
    h, doc = np.empty(n + rows, U), np.empty(n + rows, np.int64)
    at = np.arange(n) + w.doc
    ends = w.first[1:] + np.arange(rows)
    h[at], h[ends] = (w.h[0] & ~U(CLASSES - 1)) | cls, _END_HASH
    doc[at], doc[ends] = w.doc, np.arange(rows)
    return Tokens(h, doc, ends)


def symbols(t: Tokens, top: np.ndarray, top_at: np.ndarray, words: int = VOCAB) -> np.ndarray:
    """0: end, 1 to words: frequent words (top: their hashes, sorted; top_at: their places), then the classes."""
    s = (t.h & U(CLASSES - 1)).astype(np.int64) + words + 1
    if len(top):
        at = np.minimum(np.searchsorted(top, t.h), len(top) - 1)
        hit = top[at] == t.h
        s[hit] = top_at[at[hit]] + 1
    s[t.end] = 0
    return s


SIZE = VOCAB + 1 + CLASSES  # symbols of the smallest network; one more stands before a text


def contexts(s: np.ndarray, t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(before last, last) of each token; size stands before a text."""
    first = np.zeros(len(s), bool)
    first[0] = True
    first[t.end[:-1] + 1] = True
    one = np.append(size, s[:-1])
    one[first] = size
    two = np.append([size], one[:-1])
    two[first] = size
    return two, one


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    out = lambda h, n: pa.RecordBatch.from_arrays([pa.array(T.signed(h)), pa.array(n)], names=["h", "c"])

    def summed():
        h, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        held.clear()
        order = np.argsort(h)
        h, n = h[order], n[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[at], np.add.reduceat(n, at)

    for b in T.slices(batches, "text"):
        h, n = np.unique(tokens(b.column("text")).h, return_counts=True)
        held.append((h, n))
        if sum(len(x) for x, _ in held) > 2_000_000:
            yield out(*summed())
    if held:
        yield out(*summed())


class Sides(NamedTuple):
    """What each context adds to the prediction, as the one before last and as the last, with 1 in all for the bias; the places of frequent contexts, how many they
    are, and the logarithms of sums after pairs of them: over the first step's targets and over the words of the first blocks."""

    left: np.ndarray
    right: np.ndarray
    place: np.ndarray
    often: int
    sums: list[np.ndarray]


class Network(NamedTuple):
    """All parameters as rows of DIM values and a bias: contexts' vectors, those of the first step's targets, words' by place (whole blocks), c1 and c2
    (a weight a dimension: how the last and the one before predict)."""

    words: int
    rows: np.ndarray

    @property
    def size(self) -> int:
        return self.words + 1 + CLASSES

    @property
    def width(self) -> int:
        """Words in a block."""
        return int(np.ceil(self.words / self.blocks))

    @property
    def blocks(self) -> int:
        return int(np.ceil(np.sqrt(self.words)))

    @property
    def starts(self) -> np.ndarray:
        """First rows of the five parts, and the end."""
        return np.cumsum([0, self.size + 1, 1 + self.blocks + CLASSES, self.blocks * self.width, 1, 1])

    def parts(self) -> list[np.ndarray]:
        return np.split(self.rows, self.starts[1:-1])

    def steps(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the first step's targets, and of words by place (0: no word)."""
        own = np.zeros(self.blocks * self.width)
        own[: self.words] = p[1 : self.words + 1]
        return np.concatenate([p[:1], own.reshape(self.blocks, -1).sum(1), p[self.words + 1 :]]), own

    def first_step(self, s: np.ndarray) -> np.ndarray:
        return np.where(s == 0, 0, np.where(s <= self.words, 1 + (s - 1) // self.width, s - self.words + self.blocks))

    @classmethod
    def new(cls, p: np.ndarray) -> Network:
        """p: of all symbols."""
        r = np.random.default_rng(1)
        net = cls(len(p) - 1 - CLASSES, np.zeros(0))
        rows = (r.standard_normal((net.starts[-1], DIM + 1)) * 0.1).astype(np.float32)
        rows[:, DIM] = 0
        net = net._replace(rows=rows)
        _, top, word, c1, c2 = net.parts()
        first, own = net.steps(p)
        share = own / np.repeat(np.maximum(own.reshape(net.blocks, -1).sum(1), 1e-300), net.width)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4)
        top[:, DIM], word[:, DIM] = log(first), log(share)
        c1[:, :DIM], c2[:, :DIM] = 1.0, 0.5
        return net

    def sides(self) -> Sides:
        context, top, word, c1, c2 = self.parts()
        left, right = (np.pad(context[:, :DIM] * c[:, :DIM], ((0, 0), (0, 1))) for c in (c2, c1))
        right[:, DIM] = 1
        often = np.r_[: min(self.words, PAIRED) + 1, self.words + 1 : self.size + 1]
        place = np.full(self.size + 1, -1)
        place[often] = np.arange(len(often))
        blocks = [word[b * self.width : (b + 1) * self.width] for b in range(min(self.blocks, PAIRED_BLOCKS))]
        return Sides(left, right, place, len(often), [_pair_sums(left[often], right[often], t) for t in (top, *blocks)])

    def log_of(self, sides: Sides, two: np.ndarray, one: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Natural logarithms of the symbols' probabilities after their contexts."""
        _, top, word, _, _ = self.parts()
        width = self.width
        q = sides.left.take(two, 0)
        q += sides.right.take(one, 0)
        i, j = sides.place.take(two), sides.place.take(one)
        pair = np.where((i < 0) | (j < 0), -1, i * sides.often + j)
        out = _log_picked(q, top, self.first_step(s), pair, sides.sums[0])
        of_words = np.flatnonzero((s > 0) & (s <= self.words))
        block, place = np.divmod(s[of_words] - 1, width)
        order = np.argsort(block.astype(np.uint16) if self.blocks < 1 << 16 else block, kind="stable")
        of_words, place = of_words[order], place[order]
        edge = np.searchsorted(block[order], np.arange(self.blocks + 1))
        for b in np.flatnonzero(np.diff(edge)):
            at = of_words[edge[b] : edge[b + 1]]
            sums = sides.sums[b + 1] if b + 1 < len(sides.sums) else None
            out[at] += _log_picked(q.take(at, 0), word[b * width : (b + 1) * width], place[edge[b] : edge[b + 1]], pair.take(at), sums)
        return out

    def log_probabilities(self) -> np.ndarray:
        """Natural logarithms, normalised, [before last, last, symbol] in one table: for small networks."""
        sides, n = self.sides(), self.size
        one, s = (x.reshape(-1) for x in np.indices((n + 1, n)))
        return np.stack([self.log_of(sides, np.full(len(s), a), one, s).reshape(n + 1, n) for a in range(n + 1)])


def _pair_sums(left: np.ndarray, right: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Logarithms of the targets' sums after each pair of a word before last (left) and a last one (right); not a number where digits might be lost."""
    exps = []
    for side in (left, right):
        z = side @ targets.T
        far = (z > FAR).any(1)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z[far] = np.nan
        exps.append(z)
    sums = exps[0] @ exps[1].T
    sums[~(sums > LEAST)] = np.nan
    return np.log(sums, out=sums).reshape(-1)


def _log_picked(q: np.ndarray, targets: np.ndarray, at: np.ndarray, pair: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
    """Natural logarithms of the shares that targets at have among all targets. pair: places in sums, -1: none."""
    if sums is None:
        return _log_shares(q, targets, at)
    log = np.where(pair < 0, np.float32(np.nan), sums.take(pair, mode="clip"))
    out = np.einsum("ij,ij->i", q, targets.take(at, 0)) - log.astype(float)
    rest = np.flatnonzero(np.isnan(log))
    out[rest] = _log_shares(q.take(rest, 0), targets, at[rest])
    return out


def _log_shares(q: np.ndarray, targets: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for i in range(0, len(at), ROWS):
        z, k = q[i : i + ROWS] @ targets.T, at[i : i + ROWS]
        picked = z[np.arange(len(k)), k]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            now = picked - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
        far = np.flatnonzero(~np.isfinite(now))  # beyond the range of exp
        if len(far):
            x = q[i + far] @ targets.T
            x -= x.max(1, keepdims=True)
            now[far] = x[np.arange(len(far)), k[far]] - np.log(np.exp(x).sum(1))
        out[i : i + ROWS] = now
    return out


class Trainer:
    """Noise-contrastive Adagrad steps from a network, for both steps of the prediction; rows that a batch doesn't touch stay."""

    def __init__(self, net: Network, p: np.ndarray, seed):
        # one more column, always 0, makes the width even
        self.net = net._replace(rows=np.pad(net.rows, ((0, 0), (0, 1))))
        self.sums = np.full(self.net.rows.shape, 1e-3, np.float32)
        self.touched = np.zeros(len(net.rows))
        self.r = np.random.default_rng(seed)
        self.first, own = net.steps(p)
        self.first_edge, self.edge = np.cumsum(self.first) / self.first.sum(), np.append(0, np.cumsum(own))
        share = own / np.repeat(np.maximum(own.reshape(net.blocks, -1).sum(1), 1e-300), net.width)
        self.log_first, self.log_word = np.log(NOISE * self.first).astype(np.float32), np.log(NOISE_WORDS * np.maximum(share, 1e-300)).astype(np.float32)

    def _step(self, start: int, at: np.ndarray, source: np.ndarray, pick: np.ndarray | None = None, scale: np.ndarray | None = None) -> None:
        """For rows from start on; the gradient at place i is scale[i] times source[pick[i]] (without them: source[i]), and the mean where rows are there more than once."""
        bits = len(at).bit_length()
        key = np.sort(at << bits | np.arange(len(at)))
        order, at = key & ((1 << bits) - 1), key >> bits
        new = np.r_[True, at[1:] != at[:-1], True]
        first = np.flatnonzero(new)
        n = np.diff(first)
        first = first[:-1]

        def gradients(places):
            o = order.take(places)
            g = source.take(o if pick is None else pick.take(o), 0)
            if scale is not None:
                g *= scale.take(o)[:, None]
            return g

        grad = gradients(first)
        many = np.flatnonzero(n > 1)
        if len(many):
            k = n[many]
            g = gradients(np.flatnonzero(~(new[:-1] & new[1:])))
            # two columns at once, as a complex number: the time goes by columns
            sums = np.add.reduceat(g.view(np.complex64), np.cumsum(k) - k, axis=0).view(np.float32)
            _set_rows(grad, many, sums / k[:, None].astype(np.float32))
        self._apply(at[first] + start, grad, n)

    def _apply(self, at, grad, n) -> None:
        sums = self.sums.take(at, 0)
        sums += grad * grad
        _set_rows(self.sums, at, sums)
        np.sqrt(sums, out=sums)
        np.divide(grad, sums, out=sums)
        sums *= np.float32(0.05)
        sums += self.net.rows.take(at, 0)
        _set_rows(self.net.rows, at, sums)
        self.touched[at] += n

    def batch(self, two: np.ndarray, one: np.ndarray, s: np.ndarray) -> None:
        net, n = self.net, len(s)
        context, top, word, c1, c2 = net.parts()
        starts = net.starts
        of_word = (s > 0) & (s <= net.words)
        order = np.argsort(~of_word, kind="stable")  # words first
        two, one, s, w = two[order], one[order], s[order], np.count_nonzero(of_word)
        x1, x2 = context.take(one, 0), context.take(two, 0)
        q = x1 * c1
        q += x2 * c2
        q[:, DIM] = 1
        own = net.first_step(s)
        noise = np.minimum(np.searchsorted(self.first_edge, self.r.random(NOISE)), len(self.first) - 1)
        top_own, top_noise = top.take(own, 0), top.take(noise, 0)
        d_own = 1 + _minus_sigmoid(np.einsum("ij,ij->i", q, top_own) - self.log_first[own])
        d_noise = _minus_sigmoid(q @ top_noise.T - self.log_first[noise])
        d_q = d_noise @ top_noise
        top_own *= d_own[:, None]
        d_q += top_own
        if w:
            place = np.empty((w, 1 + NOISE_WORDS), np.int64)
            place[:, 0] = s[:w] - 1
            lo = place[:, 0] // net.width * net.width
            hi = np.minimum(lo + net.width, net.words)
            u = self.edge[lo][:, None] + self.r.random((w, NOISE_WORDS)) * (self.edge[hi] - self.edge[lo])[:, None]
            place[:, 1:] = np.clip(np.searchsorted(self.edge, u, "right") - 1, lo[:, None], hi[:, None] - 1)
            target = word.take(place, 0)
            d = _minus_sigmoid(np.einsum("ijk,ik->ij", target, q[:w]) - self.log_word[place])
            d[:, 0] += 1
            d_q[:w] += np.einsum("ij,ijk->ik", d, target)
        d_q[:, DIM:] = 0
        g_context = np.empty((2 * n, d_q.shape[1]), np.float32)
        np.multiply(d_q, c1, out=g_context[:n])
        np.multiply(d_q, c2, out=g_context[n:])
        g_c = np.stack([np.einsum("ij,ij->j", x, d_q) for x in (x1, x2)]) / n
        self._step(starts[1], np.concatenate([own, noise]), np.concatenate([q, d_noise.T @ q]), scale=np.concatenate([d_own, np.ones(NOISE, np.float32)]))
        if w:
            self._step(starts[2], place.reshape(-1), q, np.arange(place.size) // place.shape[1], d.reshape(-1))
        self._step(starts[0], np.concatenate([one, two]), g_context)
        self._apply(np.arange(starts[3], starts[5]), g_c.astype(np.float32), n)


def _minus_sigmoid(z: np.ndarray) -> np.ndarray:
    """In the place of z."""
    np.maximum(z, -30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.divide(-1, z, out=z)


def _set_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, copied a whole row at a time."""
    row = np.dtype((np.void, table.shape[1] * table.itemsize))
    table.view(row)[:, 0][at] = rows.view(row)[:, 0]


class Model(NamedTuple):
    total: int
    distinct: int
    top: np.ndarray
    top_at: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray
    class_sizes: np.ndarray
    network: Network


def _passes(now, n: int, passes: int):
    """A worker's passes over its share of a round: chunks of its changes, weighted by how often each row was touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, p, top, top_at = now.value
        part = TaskContext.get().partitionId()
        t = Trainer(net, p, [n, part])
        for b in T.slices(batches, "text"):
            tok = tokens(b.column("text"))
            s = symbols(tok, top, top_at, net.words)
            two, one = contexts(s, tok, net.size)
            for _ in range(passes):
                order = t.r.permutation(len(s))
                for i in range(0, len(s), BATCH):
                    at = order[i : i + BATCH]
                    t.batch(two[at], one[at], s[at])
        for i in range(0, len(net.rows) if t.touched.any() else 0, _CHUNK):
            w = t.touched[i : i + _CHUNK]
            change = (t.net.rows[i : i + _CHUNK, : DIM + 1] - net.rows[i : i + _CHUNK]) * w[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([i // _CHUNK]), pa.array([part]), pa.array([change.astype(np.float32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["chunk", "part", "change", "w"])

    return run


def _mean(table):
    order = np.argsort(table.column("part").to_numpy())  # the same sum whatever order the rows come in
    change, w = table.column("change").take(order), table.column("w").take(order)
    total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in w], axis=0)
    mean = np.sum([np.frombuffer(x.as_py(), np.float32).reshape(-1, DIM + 1) for x in change], axis=0, dtype=np.float64) / np.maximum(total, 1)[:, None]
    return pa.table({"chunk": table.column("chunk")[:1], "change": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _train_network(texts: DataFrame, total: int, p: np.ndarray, top: np.ndarray, top_at: np.ndarray) -> Network:
    net = Network.new(p)
    workers = max(1, round(np.sqrt(total / WORKER_TOKENS)))
    passes = min(MAX_PASSES, max(1, -(-LEAST_DRAWS // total)))
    for n in range(ROUNDS):
        run = _passes(texts.sparkSession.sparkContext.broadcast((net, p, top, top_at)), n, passes)
        share = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == n).coalesce(workers)
        means = share.mapInArrow(T.tidy(run), "chunk long, part long, change binary, w binary").groupBy("chunk").applyInArrow(_mean, "chunk long, change binary").toArrow()
        rows = net.rows.copy()
        for c, x in zip(means.column("chunk").to_pylist(), means.column("change")):
            rows[c * _CHUNK : (c + 1) * _CHUNK] += np.frombuffer(x.as_py(), np.float32).reshape(-1, DIM + 1)
        net = net._replace(rows=rows)
    return net


def train(texts: DataFrame, max_frequent: int = MAX_FREQUENT) -> tuple[Model, DataFrame]:
    """A model from all rows of texts (text), and the counts (h, c) of its tokens."""
    counts = stored(texts.mapInArrow(T.tidy(_count_words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    x = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(x["n"] or 0), int(x["v"])
    end = int(np.array([_END_HASH]).view(np.int64)[0])
    own = (F.col("h") != end) & (F.col("c") >= max(2.0, np.sqrt(total) / RARE))
    words = max(VOCAB, counts.where(own).count())
    top = counts.where(F.col("h") != end) if words == VOCAB else counts.where(own)
    top = top.orderBy(F.desc("c"), "h").limit(words).toPandas()
    # the least count above which no more than max_frequent words are
    tail = counts.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    fits = tail["c"][tail["n"].cumsum() <= max_frequent]
    least = int(fits.min()) if len(fits) else 1 << 62
    frequent = counts.where(F.col("c") >= least).toArrow()
    fh, fc = frequent.column("h").to_numpy().view(U), frequent.column("c").to_numpy()
    order = np.argsort(fh)
    th = top["h"].to_numpy(np.int64)
    last = top.iloc[-1] if len(top) else {"c": 1 << 62, "h": 0}  # top's words are all up to this one
    rest = counts.where((F.col("h") != end) & ((F.col("c") < int(last["c"])) | ((F.col("c") == int(last["c"])) & (F.col("h") > int(last["h"])))))
    classes = rest.groupBy(F.col("h").bitwiseAND(CLASSES - 1).alias("k")).agg(F.sum(F.col("c") + 1).alias("size"), F.sum("c").alias("c")).toPandas()
    sizes, mass = np.ones(CLASSES), np.zeros(CLASSES)
    sizes[classes["k"].to_numpy(int)] += classes["size"].to_numpy(float)
    mass[classes["k"].to_numpy(int)] = classes["c"].to_numpy(float)
    known = counts.where(F.col("h") == end).first()
    p = np.concatenate([[known["c"] if known else 0], top["c"].to_numpy(float), np.zeros(words - len(top)), mass]) + 0.5
    p = p / p.sum()
    s = np.argsort(th.view(U))
    top_h, top_at = th.view(U)[s], s
    net = Network.new(p)
    if total:
        net = _train_network(texts, total, p, top_h, top_at)
    return Model(total, distinct, top_h, top_at, fh[order], fc[order], sizes, net), counts


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        sides, words = m.network.sides(), m.network.words
        z = np.log10(m.class_sizes)
        denominator = np.log10(m.total + m.distinct + 1.0)
        for b in T.slices(batches, "text"):
            n = b.num_rows
            t = tokens(b.column("text"))
            distinct, back = np.unique(t.h, return_inverse=True)  # looked up once each
            s = symbols(t._replace(h=distinct, end=t.end[:0]), m.top, m.top_at, words)[back]
            s[t.end] = 0
            own = m.network.log_of(sides, *contexts(s, t, m.network.size), s) / np.log(10)
            other = s > words  # these have their word's share of the class, too
            at = np.minimum(np.searchsorted(m.frequent, distinct), max(len(m.frequent) - 1, 0))
            found = m.frequent[at] == distinct if len(m.frequent) else np.zeros(len(distinct), bool)
            log_c = np.where(found, np.log10(np.where(found, m.frequent_counts[at] if len(m.frequent) else 0, 0) + 1.0), 0.0)[back]
            found = found[back]
            own += np.where(other, log_c - z[np.maximum(s - words - 1, 0)], 0.0)
            sum_ = lambda x: np.bincount(t.doc, x, n)
            rare = np.flatnonzero(~found)
            doc, h = t.doc[rare], t.h[rare]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(h)))
            offsets = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(T.signed(h[first])), pa.array(tf.astype(np.int32)), pa.array(s[rare][order][first] > words)], names=["h", "tf", "other"]))
            size = np.bincount(t.doc, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([uuid.uuid4().hex for _ in range(n)]), pa.array(size, pa.int64()), pa.array(sum_(found).astype(np.int64)), pa.array(sum_(log_c) - size * denominator), pa.array(sum_(own)), lists],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "own", "rare"],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the rows that aren't held out.

    A null or empty text is one token, the end. A null id is not held out; repeated rows count and are scored each. Without any training text counts are 0
    and the network is the uniform one it starts from. Words are known by 59 bits of a hash and a class of 5 bits.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold_of(F.col(id_col)) == HELD, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    T.small_batches(d.sparkSession)
    model, counts = train(d.where("not held_out").select("text"))
    got = stored(d.mapInArrow(T.tidy(_score(d.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, row string, n_tokens long, known long, base double, own double, rare array<struct<h: bigint, tf: int, other: boolean>>"), "lm-scored")
    rare = got.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts, "h")
    log_c = F.col("tf") * F.log10(F.col("c") + 1.0)
    rare = rare.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(log_c).alias("more_base"), F.sum(F.when(F.col("other"), log_c).otherwise(0.0)).alias("more_own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return got.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("own") + zero("more_own")).alias("score"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
