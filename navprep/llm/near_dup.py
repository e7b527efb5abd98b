"""MinHash near-duplicates with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as T
from ._store import discard, keep_ids, sized, stored
from .components import components

HASHES = 128
#: Signature values compared before each look at the posterior.
BATCH = 16
#: Members of a bucket that meet in a task, by signature and on full sets.
BLOCK, SET_BLOCK = 256, 64
#: Blocks of one bucket that a task takes as one side.
TURN = 16
#: Partners of one pivot that a task takes of one bucket.
SALT = 4096
#: Shingles that one matrix product of the exact comparison covers.
COLUMNS = 8192
_MULT = T.mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def bands_for(threshold: float, hashes: int = HASHES, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold shares no band with probability miss at most."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    raise ValueError("too few hashes for this threshold and miss probability")


def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = 1e-6, bits: int = 8) -> list[int]:
    """For each batch end n the fewest matches of n signature values that keep a pair: below it, P(similarity >= threshold | matches) < miss
    under a uniform prior. Values keep bits low bits, so unequal ones agree with probability 2**-bits, which the threshold allows for."""
    t = threshold + (1 - threshold) / 2**bits
    out = []
    for n in range(batch, hashes + 1, batch):
        # the posterior is Beta(m + 1, n - m + 1); its upper tail at t is P(Binomial(n + 1, t) <= m)
        tail = 0.0
        for m in range(n + 1):
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
            if tail >= miss:
                break
        out.append(m)
    return out


def _signer(k: int, bands: int, rows: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            w = T.words(b.column("text"), lower=True)
            row, h = T.shingles(w, k)
            n = b.num_rows
            size = np.bincount(row, minlength=n)
            sums = T.per_row(np.add, T.mix(h ^ np.uint64(0xA5A5A5A5)), row, n), T.per_row(np.add, T.mix(h + np.uint64(0x1234567)), row, n)
            sig, keys = np.zeros((n, hashes), np.uint8), np.zeros((n, bands), np.uint64)
            if len(row):
                at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                own = row[at]
                for j in range(hashes):
                    least = np.minimum.reduceat(h * _MULT[j], at)
                    sig[own, j] = (T.mix(least) & np.uint64(255)).astype(np.uint8)
                    if j < bands * rows:
                        keys[own, j // rows] = T.mix(keys[own, j // rows] * np.uint64(31) + least + np.uint64(j))
            full = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    *(pa.array(T.signed(s)) for s in sums),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(T.signed(keys.reshape(-1)))),
                    full,
                ],
                names=["doc_id", "n_shingles", "c1", "c2", "sig", "bands", "full"],
            )

    return run


def _column(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(-1, width)


def _pruner(least: list[int], batch: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _column(b, "sig_a", hashes), _column(b, "sig_b", hashes)
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, need in enumerate(least):
                part = slice(i * batch, (i + 1) * batch)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[matches[alive] >= need]
            yield b.select(["a", "b", "salt"]).take(pa.array(alive))

    return run


def _lists(b: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return b.column(name)[r].values.to_numpy()


def _block_pruner(least: list[int], batch: int, hashes: int):
    """Pairs of blocks -> the members (key, id, root) that have a partner of another root which isn't pruned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ia, ra, ib, rb = (_lists(b, c, r) for c in ("ids_a", "roots_a", "ids_b", "roots_b"))
                x, y = (np.frombuffer(b"".join(b.column(c)[r].values.to_pylist()), np.uint8).reshape(-1, hashes) for c in ("data_a", "data_b"))
                i, j = np.nonzero(ra[:, None] != rb[None, :])
                matches = np.zeros(len(i), np.int64)
                for n, need in enumerate(least):
                    part = slice(n * batch, (n + 1) * batch)
                    matches += (x[i, part] == y[j, part]).sum(1)
                    keep = matches >= need
                    i, j, matches = i[keep], j[keep], matches[keep]
                i, j = np.unique(i), np.unique(j)
                ids, roots = np.concatenate([ia[i], ib[j]]), np.concatenate([ra[i], rb[j]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column("key")[r].as_py(), np.int64)), pa.array(ids), pa.array(roots)], names=["key", "id", "root"])

    return run


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by products of incidence matrices."""
    px, py = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    vx, vy = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        sides = []
        for v, p, n in ((vx, px, len(x)), (vy, py, len(y))):
            c = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[c] == v
            m = np.zeros((n, len(part)), np.float32)
            m[p[hit], c[hit]] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _block_verifier(percent: int):
    """Pairs of blocks -> links (a, b) on full sets, as many as join the roots that links join: a forest, not all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ia, ra, ib, rb = (_lists(b, c, r) for c in ("ids_a", "roots_a", "ids_b", "roots_b"))
                x, y = ([np.frombuffer(v, np.uint64) for v in b.column(c)[r].values.to_pylist()] for c in ("data_a", "data_b"))
                both = _overlaps(x, y)
                union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None] - both
                i, j = np.nonzero((100 * both >= percent * union) & (ra[:, None] != rb[None]))
                _, first = np.unique(np.stack([np.minimum(ra[i], rb[j]), np.maximum(ra[i], rb[j])]), axis=1, return_index=True)
                top: dict[int, int] = {}

                def find(v: int, top=top) -> int:
                    while top.setdefault(v, v) != v:
                        v = top[v]
                    return v

                links = []
                for n in first.tolist():
                    u, v = find(int(ra[i[n]])), find(int(rb[j[n]]))
                    if u != v:
                        top[u] = v
                        links.append((int(ia[i[n]]), int(ib[j[n]])))
                yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in links], pa.int64()), pa.array([n[1] for n in links], pa.int64())], names=["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            row, h = T.shingles(T.words(b.column("text"), lower=True), k)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["id", "shingles"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(members: DataFrame, block: int) -> DataFrame:
    """Members (key, id, root) with n, the number of the key's members where these fill more than a block, else 1."""
    large = stored(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "nd-large")
    return members.join(sized(large), "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))


def _blocks(members: DataFrame, data: DataFrame, block: int) -> DataFrame:
    """Members (key, id, root, n) with their data (id, data) in blocks of about block rows: key, block, blocks (of the key), ids, roots, data."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("n").join(data, "id")
    return stored(m.groupBy("key", "block", "blocks").agg(*(F.collect_list(c).alias(c) for c in ("id", "root", "data"))), "nd-packs")


def _with_both(pairs: DataFrame, data: DataFrame, name: str) -> DataFrame:
    """Stored pairs (a, b, salt) with both sides' data (id, name) as name_a and name_b. A pivot a with many partners meets them in parts, by salt: its data
    is repeated once a part, and parts are dealt out by repartition."""
    heads = pairs.select("a", "salt").distinct().join(data.select(F.col("id").alias("a"), F.col(name).alias(f"{name}_a")), "a")
    with_b = pairs.join(data.select(F.col("id").alias("b"), F.col(name).alias(f"{name}_b")), "b")
    return with_b.repartition("a", "salt").join(heads.repartition("a", "salt").hint("merge"), ["a", "salt"])


def _block_pairs(packs: DataFrame) -> DataFrame:
    """Each pair of blocks of one key, and each block with itself, as one row. A large bucket's blocks meet in salted groups: TURN of them as one side with all
    as the other, so that no task holds all pairs of a bucket. A bucket of one block meets itself where it is. The groups are dealt out by repartition: Spark
    would split them further, into a task for nearly every pair of blocks; of the join's sides, the one of TURN blocks is held, the other streamed."""
    names = {"id": "ids", "root": "roots", "data": "data"}
    side = lambda d, *sides: d.select("key", "block", F.floor(F.col("block") / TURN).alias("turn"), *(F.col(c).alias(f"{n}_{s}") for s in sides for c, n in names.items()))
    many = packs.where("blocks > 1")
    first, second = side(many, "a").withColumnRenamed("block", "first"), side(many, "b").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), "turn")))
    first, second = (d.repartition("key", "turn") for d in (first, second))
    met = second.join(first.hint("merge"), ["key", "turn"]).where("first <= block").drop("first", "block", "turn")
    return met.unionByName(side(packs.where("blocks = 1"), "a", "b").drop("block", "turn"))


class _Links:
    """Pairs of representatives -> those whose full sets are similar enough; what was judged once isn't judged again."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, k: int, percent: int, hashes: int, miss: float):
        self.docs, self.k, self.percent, self.hashes = docs, k, percent, hashes
        self.sigs = sigs.select(F.col("doc_id").alias("id"), "sig")
        self.sets: DataFrame | None = None
        self.kept: list[DataFrame] = []
        self.least = least_matches(percent / 100, hashes, BATCH, miss)

    def _sets_of(self, ids: DataFrame) -> DataFrame:
        """id, shingles of at least these ids; texts are read only for those not met before."""
        known = self.sets
        ids = stored(ids if known is None else ids.join(known.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "nd-ids")
        if known is None or not ids.isEmpty():
            new = stored(keep_ids(self.docs, ids, "doc_id").mapInArrow(T.tidy(_sets(self.k)), "id long, shingles binary"), "nd-sets")
            self.sets = new if known is None else known.unionByName(new)
            self.kept.append(new)
        discard(ids)
        return self.sets

    def forget(self) -> None:
        discard(*self.kept)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b, salt)."""
        pairs = stored(pairs, "nd-pairs")
        p = _with_both(pairs, self.sigs, "sig").select("a", "b", "salt", "sig_a", "sig_b")
        alive = stored(p.mapInArrow(T.tidy(_pruner(self.least, BATCH, self.hashes)), "a long, b long, salt long"), "nd-alive")
        discard(pairs)
        if alive.isEmpty():
            return alive.select("a", "b")
        sets = self._sets_of(alive.select(F.col("a").alias("doc_id")).union(alive.select("b")).distinct())
        p = _with_both(alive, sets.withColumnRenamed("shingles", "set"), "set").select("a", "b", "set_a", "set_b")
        links = stored(p.mapInArrow(T.tidy(_verifier(self.percent)), "a long, b long"), "nd-links")
        discard(alive)
        return links

    def in_blocks(self, members: DataFrame) -> DataFrame:
        """Links that join the components of members (key, id, root, n) of one key. Blocks of members meet in a task: by signature first, then those that
        have a partner left on full sets. What leaves a task is members, then a forest of links."""
        run, out = T.tidy(_block_pruner(self.least, BATCH, self.hashes)), "key long, id long, root long"
        packs = _blocks(members, self.sigs.withColumnRenamed("sig", "data"), BLOCK)
        left = stored(_block_pairs(packs).mapInArrow(run, out).distinct(), "nd-left")
        discard(packs)
        if left.isEmpty():
            return left.select(F.col("id").alias("a"), F.col("id").alias("b"))
        sets = self._sets_of(left.select(F.col("id").alias("doc_id")).distinct())
        packs = _blocks(_counted(left, SET_BLOCK), sets.withColumnRenamed("shingles", "data"), SET_BLOCK)
        links = stored(_block_pairs(packs).mapInArrow(T.tidy(_block_verifier(self.percent)), "a long, b long").distinct(), "nd-links")
        discard(packs, left)
        return links


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))


def _open(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, hashes: int = HASHES, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of the links 100 * |intersection| >= percent * |union| of distinct k-word shingle sets.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; a text of fewer than k words has its whole sequence as one shingle; an empty or null text has
    no shingle, is linked with nothing and stays. Documents of equal sets are one representative (the least id) from the start. Candidates share a
    band of a MinHash signature. First each bucket's members meet its least id; then members of a bucket that are still in different components are compared
    in blocks, by signature and then on full sets, and only a forest of links leaves a task. So a group of copies costs pairs in proportion to its size, and
    no partner is capped. Sequential looks at the signature drop a candidate when its posterior chance of reaching the threshold falls below miss;
    survivors are verified on full sets.

    Rows with a null id keep a row of their own with a null component and kept true; rows that repeat whole get equal results. Where an id names several texts,
    each row is linked by its own text, and its component is the least id of the rows it is linked with: a row's id links it with nothing.
    """
    T.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not _repeats(docs):
        return _by_id(docs, k, percent, hashes, miss)
    rows = stored(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "nd-rows")
    found = stored(_by_id(rows.select(F.col("row").alias("doc_id"), "text"), k, percent, hashes, miss).withColumnRenamed("doc_id", "row"), "nd-found")
    named = found.where("row is not null").join(rows.where("row is not null").select("row", "doc_id"), "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    out = out.unionByName(found.where("row is null").select(F.col("row").alias("doc_id"), "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_id(docs: DataFrame, k: int, percent: int, hashes: int, miss: float) -> DataFrame:
    """near_duplicates of docs (doc_id, text) whose ids don't repeat."""
    bands, rows = bands_for(percent / 100, hashes, miss)
    sigs = stored(docs.mapInArrow(T.tidy(_signer(k, bands, rows, hashes)), "doc_id long, n_shingles long, c1 long, c2 long, sig binary, bands array<long>, full boolean"), "nd-sigs")
    classes = sigs.where("full and doc_id is not null").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "nd-classes")
    reps = stored(sigs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("full").select("doc_id", "sig", "bands"), "nd-reps")
    judge = _Links(docs, reps, k, percent, hashes, miss)
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    pivot = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(pivot, "key").select("key", "id", "a", "n"), "nd-members")
    pairs = members.where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("n").alias("n"))
    links = judge(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SALT)).alias("salt")))
    roots = components(links)
    now = stored(_labelled(members.select("key", "id"), roots), "nd-labelled")
    open_ = stored(_open(now), "nd-open")
    if not open_.isEmpty():
        links = links.union(judge.in_blocks(now.join(open_, "key")))
        roots = components(links)
    judge.forget()
    discard(reps, members, now, open_)
    labels = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    many = classes.where("copies > 1").select("c1", "c2", "n_shingles")
    thin = sigs.select("doc_id", "n_shingles", "c1", "c2", "full")
    out = thin.where("full").join(labels, ["c1", "c2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(thin.where("not full").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(docs: DataFrame) -> bool:
    ids = docs.where("doc_id is not null").select("doc_id")
    x = ids.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (x or 0) > 1


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of documents: three-word shingles, Jaccard similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
