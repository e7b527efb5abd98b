"""Collocations: word-id suffix arrays by prefix doubling in each shard, whose LCP intervals are n-gram counts that Spark merges by key.

Three passes over the texts, as an n-gram can only be frequent where its parts are: words; pairs of frequent words; runs of three and four words of frequent
pairs. Words are counted by themselves and told apart afterwards by a 64-bit hash of word and language. Up to MAX_IDS frequent words the tasks hold these hashes
sorted, and a word's id is its place; beyond, the hash is the id and a bit filter says which words are frequent, as one does for pairs. A filter's wrong yes
only sends a rare n-gram through the merge, which counts exactly. An id tells the language, so n-grams are merged by ids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from . import _text as T
from ._store import discard, sized, stored

U = np.uint64
LONGEST = 4
LEAST = 30
TOP = 2000
#: Words in a suffix array, more only where one text has more.
SHARD_WORDS = 1 << 19
#: Frequent words whose hashes tasks may hold (8 bytes each).
MAX_IDS = 1 << 23
#: A filter's bits as a power of two; beyond about 2**MAX_BITS / 4 frequent n-grams it lets rare ones through, to be counted for nothing.
MIN_BITS, MAX_BITS = 16, 28
#: Rows of a lookup that may be broadcast (keys of four numbers and a language).
MAX_LOOKUP = 200_000
#: Parts of a language that are ranked apart before the best of all are.
PARTS = 64
NO_LANG = "und"

# Bytes that end a piece, and bytes that part words within one.
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _STOPS.copy()
_GAPS[[9, 32]] = True
_KEY = ["w1", "w2", "w3", "w4"]


class Shard(NamedTuple):
    """Words of some texts in order: hash, code of the language, and whether the word follows the one before in its piece."""

    h: np.ndarray
    lang: np.ndarray
    linked: np.ndarray
    langs: list[str]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, row, hash, linked) of the words; A-Z are folded."""
    data, offsets = T.utf8(texts)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return data, z, z, z, np.zeros(0, U), np.zeros(0, bool)
    data = T._FOLD.astype(np.uint8)[data]
    inside = ~_GAPS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:n] | edge[:n]))
    after = np.append(inside[1:], False)
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    table, powers = np.where(_GAPS, U(0), T._TABLE[0][0]), T._POWERS[0]
    up, down = powers.get(n)
    h = T.mix(np.add.reduceat(table[data] * up, start) * down[start] + (end - start).astype(U)) if len(start) else np.zeros(0, U)
    stops = np.append(0, np.cumsum(_STOPS[data]))
    linked = np.zeros(len(start), bool)
    linked[1:] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
    return data, start, end, row, h, linked


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    d = batch.column("lang").fill_null(NO_LANG).dictionary_encode()
    return np.asarray(d.indices), d.dictionary.to_pylist()


def shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD_WORDS) -> Iterator[Shard]:
    """Slices of text gathered until they hold limit words; whole texts only."""
    held, names, size = [], {}, 0

    def join():
        return Shard(*(np.concatenate(x) for x in zip(*held)), list(names))

    for b in T.slices(batches, "text"):
        _, _, _, row, h, linked = tokens(b.column("text"))
        code, langs = _codes(b)
        own = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        if size and size + len(h) > limit:
            yield join()
            held, size, names = [], 0, {}
            own = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        held.append((h, own[code][row] if len(row) else np.zeros(0, np.int64), linked))
        size += len(h)
    if size:
        yield join()


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[True, s[1:] != s[:-1]]) if len(s) else 0
    return out


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes by their first depth words, cut where their run ends.

    ids: dense, from 1; left: words from each to its run's end. Prefix doubling: the rank of 2k words is that of two ranks of k. lcp[i]: words that suffix
    i of the order shares with the one before, up to depth."""
    n, k, rank = len(ids), 1, ids
    while k < depth:
        ahead = np.zeros(n, np.int64)
        ahead[:-k] = np.where(left[:-k] > k, rank[k:], 0)
        rank = ranks(rank * (int(rank.max(initial=0)) + 1) + ahead)
        k *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    a, b = order[1:], order[:-1]
    for d in range(depth):
        same = same & (left[a] > d) & (left[b] > d)
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + d] == ids[b[at] + d]
        lcp[1:] += same
    return order, lcp


def run_lengths(linked: np.ndarray, most: int) -> np.ndarray:
    """Words from each to its run's end, itself among them, counted up to most."""
    left = np.ones(len(linked), np.int64)
    on = np.append(linked[1:], False)
    for _ in range(most - 1):
        left = np.where(on, np.append(left[1:], 0) + 1, 1)
    return left


def intervals(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a suffix, count) of each n-gram of depth words: the LCP intervals at that depth."""
    long = left[order] >= depth
    head = np.flatnonzero(long & (lcp < depth))
    count = np.add.reduceat(long.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    return order[head], count


def _word_key(lang: np.ndarray, h: np.ndarray, langs: list[str]) -> np.ndarray:
    """A key of each word in its language, the same in every task."""
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)
    return T.mix(h ^ T.mix(salt[lang]))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix(a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F))


def _spots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    h = T.mix(key ^ U(0x2545F4914F6CDD1D))
    return [(h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)]


def _known(key: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    for p in _spots(key, bits):
        out &= (words[p >> 6] >> (p & 63).astype(U)) & U(1) > 0
    return out


class Names(NamedTuple):
    """How a word's key becomes its id: the place among the sorted keys of frequent words, or (bits) the key itself, passed by a filter."""

    keys: np.ndarray
    bits: int = 0

    def ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, whether frequent)."""
        if self.bits:
            return T.signed(key), _known(key, self.bits, self.keys)
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << (bits - 6), U)
        for b in batches:
            h = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in b.schema.names]
            for p in _spots(h[0] if len(h) == 1 else _pair_key(*h), bits):
                np.bitwise_or.at(mine, p >> 6, U(1) << (p & 63).astype(U))
        at = np.flatnonzero(mine)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(T.signed(mine[at[i : i + 100_000]]))], names=["word", "mask"])

    return run


def bit_filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words) of a filter of rows of one or two numbers, of bounded size."""
    n = keys.count()
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, n) * 16)))))
    table = keys.mapInArrow(T.tidy(_fill(bits)), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), U)
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(U)
    return bits, words


def _key_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n with key."""
    for b in batches:
        data, offsets = T.utf8(b.column("word"))
        size = np.diff(offsets)
        up, down = T._POWERS[0].get(max(len(data), 1))
        # a word's hash as tokens() has it; no word is empty
        h = T.mix(np.add.reduceat(np.where(_GAPS, U(0), T._TABLE[0][0])[data] * up, offsets[:-1]) * down[offsets[:-1]] + size.astype(U)) if len(data) else np.zeros(0, U)
        lang, langs = _codes(b)
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), b.column("n"), pa.array(T.signed(_word_key(lang, h, langs)))], names=["lang", "word", "n", "key"])


def _name_words(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _ = names.value.ids(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), b.column("n"), pa.array(ids)], names=["lang", "word", "n", "w1"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of each slice; the word is null for the sum of a language."""
    for b in T.slices(batches, "text", 1 << 20):
        data, start, end, row, h, _ = tokens(b.column("text"))
        code, langs = _codes(b)
        lang = code[row] if len(row) else np.zeros(0, np.int64)
        order = np.lexsort((h, lang))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (lang[order][1:] != lang[order][:-1])] if len(h) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(h)))
        one = order[head]
        raw = data.tobytes()
        text = [raw[s:e].decode() for s, e in zip(start[one].tolist(), end[one].tolist())]
        total = np.bincount(lang, minlength=len(langs))
        names = pa.array(langs, pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([names.take(pa.array(lang[one])), names]), pa.array(text + [None] * len(langs), pa.string()), pa.array(np.append(n, total).astype(np.int64))],
            names=["lang", "word", "n"],
        )


def _count_runs(names, pairs, longest: int):
    """w1.., n of each shard's n-grams of frequent words: of two (pairs None), or of three to longest of which every pair is frequent by (bits, filter)."""
    depths = (2,) if pairs is None else tuple(range(3, longest + 1))
    width = max(depths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            word, ok = names.value.ids(_word_key(s.lang, s.h, s.langs))
            linked = s.linked.copy()
            linked[1:] &= ok[1:] & ok[:-1]
            if pairs is not None:
                at = np.flatnonzero(linked)
                linked[at] = _known(_pair_key(word[at - 1].view(U), word[at].view(U)), *pairs.value)
            left = run_lengths(linked, width)
            use = linked.copy()  # words in runs; the others would only be sorted
            use[:-1] |= linked[1:]
            keep = np.flatnonzero(use)
            left, word = left[keep], word[keep]
            order, lcp = suffix_array(ranks(word), left, width)
            for d in depths:
                first, n = intervals(order, lcp, left, d)
                cols = [pa.array(word[first + i]) if i < d else pa.nulls(len(first), pa.int64()) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=[*_KEY[:width], "n"])

    return run


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, totals) of docs (lang, text): lang, word, w1, n of the words and lang, w1..w4, n of the runs of 2 to 4 words that occur at least `least`
    times in their language; lang, total of all words."""
    T.small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    one = docs.mapInArrow(T.tidy(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    one = stored(one.where(F.col("word").isNull() | (F.col("n") >= least)), "phrase-counts")
    keyed = stored(one.where("word is not null").mapInArrow(T.tidy(_key_words), "lang string, word string, n long, key long"), "phrase-keys")
    totals = one.where("word is null and n > 0").select("lang", F.col("n").alias("total"))
    if keyed.count() <= MAX_IDS:
        names = Names(np.sort(keyed.select("key").toArrow().column("key").to_numpy().view(U)))
    else:
        bits, known = bit_filter(keyed.select("key"))
        names = Names(known, bits)
    names = sc.broadcast(names)
    words = stored(keyed.mapInArrow(T.tidy(_name_words(names)), "lang string, word string, n long, w1 long"), "phrase-words")

    def merged(width: int, pairs=None) -> DataFrame:
        key = _KEY[:width]
        rows = docs.mapInArrow(T.tidy(_count_runs(names, pairs, LONGEST)), ", ".join(f"{c} long" for c in (*key, "n")))
        rows = rows.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return stored(rows.select(*key, *(F.lit(None).cast("long").alias(c) for c in _KEY[width:]), "n"), "phrase-runs")

    two = merged(2)
    grams = two.unionByName(merged(LONGEST, sc.broadcast(bit_filter(two.select("w1", "w2")))))
    return words, grams.join(sized(words.select("w1", "lang"), MAX_LOOKUP), "w1").select("lang", *_KEY, "n"), totals


def _sub(first: int, length: int) -> list[Column]:
    return [F.col(_KEY[first + i]).alias(_KEY[i]) if i < length else F.lit(None).cast("long").alias(_KEY[i]) for i in range(LONGEST)]


def _matching(a: str, b: str) -> Column:
    out = F.col(f"{a}.lang") == F.col(f"{b}.lang")
    for c in _KEY:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def scored(words: DataFrame, grams: DataFrame) -> DataFrame:
    """lang, w1..w4, size, a, l, r, score of every frequent run of 2 to 4 words by its weakest cut."""
    size = sum(F.col(c).isNotNull().cast("int") for c in _KEY)
    g = grams.withColumn("size", size)
    known = stored(words.select("lang", "w1", *(F.lit(None).cast("long").alias(c) for c in _KEY[1:]), "n").unionByName(grams), "phrase-known")
    cuts = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            of = g.where(F.col("size") == n)
            for side, (first, length) in enumerate(((0, k), (k, n - k))):
                cuts.append(of.select("lang", F.struct(*_KEY).alias("run"), F.col("n").alias("a"), F.lit(n).alias("size"), F.lit(k).alias("k"), F.lit(side).alias("side"), *_sub(first, length)))
    parts = cuts[0]
    for x in cuts[1:]:
        parts = parts.unionByName(x)
    met = parts.alias("p").join(sized(known, MAX_LOOKUP).alias("q"), _matching("p", "q")).select("p.lang", "run", "a", "size", "k", "side", F.col("q.n").alias("f"))
    both = met.groupBy("lang", "run", "a", "size", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # a product of this size may pass 64 bits
    exact = F.expr("cast(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = both.withColumn("score", exact).groupBy("lang", "run", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "run.*", "size", "a", "cut.l", "cut.r", "cut.score")


def without_parts(runs: DataFrame, percent: int = 80) -> DataFrame:
    """runs (of scored, stored) less those whose words a longer run holds that occurs at least percent as often."""
    held = None
    for n in range(3, LONGEST + 1):
        for length in range(2, n):
            for first in range(n - length + 1):
                x = runs.where(F.col("size") == n).select("lang", *_sub(first, length), F.col("a").alias("f"))
                held = x if held is None else held.unionByName(x)
    held = held.groupBy("lang", *_KEY).agg(F.max("f").alias("f"))
    x = runs.alias("p").join(held.alias("q"), _matching("p", "q"), "left").select("p.*", "q.f")
    most = F.coalesce(F.col("f"), F.lit(0)).cast("decimal(20,0)") * 100
    return x.where(F.col("f").isNull() | (most < F.col("a").cast("decimal(20,0)") * percent)).drop("f")


def with_phrase(runs: DataFrame, words: DataFrame) -> DataFrame:
    """runs with phrase: their words, joined by spaces."""
    names = sized(words.select(F.col("lang").alias("_lang"), F.col("w1").alias("_w"), "word"), MAX_LOOKUP)
    for i, c in enumerate(_KEY):
        runs = runs.join(names.select("_lang", "_w", F.col("word").alias(f"_word{i}")), (F.col("lang") == F.col("_lang")) & (F.col(c) == F.col("_w")), "left").drop("_lang", "_w")
    return runs.withColumn("phrase", F.concat_ws(" ", *(f"_word{i}" for i in range(LONGEST)))).drop(*(f"_word{i}" for i in range(LONGEST)))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = 80, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to 4 words.

    A null or empty text has no words; a null language is `und`, as is one of that name; rows count as often as they stand there. Equal scores stand by falling
    a, then by phrase. A language without a phrase has no row; an empty table gives an empty result. Extra columns are ignored."""
    d = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, grams, totals = counts(d, least)
    runs = stored(scored(words, grams), "phrase-scored")
    left = without_parts(runs, percent)
    # the best of parts of a language, with all equal to the last, before words are put in; then the best of all
    by = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64(*_KEY), F.lit(PARTS))
    left = left.withColumn("_part", part).withColumn("_r", F.rank().over(W.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_r") <= top)
    left = stored(left.drop("_part", "_r"), "phrase-best")
    discard(runs)
    left = left.withColumn("_r", F.rank().over(W.partitionBy("lang").orderBy(*by))).where(F.col("_r") <= top)
    named = with_phrase(left, words).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by, "phrase")).cast("long")).where(F.col("rank") <= top)
    return named.join(F.broadcast(totals) if totals.count() <= MAX_LOOKUP else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first 2,000 phrases."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') ws FROM p),
t AS (SELECT lang, sum(len(ws)) n FROM w GROUP BY lang),
g AS (SELECT lang, k, ws[i:i + k - 1] s, count(*) f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) i FROM w, (SELECT unnest([1, 2, 3, 4]) k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT g.lang, g.k, g.s, g.f a, j, l.f l, r.f r, CAST(2000000::HUGEINT * g.f // (l.f + r.f) AS BIGINT) score FROM (SELECT *, unnest(range(1, k)) j FROM g WHERE k > 1) g
 JOIN g l ON l.lang = g.lang AND l.s = g.s[:j] JOIN g r ON r.lang = g.lang AND r.s = g.s[j + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
h AS (SELECT lang, s[i:i + m - 1] part, max(f) f FROM (SELECT lang, s, k, f, m, unnest(range(1, k - m + 2)) i FROM g, (SELECT unnest([2, 3]) m) WHERE m < k) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.s, ' ') phrase, a, l, r, n, score FROM b JOIN t USING (lang) LEFT JOIN h ON h.lang = b.lang AND h.part = b.s WHERE h.f IS NULL OR 100::HUGEINT * h.f < 80::HUGEINT * a)
SELECT lang, CAST(rank AS BIGINT) rank, phrase, a, l, r, CAST(n AS BIGINT) n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM o) WHERE rank <= 2000
"""
