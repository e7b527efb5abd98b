"""Sharding, phrases and the manifest against brute force, with nulls, empty and long texts, ties, repeats and extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from navprep.llm import manifest, phrases, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n long, idx int, hash string, shard string, item string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """rows of (doc_id, text, lang, source, n_chars), with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", "w") for r in rows], SCHEMA)


def texts(n, seed=0, words="a b c d Ee f g".split()):
    r = random.Random(seed)
    out = [None, "", "  \t", "One two.", "One two.", "Ünï, x's ÄÖ", "a" * 5000, "a b " * 900]
    while len(out) < n:
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", ", ", "\n", "\t"]) for _ in range(r.randrange(1, 50)))
        out.append(t if r.random() < 0.7 else r.choice(out[3:]))
    return out


# sharding


def test_shards_hold_all_rows_once_in_near_equal_bytes(spark):
    rows = [(i if i % 11 else None, t, "en", "s", 1) for i, t in enumerate(texts(400))] + [(500, "hot copy", "en", "s", 1)] * 500
    out = sharding.pack(table(spark, rows), 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((i, size(t), zlib.crc32((t or "").encode()), len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, *_ in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32, x.tokens) for x in out) == want
    slots, load, copies = defaultdict(list), Counter(), defaultdict(set)
    for x in out:
        slots[x.shard].append(x.slot)
        load[x.shard] += x.size
        copies[x.text_crc32].add(x.shard)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 7
    # only texts that fill more than a shard are cut
    total = [sum(c * x[d] for x, c in want.items()) / 7 for d in (1, 3)]
    large = set()
    for t, c in Counter(t or "" for _, t, *_ in rows).items():
        if c > len(rows) / 7 or c * size(t) > total[0] or c * len(re.findall("[^\x20\x09-\x0d]+", t)) > total[1]:
            large.add(zlib.crc32(t.encode()))
    assert zlib.crc32(b"hot copy") in large and {k for k, v in copies.items() if len(v) > 1} == large
    per = Counter(x.shard for x in out)
    assert max(per.values()) <= 1.05 * len(rows) / 7


def test_placing_follows_the_dot_product():
    """The plain rule, item by item, without numpy's products."""
    r = random.Random(1)
    items = [[r.randrange(1, 500) * 10, r.randrange(1, 80), r.choice([1, 1, 2])] for _ in range(80)]
    total = [sum(x[d] for x in items) / 5 for d in range(3)]
    order = sorted(range(80), key=lambda i: -sum(w * items[i][d] / total[d] for d, w in enumerate(sharding.WEIGHTS)))
    left, want = [[1.0] * 3 for _ in range(5)], {}
    for i in order:
        fit = [sum(w * items[i][d] / total[d] * row[d] for d, w in enumerate(sharding.WEIGHTS)) for row in left]
        want[i] = max(range(5), key=lambda s: fit[s])
        for d in range(3):
            left[want[i]][d] -= items[i][d] / total[d]
    raw = np.array(items, float)
    moved = sharding.even_out(raw, np.array([want[i] for i in range(80)]), 5)
    assert (sharding.place(raw, 5) == moved).all()
    load = np.bincount(moved, raw[:, 0], 5)
    assert np.ptp(load) <= np.ptp(np.bincount([want[i] for i in range(80)], raw[:, 0], 5)) and np.ptp(load) < 0.02 * load.mean()
    # swaps keep each shard's rows
    assert (np.bincount(moved, raw[:, 2], 5) == np.bincount([want[i] for i in range(80)], raw[:, 2], 5)).all()


def test_slots_go_on_over_parts(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") % 4).cast("int").alias("s"), "id")
    out = defaultdict(list)
    for x in sharding.numbered(rows, "g", "s", ["id"]).collect():
        out[x.g].append(x.slot)
    assert {g: sorted(s) for g, s in out.items()} == {g: list(range(len(range(g, 100, 3)))) for g in range(3)}


# phrases


def test_suffix_array_by_definition():
    r = random.Random(2)
    for _ in range(30):
        n = r.randrange(1, 40)
        ids = np.array([r.randrange(1, 4) for _ in range(n)])
        linked = np.array([False] + [r.random() < 0.8 for _ in range(n - 1)])
        left = phrases.run_lengths(linked, 4)
        want = [next((k for k in range(1, 4) if i + k >= n or not linked[i + k]), 4) for i in range(n)]
        assert left.tolist() == want
        order, lcp = phrases.suffix_array(ids, left, 4)
        cut = [tuple(ids[i : i + left[i]]) for i in range(n)]
        assert [cut[i] for i in order] == sorted(cut)
        for d in range(1, 5):
            first, count = phrases.intervals(order, lcp, left, d)
            assert {cut[i][:d]: c for i, c in zip(first, count)} == dict(Counter(c[:d] for c in cut if len(c) >= d))


def best_phrases(rows, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        seen = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in seen.items():
            if any(100 * b >= percent * a for q, b in seen.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("seed,least,percent,top", [(0, 30, 80, 2000), (1, 5, 80, 40), (2, 3, 50, 25)])
def test_collocations(spark, seed, least, percent, top):
    r = random.Random(seed)
    rows = [(i, t, r.choice(["en", "de", None, "und", "x\ty, z"]), "s", 1) for i, t in enumerate(texts(300, seed, "a b c d Ee É é f g".split(" ")))]
    rows += rows[:20]
    got = phrases.collocations(table(spark, rows).repartition(5), least, percent, top).collect()
    assert {tuple(x) for x in got} == best_phrases(rows, least, percent, top) and len(got) == len({tuple(x) for x in got})


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**13  # 2,000,000 times this passes 64 bits
    words = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 2, big + 2)], "lang string, word string, w1 long, n long")
    grams = spark.createDataFrame([("en", 1, 2, None, None, big)], "lang string, w1 long, w2 long, w3 long, w4 long, n long")
    (x,) = phrases.scored(words, grams).collect()
    assert (x.a, x.l, x.r, x.score) == (big, big + 1, big + 2, 2000000 * big // (2 * big + 3))


def test_shards_of_words_are_whole_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a b c", "a b", "c a b. a", None, "b"], "lang": ["x", None, "x", "y", "und"]})
    out = list(phrases.shards(iter([batch.slice(i, 1) for i in range(5)]), 4))
    assert [len(s.h) for s in out] == [3, 2, 4, 1]
    assert [s.linked.tolist() for s in out] == [[False, True, True], [False, True], [False, True, True, False], [False]]


# manifest


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    doc_id, _, lang, source, n_chars = r
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def parents(level, fanout):
    return [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]


def path(level, at, fanout):
    """(steps, root) from the node at that place."""
    steps = []
    while len(level) > 1:
        run = level[at // fanout * fanout :][:fanout]
        steps.append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        level, at = parents(level, fanout), at // fanout
    return steps, level[0]


def expected(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {g: sorted(((r[0] is not None, r[0] or 0), leaf_of(r, r[1]), r) for r in groups[g]) for g in names}
    subroots = [path([x[1] for x in leaves[g]], 0, fanout)[1] for g in names]
    out = []
    for k, g in enumerate(names):
        for i, (_, leaf, r) in enumerate(leaves[g]):
            low, sub = path([x[1] for x in leaves[g]], i, fanout)
            high, root = path(subroots, k, fanout)
            x = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = leaf_of(r, r[1] and r[1].translate(FOLD))
            for a, b in low + high:
                x = h(a + x + b)
            out.append((r[0], leaf, sub, root, h("".join(a + b for a, b in low + high)), x, x == root))
    return Counter(out)


@pytest.mark.parametrize("fanout,sources", [(16, 3), (16, 40), (3, 1), (2, 5)])
def test_manifest(spark, fanout, sources):
    r = random.Random(fanout)
    # no repeated ids with other texts in tampered rows' places: repeats are full
    rows = [(i, t, r.choice(["en", None]), None if i % 17 == 0 else f"s{r.randrange(sources)}", None if i % 13 == 0 else len(t or "")) for i, t in enumerate(texts(230))]
    rows += [(1000, "Alone", "en", "one of its own", 5), (5000, "Same", "en", "é", 4), (5000, "Same", "en", "é", 4), (None, "No id", "en", "é", 5), (None, "no ID", "en", "é", 5)]
    r.shuffle(rows)
    docs = table(spark, rows)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = manifest.manifest(docs, tampered={"text": manifest.lowered(F.col("text"))}, where=picked, fanout=fanout)
    got = Counter((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) for x in out.collect())
    assert got == expected(rows, fanout)
    assert any(not k[-1] for k in got) and any(k[-1] for k in got)


@pytest.mark.parametrize("name", ["pack", "collocations", "manifest"])
def test_empty_tables(spark, name):
    docs = table(spark, [])
    out = {"pack": lambda: sharding.pack(docs, 4), "collocations": lambda: phrases.collocations(docs), "manifest": lambda: manifest.manifest(docs)}[name]()
    assert out.collect() == []


def test_words_beyond_the_ids_are_named_by_hash(spark, monkeypatch):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts(120, 5))]
    want = best_phrases(rows, 5, 80, 2000)
    for most in (1 << 23, 3):
        monkeypatch.setattr(phrases, "MAX_IDS", most)
        assert {tuple(x) for x in phrases.collocations(table(spark, rows), 5).collect()} == want
