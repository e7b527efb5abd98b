"""More of the training-data operators: repeated rows, hot buckets, least costs, segments and likeness by brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from navprep.llm import _text as T
from navprep.llm import bpe, chat, fingerprint, near_dup, substring, toxicity

A, B = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(20))
REPEATED = [(1, A), (2, A), (2, A), (2, B + " " + A), (3, B), (3, A + " x"), (None, A), (4, None), (4, None), (5, A)]


def test_substrings_of_repeated_ids(spark):
    got = substring.dedup_substrings(spark.createDataFrame(REPEATED, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == sorted(
        [("1", 30, 0), ("2", 30, 30), ("2", 30, 30), ("2", 50, 30), ("3", 20, 20), ("3", 31, 30), ("None", 30, 0), ("4", 0, 0), ("4", 0, 0), ("5", 30, 30)]
    )


def test_stages_keep_nulls_and_cut_repeats(spark):
    import corpus_pipeline as c

    rows = [(i, t, "en", None, len(t or "")) for i, t in REPEATED]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text or "") for r in c.cut_repeats(spark, docs, "").collect())
    assert got == sorted([("1", A), ("None", A), ("4", ""), ("4", ""), ("2", ""), ("2", ""), ("2", B), ("3", ""), ("3", "x"), ("5", "")])
    assert all(r.n_chars == len(r.text or "") for r in c.cut_repeats(spark, docs, "").collect())
    kept = {r.doc_id for r in c.drop_near_duplicates(spark, docs.where("doc_id in (1, 5) or doc_id is null"), "").collect()}
    assert kept == {1, None}
    empty = docs.limit(0)
    for stage in (c.drop_near_duplicates, c.cut_repeats, c.mix_sources):
        assert stage(spark, empty, "").count() == 0


def test_near_duplicates_of_a_hot_bucket(spark, monkeypatch):
    """Many blocks of one bucket: texts of one word in common each with the next, so that all pairs of blocks must meet."""
    for name, value in (("BLOCK", 4), ("SET_BLOCK", 3), ("TURN", 2)):
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):  # every two share a part; near ones are linked through others alone
        w = list(base)
        for k in range(i // 4):
            w[k] = f"x{i // 4}y{k}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    sets = [frozenset(t.split()) for t in texts]
    top = list(range(60))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs, k=1, percent=80).collect()}
    assert got == {i: find(i) for i in range(60)}


def best_segments(s, at=0):
    """By the definition: the best stretch, then those to its left and right."""
    if not s or max(s) <= 0:
        return []
    f, t = max(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: sum(s[x[0] : x[1]]))
    return best_segments(s[:f], at) + [(at + f, at + t)] + best_segments(s[t:], at + t)


def test_segments_by_definition():
    r = random.Random(3)
    for n in range(60):
        s = [r.uniform(-2, 1.5) for _ in range(n % 25)]
        assert [(f, t) for f, t, _ in toxicity.segments(s)] == best_segments(s)


def test_passages_scan_every_token():
    r = random.Random(4)
    words = [f"t{i}" for i in range(12)]
    w = T.words(pa.array(words), lower=True, punct=True)
    h = T.mix(w.h[0] + np.uint64(1))
    order = np.argsort(h)
    weight = {x: r.uniform(-1, 1) for x in words[:9]}  # three are unknown
    known = [i for i in order if words[i] in weight]
    model = toxicity.Model(h[known], np.array([weight[words[i]] for i in known]), 1.0, 1.0, 0.0, 1.0)
    texts = [[r.choice(words) for _ in range(n)] for n in (0, 1, 30, 7)]
    got = toxicity.passages(T.words(pa.array([" ".join(t) for t in texts]), lower=True, punct=True), model)
    for t, found in zip(texts, got):
        assert [(f, e) for f, e, _ in found] == best_segments([weight.get(x, toxicity.DRIFT) for x in t])


def test_chat_has_the_least_cost(spark):
    r = random.Random(6)
    names = [None, *chat.ROLES]
    chats = [[r.randrange(4) for _ in range(r.randrange(1, 7))] for _ in range(60)]
    rows = [(c, i, names[x], "t") for c, roles in enumerate(chats) for i, x in enumerate(roles)]
    out = chat.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), stretch=3).collect()
    for c, roles in enumerate(chats):
        want = min(
            sum(chat.COSTS[x, a, b] for x, a, b in zip(roles, (0, *path), path)) + chat.END[path[-1]][0]
            for path in itertools.product((1, 2, 3), repeat=len(roles))
        )
        assert math.isclose(sum(x.cost for x in out if x.conv_id == c), want)


def test_likeness_is_near_the_jaccard_similarity(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(2000)) for _ in range(6)]
    texts[1] = texts[0][:1700] + texts[1][:300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    for x in fingerprint.fingerprints(docs).collect():
        t, nxt = texts[x.doc_id], texts[(x.doc_id + 1) % 6]
        edited = t[:1500] + nxt[:500]
        e = {edited[i : i + 8] for i in range(len(edited) - 7)}
        for got, a, b in ((x.near_edited, sets[x.doc_id], e), (x.near_next, sets[x.doc_id], sets[(x.doc_id + 1) % 6])):
            j = len(a & b) / len(a | b)
            assert abs(got - j) <= 3 * math.sqrt((j + 1 / 16) * (1 - j) / fingerprint.BINS) + 0.02, (got, j)


def test_tokenizers_that_keep_white_space_are_refused():
    tokenizers = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="white space"):
        bpe.folds(tokenizers.path("byte_bpe_50k.json"))
    assert bpe.folds(tokenizers.path("word_bpe_49k.json"))
    assert re.fullmatch("[a-z ]+", bpe.folded(pa.array(["AB cd"]))[0].tobytes().decode())
