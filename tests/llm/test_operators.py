"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from navprep.llm import ann, bpe, chat, fingerprint, lm, mixing, near_dup, substring, toxicity, warc
from navprep.llm import _text as T

W = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus(seed=0, n=60, words=6):
    """Few distinct words, so that passages, runs and copies abound."""
    r = random.Random(seed)
    texts = [None, "", " \t", "One", "one", "Ünï   x's <|endoftext|>", "a" * 3000, "a b " * 700]
    while len(texts) < n:
        t = " ".join(r.choice("abcdefgh"[:words]) for _ in range(r.randrange(1, 60)))
        texts.append(t if r.random() < 0.6 or len(texts) < 9 else r.choice(texts[8:]) + r.choice(["", " a", " b c"]))
    return [(i, t) for i, t in enumerate(texts)]


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if i != 7 else None, None, 0.0) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("seed,words", [(0, 2), (1, 4), (2, 8)])
def test_substrings(spark, seed, words):
    docs = corpus(seed, 60, words)
    first, want = {}, {}
    split = [(i, W.findall(t or "")) for i, t in docs]
    for i, w in split:
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in split:
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(table(spark, docs)).collect()}
    assert got == want


def test_near_duplicates(spark):
    docs = corpus(3, 60, 8)
    sets = {}
    for i, t in docs:
        w = W.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table(spark, docs), k=3, percent=85).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_a_large_group(spark):
    """Copies in a ring: each like its neighbours, unlike the others."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 5 : i * 5 + 200])) for i in range(40)]
    got = near_dup.near_duplicates(table(spark, docs), k=1, percent=90).collect()
    assert {r.component_id for r in got} == {0}
    assert near_dup.least_matches(0.8)[-1] < 0.8 * 128


def test_bpe(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    long = "Shared words, as they are; " * 300
    docs = [*corpus(4), (100, long), (101, long + "end"), (102, "x" * 40000), (103, "don't. <|startoftext|>Stop.") , (None, "no id")]
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode(table(spark, docs), path, decoded=True).collect()}
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False) and got[i].ids_sha256 == sha(" ".join(map(str, ids)))


def test_fingerprints(spark):
    docs = corpus(5)
    got = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, docs)).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        assert got[i].edited_sha256 == sha(t[: len(t) - q] + nxt[:q]) and got[i].n_chars == len(t)
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprint.fingerprints(table(spark, docs[:1])).first().near_next == 1
    assert fingerprint.fingerprints(table(spark, [])).count() == 0


def test_mix(spark):
    docs = corpus(6, 80, 8)
    rows = mixing.mix(table(spark, docs)).collect()
    sizes, names = Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        names[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left = {}, float(sum(sizes.values()))
    free = set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    taken = Counter()
    for r in rows:
        assert math.isclose(r.target, want[r.source])
        taken[r.source] += r.taken
    # whole copies come within half of the smallest document
    least = {s: min(r.size for r in rows if r.source == s and r.size) for s in order}
    assert all(abs(taken[s] - want[s]) <= max(10, 0.05 * want[s], 0.5 * least[s]) for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table(spark, docs)).collect()))
    assert mixing.mix(table(spark, [])).count() == 0


def test_lm(spark):
    docs = corpus(7)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: [*W.findall((t or "").replace("O", "o")), None] for i, t in docs}
    c = Counter(x for i, w in words.items() if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    got = lm.score(table(spark, docs)).collect()
    for r in got:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(r.doc_id))
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    p = np.exp(lm.Network.new(np.full(lm.SIZE, 1 / lm.SIZE)).log_probabilities().astype(float)).sum(2)
    assert np.allclose(p, 1, atol=1e-4)


def test_lm_words_grow(spark):
    """Words that recur have symbols of their own, however many; the rest classes. Probabilities sum to one, and training learns what follows what."""
    r = random.Random(12)
    word = lambda i: f"w{i % 300}q"
    texts = [" ".join(word(k + j) for j in range(60)) + f" once{i}" for i in range(300) for k in [r.randrange(300)]]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    T.small_batches(spark)
    m, _ = lm.train(df)
    assert len(m.top) == m.network.words == 300
    n, sides = m.network.size, m.network.sides()
    s = np.arange(n)
    for two, one in ((n, n), (n, 5), (17, 200), (0, n - 1)):
        assert math.isclose(np.exp(m.network.log_of(sides, np.full(n, two), np.full(n, one), s)).sum(), 1, abs_tol=1e-4)
    t = lm.tokens(__import__("pyarrow").array(texts))
    s = lm.symbols(t, m.top, m.top_at, 300)
    assert (s <= 300).sum() == 61 * 300
    got = m.network.log_of(sides, *lm.contexts(s, t, n), s).mean()
    p = np.bincount(s, minlength=n) / len(s)
    assert got > np.log(p[s]).mean() + 0.5


class Counted:
    """numpy, counting the numbers that exp takes."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, z, **more):
        self.n += z.size
        return np.exp(z, **more)


def small_network(words=300, spread=1.0):
    r = np.random.default_rng(4)
    net = lm.Network.new(r.dirichlet(np.full(words + 1 + lm.CLASSES, 0.5)))
    net.rows[:, : lm.DIM] += r.standard_normal((len(net.rows), lm.DIM)) * spread
    return net, r


def plain_log_of(net, two, one, s):
    context, top, word, c1, c2 = (x.astype(float) for x in net.parts())
    q = np.append(context[one, : lm.DIM] * c1[:, : lm.DIM] + context[two, : lm.DIM] * c2[:, : lm.DIM], np.ones((len(s), 1)), 1)

    def share(z, at):
        z = z - z.max(1, keepdims=True)
        return z[np.arange(len(z)), at] - np.log(np.exp(z).sum(1))

    out = share(q @ top.T, net.first_step(s))
    for i in np.flatnonzero((s > 0) & (s <= net.words)):
        b = (s[i] - 1) // net.width
        out[i] += share(q[i : i + 1] @ word[b * net.width : (b + 1) * net.width].T, (s[i : i + 1] - 1) % net.width)[0]
    return out


@pytest.mark.parametrize("spread,tokens", [(0.3, 7000), (0.3, 100), (4.0, 7000), (12.0, 7000)])
def test_lm_probabilities_by_their_definition(monkeypatch, spread, tokens):
    """By the sums of frequent pairs and directly, with logits out of a float's range too."""
    monkeypatch.setattr(lm, "PAIRED", 100)
    net, r = small_network(spread=spread)
    two, one, s = r.integers(0, 40, tokens), r.integers(0, net.size + 1, tokens), r.integers(0, net.size, tokens)
    with np.errstate(all="ignore"):
        got = net.log_of(net.sides(), two, one, s)
    want = plain_log_of(net, two, one, s)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_lm_scores_with_exponentials_of_frequent_words_once(monkeypatch):
    """The first step and the first blocks, which most tokens are in, take none for a token."""
    net, r = small_network(spread=0.3)
    n = 20_000
    two, one, s = (r.integers(0, 30, n) for _ in range(3))
    counted = Counted()
    monkeypatch.setattr(lm, "np", counted)
    net.log_of(net.sides(), two, one, s)
    first = 1 + net.blocks + lm.CLASSES
    assert counted.n <= 2 * (net.size + 1) * (first + 2 * net.width) < n * first / 10


def test_lm_training_step_by_its_definition():
    """One batch against token by token in doubles, with the same noise: touched rows take the mean of their gradients."""
    net, r = small_network(spread=0.3)
    p = r.dirichlet(np.full(net.size, 0.5))
    n = 500
    two, one, s = r.integers(0, net.size + 1, n), r.integers(0, 20, n), r.integers(0, net.size, n)
    t = lm.Trainer(net, p, 9)
    t.batch(two, one, s)
    first, own = net.steps(p)
    draw = np.random.default_rng(9)
    noise = np.searchsorted(np.cumsum(first) / first.sum(), draw.random(lm.NOISE))
    words = np.flatnonzero((s > 0) & (s <= net.words))
    edge, u = np.append(0, np.cumsum(own)), draw.random((len(words), lm.NOISE_WORDS))
    rows = net.rows.astype(float)
    context, top, word, _, _ = (net.starts[i] for i in range(5))
    c1, c2 = rows[net.starts[3], : lm.DIM], rows[net.starts[4], : lm.DIM]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    grads = {}
    of_c, of_noise = np.zeros((2, lm.DIM + 1)), np.zeros((lm.NOISE, lm.DIM + 1))
    at_word = {i: k for k, i in enumerate(words)}
    for i in range(n):
        x1, x2 = rows[context + one[i], : lm.DIM], rows[context + two[i], : lm.DIM]
        q, d_q = np.append(x1 * c1 + x2 * c2, 1), np.zeros(lm.DIM + 1)
        f = net.first_step(s[i : i + 1])[0]
        d = 1 - sigmoid(q @ rows[top + f] - np.log(lm.NOISE * first[f]))
        grads.setdefault(top + f, []).append(d * q)
        d_q += d * rows[top + f]
        for k, x in enumerate(noise):
            d = -sigmoid(q @ rows[top + x] - np.log(lm.NOISE * first[x]))
            of_noise[k] += d * q
            d_q += d * rows[top + x]
        if i in at_word:
            lo = (s[i] - 1) // net.width * net.width
            hi = min(lo + net.width, net.words)
            drawn = [np.clip(np.searchsorted(edge, edge[lo] + v * (edge[hi] - edge[lo]), "right") - 1, lo, hi - 1) for v in u[at_word[i]]]
            for k, x in enumerate([s[i] - 1, *drawn]):
                d = (k == 0) - sigmoid(q @ rows[word + x] - np.log(lm.NOISE_WORDS * own[x] / own[lo : lo + net.width].sum()))
                grads.setdefault(word + x, []).append(d * q)
                d_q += d * rows[word + x]
        d_q[lm.DIM] = 0
        grads.setdefault(context + one[i], []).append(np.append(d_q[: lm.DIM] * c1, 0))
        grads.setdefault(context + two[i], []).append(np.append(d_q[: lm.DIM] * c2, 0))
        of_c[0, : lm.DIM] += x1 * d_q[: lm.DIM] / n
        of_c[1, : lm.DIM] += x2 * d_q[: lm.DIM] / n
    for k, x in enumerate(noise):
        grads.setdefault(top + x, []).append(of_noise[k])
    touched = np.zeros(len(rows))
    for k, g in [*grads.items(), (net.starts[3], [of_c[0]]), (net.starts[4], [of_c[1]])]:
        mean = np.mean(g, axis=0)
        rows[k] += 0.05 * mean / np.sqrt(1e-3 + mean * mean)
        touched[k] = len(g)
    touched[net.starts[3] :] = n
    assert np.allclose(t.net.rows[:, : lm.DIM + 1], rows, atol=1e-4) and (t.touched == touched).all()


def test_toxicity(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(40)) + (" vile rotten vile" if i % 3 == 0 else "")) for i in range(240)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in docs[:240]], "doc_id long, quality int, toxic int")
    d = table(spark, docs)
    got = {x.doc_id: x for x in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert all(got[i].predicted == (i % 3 == 0) for i, _ in docs[:240]) and got[900].predicted == got[901].predicted == 0
    assert toxicity.score(d, toxicity.train(d, labels.limit(0))).where("predicted = 1").count() == 0


def test_segments():
    assert toxicity.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_nearest(spark):
    r = np.random.default_rng(9)
    v = r.standard_normal((400, 8)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=90, block_rows=4).collect()
    for q in range(0, 400, 50):
        s = np.round(x @ x[q], 9)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])] == want
    loose = ann.nearest(df, df.where("vec_id % 50 = 0"), factor=1.5, shard_rows=90).count()
    assert 0 < loose <= 40


def test_nearest_among_many_copies(spark):
    """More copies in a shard than k: ties to the smaller ids, whatever the rounding of products; copies scaled by 2 tie, too."""
    r = np.random.default_rng(11)
    v = r.standard_normal((2000, 64)).astype(np.float32)
    v[300:1800] = v[300]
    v[1000:1400] *= 2
    ids = r.permutation(2000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    copies = np.sort(ids[300:1800])
    queries = [int(i) for i in (copies[0], copies[3], *copies[700:720])]
    rows = ann.nearest(df, df.where(df.vec_id.isin(queries))).collect()
    for q in queries:
        got = [g.vec_id for g in sorted((g for g in rows if g.query_id == q), key=lambda g: g["rank"])]
        assert got == [i for i in copies[:6] if i != q][:5], q


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (3, 0, None, None), (None, 0, "user", "n"), (4, 0, "user", "u"), (4, 300, "assistant", "v"), (4, 600, "system", "w")]
    out = chat.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.turn)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert text[1] == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert text[2] == "<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n"
    for t in text.values():
        roles = re.findall(r"<\|(system|user|assistant)\|>", t)
        assert re.fullmatch("(s)?(ua)+", "".join(x[0] for x in roles)), t
    assert len(out) == len(rows)


def test_revisits(spark):
    rows = [(1, "response", "http://www.A.com/x?utm_source=q", 10, 200, "e", None, {"content-type": "t", "date": "1"}), (2, "revisit", "https://a.com/x/", 20, 304, "e", None, {"date": "2", "content-type": "no"}),
            (3, "revisit", "a.com/x", 5, 304, "e", None, None), (4, "revisit", "a.com/x", 30, 304, "f", None, {}), (5, "revisit", None, 30, 304, None, None, {})]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, etag string, last_modified string, headers map<string,string>")
    for bucket in (3, 1000):
        got = {r.record_id: (r.state, r.response_id, r.headers) for r in warc.resolve_revisits(df, bucket).collect()}
        assert got == {2: ("resolved", 1, {"content-type": "t", "date": "2"}), 3: ("missing", None, None), 4: ("changed", 1, None), 5: ("missing", None, None)}


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["a  b c\n", None, "", "\x0b\x0c x"]
    w = T.words(pa.array(texts))
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == [x for t in texts for x in W.findall(t or "")]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, sf)
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < kept.count() <= 3 * docs.count()
