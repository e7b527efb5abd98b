"""BPE encoding and decoding with content-defined chunks that are encoded once and reused."""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as T

#: A cut falls before a white byte where the rolling hash of the WINDOW bytes before it has MASK bits zero: about one in 64 words.
WINDOW, MASK = 16, np.uint64(63)
#: A stretch without a cut is cut at this many bytes, wherever that is.
MAX_CHUNK = 1 << 15
#: Most chunks in the table of reuse, and most bytes of one. The table is broadcast; what isn't in it is encoded where it stands, so the bound changes no result.
MAX_SHARED, MAX_SHARED_BYTES = 8192, 2048
#: Pieces that a worker remembers within a task (from task to task half of them: those met first, the frequent ones), and the longest of them; joints it remembers.
MAX_PIECES, LONG_PIECE, MAX_JOINTS = 400_000, 200, 50_000
_BYTE = T.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ROLL = T._Powers(int(_BYTE[3]) | 1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?"]] = True


def folds(path: str) -> bool:
    """Whether the tokenizer at path lowers A-Z and ends a token between a letter and a stop. One for which white space isn't dropped is an error."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    pieces = ["Abc", "def", "x's", "9"]
    if ids(" \t".join(pieces) + "\n") != [i for p in pieces for i in ids(p)]:
        raise ValueError(f"{path}: tokens cross white space, which this encoder can't do")
    letters = [chr(c) for c in range(97, 123)]
    return all(ids(c.upper()) == ids(c) for c in letters) and all(ids(c + p) == ids(c) + ids(p) for c in letters for p in ".,;:!?")


def folded(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; with fold of texts that encode alike but share more: A-Z in lower case, and a space between a letter and a single stop that
    ends a piece (there a token always ends). Only for a vocabulary that `folds`; texts that may hold special tokens stay as they are."""
    data, offsets = T.utf8(texts)
    if not fold or not len(data) or b"<|" in data.tobytes():
        return data, offsets
    data = _LOWER[data]
    ends = np.ones(len(data) + 1, bool)
    ends[:-1] = T._WS[data]
    ends[offsets] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = np.flatnonzero(_STOPS[data[1:]] & _SMALL[data[:-1]] & ends[2:] & ~begins[1:-1]) + 1
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of content-defined chunks that cover each row's bytes; rows without bytes have none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _ROLL.get(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])])
    white = np.flatnonzero(T._WS[data])
    row = np.searchsorted(offsets, white, side="right") - 1
    begin = np.maximum(white - WINDOW, offsets[row])
    cut = white[((T.mix((total[white] - total[begin]) * down[begin]) & MASK) == 0) & (white > offsets[row])]
    start = np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])
    gaps = np.diff(np.append(start, n))
    extra = []
    for i in np.flatnonzero(gaps > MAX_CHUNK):
        for p in range(start[i] + MAX_CHUNK, start[i] + gaps[i], MAX_CHUNK):
            while p < start[i] + gaps[i] and data[p] & 0xC0 == 0x80:  # not within a code point
                p += 1
            extra.append(p)
    if extra:
        start = np.union1d(start, np.array(extra))
        start = start[start < n]
    end = np.append(start[1:], n)
    h = T.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return np.searchsorted(offsets, start, side="right") - 1, start, h


class Encoder:
    """Encodes pieces between white bytes, which no token of this kind of vocabulary crosses, and remembers the short ones."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.ids: dict[bytes, str] = {}
        self.dec: dict[bytes, str] = {}
        self.names = list(map(str, range(self.tok.get_vocab_size(with_added_tokens=True))))
        self.pieces = MAX_PIECES
        self.long: list[bytes] = []
        self.joints: dict[tuple[bytes, bytes], bool] = {}

    def whole(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Ids and decoded text of each, each token's followed by one space."""
        ids = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        dec = self.tok.decode_batch(ids, skip_special_tokens=False)
        name = self.names.__getitem__
        return [" ".join(map(name, x)) + " " if x else "" for x in ids], [d + " " if x else "" for x, d in zip(ids, dec)]

    def forget(self) -> None:
        """Keep the pieces met first."""
        for p in list(itertools.islice(self.ids, self.pieces // 2, None)):
            del self.ids[p]
            del self.dec[p]

    def learn(self, pieces: set[bytes]) -> None:
        if len(self.ids) > self.pieces:
            self.forget()
        for p in self.long:
            self.ids.pop(p, None)
            self.dec.pop(p, None)
        new = [p for p in pieces if p not in self.ids]
        self.long = [p for p in new if len(p) > LONG_PIECE]
        ids, dec = self.whole([p.decode() for p in new])
        self.ids.update(zip(new, ids))
        self.dec.update(zip(new, dec))

    def span(self, pieces: list[bytes]) -> tuple[str, str]:
        """Ids and decoded text of pieces."""
        try:
            return "".join(map(self.ids.__getitem__, pieces)), "".join(map(self.dec.__getitem__, pieces))
        except KeyError:  # a part of a piece, beside a chunk that was cut within one
            self.learn(set(pieces))
            return self.span(pieces)

    def agree(self, raw: bytes, lo: int, at: int, hi: int) -> bool:
        """Whether the text across the joint at `at`, a piece to either side, encodes as its two sides do."""
        i, j = at, at
        while i > lo and T._WS[raw[i - 1]]:
            i -= 1
        while i > lo and not T._WS[raw[i - 1]]:
            i -= 1
        while j < hi and T._WS[raw[j]]:
            j += 1
        while j < hi and not T._WS[raw[j]]:
            j += 1
        sides = raw[i:at], raw[at:j]
        if sides not in self.joints:
            if len(self.joints) >= MAX_JOINTS:
                self.joints.clear()
            (x, y, both), _ = self.whole([sides[0].decode(), sides[1].decode(), raw[i:j].decode()])
            self.joints[sides] = x + y == both
        return self.joints[sides]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _counter(fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            h, n = np.unique(chunks(*folded(b.column("text"), fold))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _finder(wanted, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, seen = np.frombuffer(wanted.value, np.uint64), set()
        for b in T.slices(batches, "text"):
            data, offsets = folded(b.column("text"), fold)
            _, start, h = chunks(data, offsets)
            end = np.append(start[1:], len(data))
            hs, ts = [], []
            for i in np.flatnonzero(np.isin(h, want)):
                if int(h[i]) not in seen and end[i] - start[i] <= MAX_SHARED_BYTES:
                    seen.add(int(h[i]))
                    hs.append(h[i])
                    ts.append(data[start[i] : end[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(ts, pa.binary())], names=["h", "chunk"])

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dec = encoder(path).whole([x.decode() for x in b.column("chunk").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string()), pa.array(dec, pa.string())], names=["h", "chunk", "ids", "dec"])

    return run


def shared_chunks(docs: DataFrame, path: str, fold: bool, limit: int = MAX_SHARED) -> list:
    """h, chunk, ids, dec of the limit most frequent chunks that occur more than once, each encoded once by a task. docs: text."""
    counts = docs.mapInArrow(T.tidy(_counter(fold)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(limit).select("h").toPandas()["h"].to_numpy(np.int64)
    if not len(top):
        return []
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(top.view(np.uint64)).tobytes())
    found = docs.mapInArrow(T.tidy(_finder(wanted, fold)), "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))
    return [tuple(r) for r in found.mapInArrow(T.tidy(_encode_chunks(path)), "h long, chunk binary, ids string, dec string").collect()]  # limit rows at most


def _encoder_run(path: str, fold: bool, table, want_ids: bool, want_text: bool, pieces: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.pieces = pieces
        rows = table.value
        known = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(known)
        known = known[order]
        for b in T.slices(batches, "text"):
            data, offsets = folded(b.column("text"), fold)
            raw = data.tobytes()
            row, start, h = chunks(data, offsets)
            end = np.append(start[1:], len(data)).astype(np.int64)
            at = np.searchsorted(known, h)
            hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == h)) if len(known) else np.zeros(0, np.int64)
            parts: dict[int, list[tuple[int, int, tuple]]] = {}
            for i in hit:
                r = rows[order[at[i]]]
                s, e = int(start[i]), int(end[i])
                if raw[s:e] == r[1]:  # equal bytes, not only equal hashes
                    parts.setdefault(int(row[i]), []).append((s, e, r))
            split = [raw[offsets[k] : offsets[k + 1]].split() for k in range(b.num_rows)]
            enc.learn(set().union(*split))
            counts, ids_sha, dec_sha, ids, texts = [], [], [], [], []
            for k in range(b.num_rows):
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                if k in parts:
                    xs, ys, p = [], [], lo
                    for s, e, r in parts[k]:
                        # a joint that doesn't agree leaves the chunk to the span around it, which is encoded again from white byte to white byte
                        if enc.agree(raw, lo, s, hi) and enc.agree(raw, lo, e, hi):
                            x, y = enc.span(raw[p:s].split())
                            xs += [x, r[2]]
                            ys += [y, r[3]]
                            p = e
                    x, y = enc.span(raw[p:hi].split())
                    x, y = "".join([*xs, x]), "".join([*ys, y])
                else:
                    x, y = enc.span(split[k])
                x, y = x[:-1], y[:-1]
                counts.append(x.count(" ") + 1 if x else 0)
                ids_sha.append(hashlib.sha256(x.encode()).hexdigest())
                dec_sha.append(hashlib.sha256(y.encode()).hexdigest())
                if want_ids:
                    ids.append(np.array(x.split(), np.int32))
                if want_text:
                    texts.append(y)
            out = {**{c: b.column(c) for c in b.schema.names if c != "text"}, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(dec_sha)}
            if want_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if want_text:
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)
        if keep:
            enc.forget()
        else:
            _ENCODERS.clear()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = False, pieces: int = MAX_PIECES, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, as asked, ids (array<int>) and decoded (string) of every row.

    The tokenizer at path splits at white space and drops it (another is an error). A null or empty text has no token; rows that repeat are encoded each; ids may be null.
    Chunks between content-defined cuts that documents share are encoded once, in a bounded table that tasks receive; a document is put together from
    them and from the spans between. Each joint is encoded again with a piece to either side; where it doesn't agree with its sides, the chunk joins
    the span around it, up to white space or the text's end. pieces: how many encoded pieces a worker remembers, memory (about 0.4 kB each) against time;
    keep: whether it keeps half of them and the tokenizer from task to task.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    T.small_batches(d.sparkSession)
    fold = folds(path)
    table = d.sparkSession.sparkContext.broadcast(shared_chunks(d.select("text"), path, fold))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return d.mapInArrow(T.tidy(_encoder_run(path, fold, table, ids, decoded, pieces, keep)), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
