"""Sharding as vector bin packing: bytes, tokens and rows are balanced at once, equal texts stay together.

A group (all rows of one text) is a vector of its shares of a shard's bytes, tokens and rows. The largest groups are placed first, each into the shard where
the dot product of the group and the shard's residual capacity is highest. The number of things to place is bounded whatever the corpus holds: groups beyond
FINE of a shard in any dimension stand alone (there are at most 3 * shards / FINE of them), smaller ones are dealt by their hash into bundles of texts of about
equal length. A group larger than a shard can't be balanced and is cut into pieces by a hash of its rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ._store import discard, sized, stored
from .mixing import word_count

OVERHEAD = 16
#: Weight of a group's bytes, tokens and rows in the dot product: bytes are the law, the others follow.
WEIGHTS = (4.0, 1.0, 1.0)
#: Share of a shard beyond which a group is placed on its own, and the most a piece of a group larger than a shard holds.
FINE, PIECE = 1 / 256, 1 / 64
#: Bundles of small groups for each power of two of the length.
BUNDLES = 512
#: Rows of a shard that one task numbers.
SLOT_ROWS = 100_000
DIMS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """A shard for each of items (n, 3: bytes, tokens, rows), by falling weighted sum of shares, in the given order where these are equal.

    Capacities are the totals divided by the shards; a dimension without any total counts nothing."""
    total = items.sum(0)
    share = items / np.where(total > 0, total / shards, 1.0)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int32)
    w = np.asarray(weights)
    for i in np.argsort(-(share @ w), kind="stable"):
        at = int(np.argmax(left @ (share[i] * w)))
        out[i] = at
        left[at] -= share[i]
    return even_out(items, out, shards)


def even_out(items: np.ndarray, shard: np.ndarray, shards: int, near: float = 0.002) -> np.ndarray:
    """shard after swaps between the shards of most and least bytes, of items with equally many rows, until their bytes differ by no more than `near` of a
    shard or no swap narrows the gap. It matters where a shard holds few groups: rows then can't be balanced in finer steps than bytes."""
    shard, size = shard.copy(), items[:, 0]
    load = np.bincount(shard, size, shards)
    while True:
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap <= near * load.mean():
            return shard
        a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
        less = np.where(items[a, None, 2] == items[None, b, 2], size[a, None] - size[None, b], 0.0)
        gain = np.where((less > 0) & (less < gap), gap / 2 - np.abs(less - gap / 2), 0.0)
        if not gain.size or gain.max() <= 0:
            return shard
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        shard[a[i]], shard[b[j]] = lo, hi
        load[hi] -= less[i, j]
        load[lo] += less[i, j]


def pack(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, tokens, text_crc32, shard, slot of every row of docs.

    Rows of equal text share a shard unless they fill more than one. A null text is an empty one (size 16, no token, crc32 0); null and repeated ids are rows
    like others; an empty table gives an empty result. Slots are numbered without gaps by salted counts, ties in no stated order. Extra columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "shard-rows")
    key = ["k1", "k2", "size"]
    groups = stored(rows.groupBy(*key).agg(F.max("tokens").alias("tokens"), F.count("*").alias("rows")), "shard-groups")
    per = groups.select((F.col("rows") * F.col("size")).alias("bytes"), (F.col("rows") * F.col("tokens")).alias("tokens"), "rows")
    total = per.agg(*(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in DIMS)).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    # the hash decides within a power of two of the length, so that bundles differ in bytes a row
    bundle = F.concat_ws("/", F.floor(F.log2("size")).cast("string"), F.pmod("k1", F.lit(BUNDLES)).cast("string"))
    share = F.greatest(*((F.col(v) * F.col("rows")) * (shards / max(total[c], 1.0)) for v, c in (("size", "bytes"), ("tokens", "tokens"))), F.col("rows") * (shards / total["rows"]))
    alone = groups.withColumn("share", share).where(F.col("share") > FINE)
    pieces = F.when(F.col("share") > 1, F.ceil(F.col("share") / PIECE)).otherwise(1).cast("long")
    alone = stored(alone.select(*key, pieces.alias("pieces")), "shard-alone")  # at most 3 * shards / FINE rows
    name = F.when(F.col("pieces").isNull(), bundle).otherwise(F.concat_ws(":", *key, F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))))
    named = rows.join(F.broadcast(alone), key, "left").withColumn("item", name)
    sums = named.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    items = sums.toPandas().sort_values("item", ignore_index=True)  # bounded: bundles, lone groups and pieces
    items["shard"] = place(items[list(DIMS)].to_numpy(float), shards)
    plan = docs.sparkSession.createDataFrame(items[["item", "shard"]].astype({"shard": "int32"}), "item string, shard int")
    salts = max(1, -(-int(total["rows"]) // (shards * SLOT_ROWS)))
    dealt = named.join(F.broadcast(plan), "item").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    dealt = stored(dealt.select("doc_id", "size", "tokens", "text_crc32", "row", "shard", "salt"), "shard-dealt")
    discard(rows, groups, alone)
    return numbered(dealt, "shard", "salt", ["doc_id", "row"]).drop("row", "salt")


def numbered(rows: DataFrame, group: str, salt: str, order: list[str]) -> DataFrame:
    """rows (stored) with slot: places from 0 in their group, part after part of it; a task numbers one (group, salt)."""
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(salt).alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select("_g", "_s", before.alias("_before")), "shard-offsets")
    x = rows.withColumn("_k", F.row_number().over(W.partitionBy(group, salt).orderBy(*order)) - 1)
    x = x.join(sized(offsets), (F.col(group) == F.col("_g")) & (F.col(salt) == F.col("_s")))
    return x.withColumn("slot", (F.col("_before") + F.col("_k")).cast("long")).drop("_g", "_s", "_before", "_k")


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (and tokens) of every document, in 40 shards of nearly equal bytes."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
