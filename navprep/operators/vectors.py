"""Vector utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, floor: float = 1e-7) -> Column:
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return dot(a, b) / (norm(a) * norm(b))


#: Prototypes that one broadcast holds.
PROTOTYPES = 10_000


def prototype_similarity(vectors: DataFrame, prototypes: DataFrame, block: int = PROTOTYPES) -> DataFrame:
    """vec_id, proto_id, similarity of every vector with each of a stated set of prototypes, which is counted and met in blocks: one block is broadcast, more are
    joined by their number."""
    blocks = max(1, -(-prototypes.count() // block))
    p = prototypes.select(F.col("vec_id").alias("proto_id"), F.col("embedding").alias("proto"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_b"))
    v = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = v.join(F.broadcast(p) if blocks == 1 else p, "_b")
    return met.select("vec_id", "proto_id", cosine(F.col("embedding"), F.col("proto")).alias("similarity"))


def cosine_loss(similarity: Column) -> Column:
    return (1 - similarity) / 2


def label_means(vectors: DataFrame) -> DataFrame:
    """label, at, mean: the mean vector of each label, component by component."""
    v = vectors.select("label", F.posexplode("embedding").alias("at", "x"))
    return v.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pearson_losses(pairs: DataFrame) -> DataFrame:
    """pair_id, loss = 1 - cosine of a and b after the mean over all values of their side is taken off. The means are one small row."""
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")))
    means = pairs.agg(*((total(c) / F.sum(F.size(c))).alias(f"mean_{c}") for c in "ab"))
    p = pairs.join(F.broadcast(means))  # one row
    off = lambda c: F.transform(c, lambda x: x.cast("double") - F.col(f"mean_{c}"))
    return p.select("pair_id", (1 - cosine(off("a"), off("b"))).alias("loss"))
