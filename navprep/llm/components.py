"""Connected components by alternating large-star and small-star rounds: shuffles only, no component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (u, v) edges, v < u. large: each node's larger neighbours go to its least neighbour; small: its smaller ones do."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = sides.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of the (a, b) edges. Self loops, repeats and either direction are fine; nulls are ignored."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "cc")
    for _ in range(rounds):
        # done when every node has one edge down and no root has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 or down = 1 and root = 1").isEmpty():
            break
        before, e = e, stored(_star(_star(e, True), False), "cc")
        discard(before)
    else:
        raise RuntimeError(f"no forest of stars after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
