"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

The copies of each document are the rounded solution of: minimise the Kullback-Leibler divergence of document rates from 1, so that each source's
expected words meet its target and no rate exceeds max_copies. The dual is convex with one variable a source; its solution tilts exponentially in the
document's size: rate = min(max_copies, exp(theta * size)). Newton's method finds theta from distributed sums over the (source, size) histogram,
guarded by a bracket that holds the root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ._store import stored

#: Share of the weights by the rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SALTS = 64
#: Sources up to which tables of a few rows for each are broadcast; beyond, they are shuffled.
MAX_SMALL_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null: 0."""
    # every white byte becomes a space; words are then the non-empty parts
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda x: x != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from (source, n, size) rows. Sources by code point, null last, take weights in turn; a target stops at max_copies times
    the source's size and the excess is reshared by weight until none is above: the level is found by one pass over the sources by capacity / weight."""
    by = W.orderBy(F.col("source").asc_nulls_last())
    all_ = W.partitionBy()
    s = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    s = s.withColumn("k", F.row_number().over(by) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("ratio", F.col("cap") / F.col("w"))
    up = W.orderBy("ratio", "k").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(all_)).withColumn("wsum", F.sum("w").over(all_))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.col("wsum") - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    # the first source, by ratio, that holds its level sets it for itself and all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(all_)["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _beside(df: DataFrame, sources: int) -> DataFrame:
    """A table of some rows for each source, as a join's small side."""
    return F.broadcast(df) if sources <= MAX_SMALL_SOURCES else df.hint("merge")


def tilt(hist: DataFrame, targets: DataFrame, max_copies: int, tolerance: float = 1e-10, iterations: int = 80) -> DataFrame:
    """source, theta by distributed Newton iterations on the dual; theta null: every rate is max_copies (or no words). It is an error if iterations aren't enough:
    a step outside the bracket halves it, so 80 of them reach the tolerance from any start."""
    cap, top = float(max_copies), math.log(max_copies)
    t = targets.select("source", "source_size", "target")
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    lo = F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size")) - 1e-9).otherwise(0.0)
    hi = F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(top)
    now = stored(t.where(open_).select("source", "target", lo.alias("lo"), hi.alias("hi"), F.lit(0.0).alias("theta"), F.lit(1.0).alias("gap")), "mix-theta")
    h, sources = hist.where("size > 0"), now.count()
    for _ in range(iterations):
        x = h.alias("h").join(_beside(now, sources).alias("t"), _same(F.col("h.source"), F.col("t.source")))
        e = F.least(F.lit(cap), F.exp(F.least(F.lit(top), F.col("theta") * F.col("size"))))
        words = F.sum(F.col("n") * F.col("size") * e)
        slope = F.sum(F.when(e < cap, F.col("n") * F.col("size") * F.col("size") * e).otherwise(0.0))
        x = x.groupBy("t.source", "target", "lo", "hi", "theta").agg(words.alias("f"), slope.alias("df"))
        x = x.withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("theta")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") < F.col("target"), F.col("hi")).otherwise(F.col("theta")))
        step = F.col("theta") - F.when(F.col("df") > 0, F.col("f") / F.col("df") * F.log(F.col("f") / F.col("target")))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        gap = F.abs(F.col("f") / F.col("target") - 1)
        x = x.select("source", "target", "lo", "hi", F.when(gap <= tolerance, F.col("theta")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2).alias("theta"), gap.alias("gap"))
        now = stored(x, "mix-theta")
        if (now.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"rates didn't meet their targets within {iterations} steps")
    # sums in another order differ by less than this rounding, so reruns round alike
    return now.select("source", F.round("theta", 13).alias("theta"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (= copies * size) for every row of docs.

    Rounding is systematic: the documents of a source stand in order of size, and each takes the whole numbers that the running sum of rates passes, so
    that rounding errors of neighbours of about equal size cancel. Then a few documents, at most one size for each power of two, gain or lose copies to
    bring the source within about its smallest document of the target. Ranks are taken in salted groups: no task holds a whole source.

    Null or empty texts have size 0, rate 1 and one copy of nothing; a null source is a source of its own, the last; repeated rows count each; an empty
    table gives an empty result. Documents of equal source and size get their copies in order of hash(id), so reruns agree.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    base = stored(base, "mix-sizes")
    salted = base.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    hist = stored(salted.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-hist")
    targets = stored(source_targets(hist, weights, max_copies), "mix-targets")
    theta = tilt(hist, targets, max_copies)
    cap, top = float(max_copies), math.log(max_copies)
    t = targets.alias("a").join(theta.alias("b"), _same(F.col("a.source"), F.col("b.source")), "left").select("a.source", "source_size", "target", "theta")
    t = stored(t, "mix-tilted")
    sources = t.count()
    h = hist.alias("h").join(_beside(t, sources).alias("t"), _same(F.col("h.source"), F.col("t.source"))).select("h.source", "size", "n", "source_size", "target", "theta")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("theta").isNull(), F.when(F.col("target") > 0, cap).otherwise(1.0)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(top), F.col("theta") * F.col("size")))))
    h = h.withColumn("rate", rate).withColumn("part", F.floor(F.log2(F.col("size") + 1.0)).cast("int"))
    # running sums over a source in two levels: powers of two of the size, then sizes
    parts = h.groupBy("source", "part").agg(F.sum(F.col("n") * F.col("rate")).alias("mass"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.coalesce(F.sum("mass").over(before), F.lit(0.0)).alias("base"))
    h = h.join(_beside(parts, sources), _same(F.col("source"), F.col("p_source")) & (F.col("part") == F.col("p_part"))).drop("p_source", "p_part")
    run = W.partitionBy("source", "part").orderBy("size")
    h = h.withColumn("to", F.col("base") + F.sum(F.col("n") * F.col("rate")).over(run))
    # 1e-7 keeps sums that are whole but for rounding on one side
    h = h.withColumn("from", F.col("to") - F.col("n") * F.col("rate"))
    whole = lambda x: F.floor(x + 0.5 + 1e-7).cast("long")
    h = h.withColumn("c", F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n") * max_copies, F.greatest(F.lit(0), whole(F.col("to")) - whole(F.col("from"))))))
    h = stored(h.select("source", "size", "n", "source_size", "target", "rate", "part", "c"), "mix-copies")
    # what is missing (or too much) of each source, taken up by one size of each part, large ones first
    lack = h.groupBy("source").agg((F.max("target") - F.sum(F.col("c") * F.col("size"))).alias("lack"))
    room = h.where("size > 0").alias("h").join(_beside(lack, sources).alias("l"), _same(F.col("h.source"), F.col("l.source"))).select("h.source", "part", "size", "lack", F.when(F.col("lack") > 0, F.col("n") * max_copies - F.col("c")).otherwise(F.col("c")).alias("room"))
    room = room.where((F.col("room") > 0) & (F.col("size") <= F.abs("lack") * 2)).groupBy("source", "part").agg(F.max(F.struct("size", "room")).alias("x"), F.first("lack").alias("lack"))
    small = room.groupBy("source").agg(F.max("lack").alias("lack"), F.sort_array(F.collect_list("x"), False).alias("xs"))  # at most 64 parts
    step = lambda acc, x: F.struct(
        (acc["left"] - F.least(x["room"].cast("double"), F.floor(acc["left"] / x["size"] + F.when(x["size"] == acc["last"], 0.5).otherwise(0.0)).cast("double")) * x["size"]).alias("left"),
        acc["last"].alias("last"),
        F.concat(acc["out"], F.array(F.struct(x["size"].alias("size"), F.least(x["room"].cast("double"), F.floor(acc["left"] / x["size"] + F.when(x["size"] == acc["last"], 0.5).otherwise(0.0)).cast("double")).cast("long").alias("k")))).alias("out"),
    )
    start = F.struct(F.abs("lack").alias("left"), F.element_at("xs", -1)["size"].alias("last"), F.expr("cast(array() as array<struct<size:bigint,k:bigint>>)").alias("out"))
    fix = small.select("source", F.signum("lack").cast("long").alias("sign"), F.explode(F.aggregate("xs", start, step)["out"]).alias("o")).select(F.col("source").alias("f_source"), F.col("o.size").alias("f_size"), (F.col("sign") * F.col("o.k")).alias("k"))
    h = h.join(_beside(fix, sources), _same(F.col("source"), F.col("f_source")) & (F.col("size") == F.col("f_size")), "left")
    h = stored(h.select("source", "size", "n", "source_size", "target", "rate", (F.col("c") + F.coalesce("k", F.lit(0))).alias("c")), "mix-fixed")
    # documents of one source and size take c copies among n: the first c % n by rank one more; ranks from salted counts
    prior = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offset = salted.withColumn("offset", F.coalesce(F.sum("n").over(prior), F.lit(0))).drop("n")
    plan = offset.alias("o").join(h.alias("h"), _same(F.col("o.source"), F.col("h.source")) & (F.col("o.size") == F.col("h.size"))).select("h.source", "h.size", "o.salt", "o.offset", "h.n", "h.c", "h.source_size", "h.target", "h.rate")
    rank = W.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ranked = base.withColumn("rank", F.row_number().over(rank)).alias("b").join(plan.alias("p"), _same(F.col("b.source"), F.col("p.source")) & (F.col("b.size") == F.col("p.size")) & (F.col("b.salt") == F.col("p.salt")))
    copies = F.expr("c div n") + F.when(F.col("rank") + F.col("offset") <= F.col("c") % F.col("n"), 1).otherwise(0)
    return ranked.select("doc_id", "b.source", "b.size", "source_size", "target", "rate", copies.cast("long").alias("copies"), (copies * F.col("b.size")).cast("long").alias("taken"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (and rate, copies) of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
