"""Nearest-timestamp synchronisation of recorded topics, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .folds import numbered
from .tables import sized, stored

from ..functions import geometry as g

OTHERS = ("odom", "depth", "color")


def pick_topic(messages: DataFrame, primary: str, fallback: str, name: str = "cloud") -> DataFrame:
    """Messages with a bag's primary topic renamed to name, or its fallback where the primary has no message; the one not chosen is dropped."""
    has = messages.groupBy("bag").agg(F.count_if(F.col("topic") == primary).alias("n_primary"))
    m = messages.join(has, "bag")
    chosen = F.when(F.col("n_primary") > 0, primary).otherwise(fallback)
    return m.withColumn("topic", F.when(F.col("topic") == chosen, F.lit(name)).otherwise(F.col("topic"))).where(~F.col("topic").isin(primary, fallback) | (F.col("topic") == name)).drop("n_primary")


def nearest_sync(messages: DataFrame, slops: dict[str, int], stretch: int | None = None) -> DataFrame:
    """Each cloud message with its nearest odom, depth and color message: bag, cloud_idx, stamp, {topic}_idx, {topic}_dt, drop_reason.

    messages: bag, topic, msg_idx, stamp (whole units, as slops). The nearest is the later of two equally far; of equal stamps at or after the cloud's the
    first message counts, of those before it the last. Gates in order: odom missing, odom slop, depth missing, depth slop; a distance equal to the slop
    passes. color is optional: null outside its slop. One sort by (bag, stretch, stamp) serves all topics: bags are cut into stretches of time (of 1,000 times
    the widest slop by default), so one long bag is not one task, and what lies nearest before and after a stretch is carried to it from the stretches' ends.
    """
    m = messages.where(F.col("topic").isin("cloud", *OTHERS)).where("bag is not null and stamp is not null").select("bag", "topic", "msg_idx", "stamp")
    m = m.withColumn("stretch", F.floor(F.col("stamp") / (stretch or 1000 * max(1, *slops.values()))))
    order = W.partitionBy("bag", "stretch").orderBy("stamp", F.when(F.col("topic") == "cloud", 0).otherwise(1), "msg_idx")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    own = lambda t: F.when(F.col("topic") == t, F.struct("stamp", "msg_idx"))
    ends = m.groupBy("bag", "stretch").agg(*(f(own(t)).alias(f"{t}_{n}") for t in OTHERS for f, n in ((F.max, "last"), (F.min, "first"))))
    along = W.partitionBy("bag").orderBy("stretch")
    earlier, later = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(1, W.unboundedFollowing)
    carried = [c for t in OTHERS for c in (F.last(f"{t}_last", ignorenulls=True).over(earlier).alias(f"{t}_back"), F.first(f"{t}_first", ignorenulls=True).over(later).alias(f"{t}_fore"))]
    ends = ends.select("bag", "stretch", *carried)
    for t in OTHERS:
        m = m.withColumn(f"{t}_b", F.last(own(t), ignorenulls=True).over(before)).withColumn(f"{t}_f", F.first(own(t), ignorenulls=True).over(after))
    m = m.where("topic = 'cloud'").join(ends, ["bag", "stretch"])
    for t in OTHERS:
        m = m.withColumn(f"{t}_b", F.coalesce(f"{t}_b", f"{t}_back")).withColumn(f"{t}_f", F.coalesce(f"{t}_f", f"{t}_fore"))
    out = m
    for t in OTHERS:
        back, fore = F.col("stamp") - F.col(f"{t}_b.stamp"), F.col(f"{t}_f.stamp") - F.col("stamp")
        near = F.when(F.coalesce(fore <= back, fore.isNotNull()), F.col(f"{t}_f")).otherwise(F.col(f"{t}_b"))
        out = out.withColumn(f"{t}_n", near).withColumn(f"{t}_dt", F.col(f"{t}_n.stamp") - F.col("stamp"))
    far = lambda t: F.abs(F.col(f"{t}_dt")) > slops[t]
    reason = F.when(F.col("odom_dt").isNull(), "odom_missing").when(far("odom"), "odom_slop").when(F.col("depth_dt").isNull(), "depth_missing").when(far("depth"), "depth_slop")
    idx = [F.when(~far(t), F.col(f"{t}_n.msg_idx")).alias(f"{t}_idx") if t == "color" else F.col(f"{t}_n.msg_idx").alias(f"{t}_idx") for t in OTHERS]
    dts = [F.when(~far(t), F.col(f"{t}_dt")).alias(f"{t}_dt") if t == "color" else F.col(f"{t}_dt") for t in OTHERS]
    return out.select("bag", F.col("msg_idx").alias("cloud_idx"), "stamp", *idx, *dts, reason.alias("drop_reason"))


def take_samples(synced: DataFrame, every: int = 1, max_frames: int | None = None) -> DataFrame:
    """Accepted rows numbered in cloud order (sample_id from 0), every k-th of them, at most max(1, max_frames) of a bag; dropped rows beyond the last kept one go, too."""
    if every < 1:
        raise ValueError("every must be at least 1")
    order = W.partitionBy("bag").orderBy("stamp", "cloud_idx")
    s = synced.withColumn("seq", F.row_number().over(order)).withColumn("accepted", F.col("drop_reason").isNull())
    n = F.sum(F.col("accepted").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("sample_id", F.when(F.col("accepted") & ((n - 1) % every == 0), F.expr("0")).cast("long") + F.floor((n - 1) / every))
    if max_frames is not None:
        top = max(1, max_frames) - 1
        last = F.max(F.when(F.col("sample_id") == top, F.col("seq"))).over(W.partitionBy("bag"))
        s = s.withColumn("last", last).where(F.col("last").isNull() | (F.col("seq") <= F.col("last"))).drop("last")
    return s.where(~F.col("accepted") | F.col("sample_id").isNotNull()).drop("seq", "accepted")


def order_statistic(values: Column, p: float) -> Column:
    """The element at round_half_even((n - 1) p / 100) of a sorted array; null if it is empty."""
    return F.when(F.size(values) > 0, F.element_at(values, (F.rint((F.size(values) - 1) * (p / 100)) + 1).cast("int")))


def dt_summary(matches: DataFrame, dt: str, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """count, mean, p50, p95, p99, max of |dt|. Ranks come from a window over the key's sorted values, not from one array."""
    d = matches.where(F.col(dt).isNotNull()).select(*keys, F.abs(F.col(dt)).alias("v"))
    w = W.partitionBy(*keys)
    d = d.withColumn("rank", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count("*").over(w))
    pick = lambda p: F.max(F.when(F.col("rank") == F.rint((F.col("n") - 1) * (p / 100)) + 1, F.col("v"))).alias(f"p{p}")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), pick(50), pick(95), pick(99), F.max("v").alias("max"))


def bag_report(messages: DataFrame, synced: DataFrame) -> DataFrame:
    """A row for each bag: message counts by topic, drops by reason, matches, success."""
    topics = messages.groupBy("bag").agg(*(F.count_if(F.col("topic") == t).alias(f"n_{t}") for t in ("cloud", *OTHERS)))
    reasons = ("odom_missing", "odom_slop", "depth_missing", "depth_slop")
    drops = synced.groupBy("bag").agg(F.count_if(F.col("drop_reason").isNull()).alias("matches"), F.count_if(F.col("drop_reason").isNull() & F.col("color_idx").isNotNull()).alias("with_color"), *(F.count_if(F.col("drop_reason") == r).alias(r) for r in reasons))
    out = topics.join(drops, "bag", "left").na.fill(0)
    return out.withColumn("success", F.col("matches") > 0)


def sample_report(synced: DataFrame, every: int = 1, max_frames: int | None = None) -> DataFrame:
    """bag, accepted, taken, stride_drops, error: what take_samples leaves of each bag. Rows after the last sample that a cap allows are in no count, so accepted
    are those up to it; stride_drops are accepted rows between the samples; error says why a bag has none."""
    n = synced.groupBy("bag").agg(F.count_if(F.col("drop_reason").isNull()).alias("all"), F.mode("drop_reason", True).alias("why"))
    whole = F.ceil(F.col("all") / every)
    cap = F.lit(None).cast("long") if max_frames is None else F.lit(max(1, max_frames))
    taken = F.least(whole, cap)
    seen = F.when(whole >= cap, (cap - 1) * every + 1).otherwise(F.col("all"))
    out = n.select("bag", seen.cast("long").alias("accepted"), taken.cast("long").alias("taken"), "why")
    return out.select("bag", "accepted", "taken", (F.col("accepted") - F.col("taken")).alias("stride_drops"), F.when(F.col("taken") == 0, F.concat(F.lit("no sample: "), "why")).alias("error"))


def extract_summary(report: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Successes and failures over all bags; fail_fast: only bags up to and including the first that failed, by name."""
    r = report
    if fail_fast:
        first = report.where("not success").agg(F.min("bag").alias("stop"))
        r = report.crossJoin(F.broadcast(first)).where("stop is null or bag <= stop")  # one row
    return r.agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.sum("matches").alias("matches"))


def env_names(bags: DataFrame, prefix: str) -> DataFrame:
    """bag, env = prefix_%03d by the order of bags, numbered by ranges."""
    return numbered(bags.select("bag").distinct(), ["bag"]).select("bag", F.format_string(f"{prefix}_%03d", F.col("number")).alias("env"))


def materialise(matches: DataFrame, messages: DataFrame, topic: str) -> DataFrame:
    """Each match with its message of a topic; a message may serve several. Matches are counted: while a broadcast can hold them, payloads stay where they are."""
    m = messages.where(F.col("topic") == topic).drop("topic").withColumnRenamed("msg_idx", f"{topic}_idx").withColumnRenamed("stamp", f"{topic}_stamp")
    few = stored(matches, "sync-matches")
    out = m.join(sized(few), ["bag", f"{topic}_idx"])
    return out.select("bag", f"{topic}_idx", *(c for c in matches.columns if c not in ("bag", f"{topic}_idx")), *(c for c in m.columns if c not in ("bag", f"{topic}_idx")))


def topic_coverage(requested: DataFrame, available: DataFrame) -> DataFrame:
    """topic, present."""
    have = available.select("topic").distinct()
    return requested.join(have, "topic", "left_semi").select("topic", F.lit(True).alias("present")).unionByName(requested.join(have, "topic", "left_anti").select("topic", F.lit(False).alias("present")))


def goal_to_robot_frame(goals: DataFrame, transforms: DataFrame) -> DataFrame:
    """Goals (robot_id, event_id, ts, gx, gy, gz) in the robot's frame by the latest transform (robot_id, event_id, ts, pose) known at ts; a goal before any transform goes.

    One sort by (robot, ts): both sides are stacked, transforms before goals of one ts, and the last pose is carried on."""
    t = transforms.select("robot_id", "event_id", "ts", F.lit(0).alias("side"), "pose")
    both = goals.withColumn("side", F.lit(1)).unionByName(t, allowMissingColumns=True)
    w = W.partitionBy("robot_id").orderBy("ts", "side", "event_id").rowsBetween(W.unboundedPreceding, 0)
    known = both.withColumn("pose", F.last("pose", ignorenulls=True).over(w)).where("side = 1 and pose is not null").drop("side")
    v = g.untransform(F.col("pose"), (F.col("gx"), F.col("gy"), F.col("gz")))
    return known.withColumns(dict(zip(("gx", "gy", "gz"), v))).drop("pose")


def saved_counts(synced: DataFrame) -> DataFrame:
    """bag, cloud, depth, color, black_color: what is written for the samples (rows of nearest_sync that aren't dropped); those without colour get a black image."""
    n = synced.where("drop_reason is null").groupBy("bag")
    return n.agg(F.count("*").alias("cloud"), F.count("depth_idx").alias("depth"), F.count("color_idx").alias("color"), F.count_if(F.col("color_idx").isNull()).alias("black_color"))
