"""Queries over filters, votes, reports and scores that build on the catalogue's, each with its oracle in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g
from ..operators import pairs, points as P, scoring, sync
from ..operators.tables import sized, stored
from ..streaming import robot
from . import catalog as c, domain as d
from .registry import query, rounded

_M, _PTS, _POSES, _ROBOT = map(d.sql_for_duckdb, (d.MESSAGES, d.POINTS, d.POSES, d.ROBOT))
REACH, BOX = 0.325, (-2.0, 2.0, -2.0, 2.0, -1.0, 1.0)


def _turned(u: tuple[str, str, str], w: str, v: tuple[str, str, str]) -> tuple[str, ...]:
    """SQL of v turned by the quaternion (u, w)."""
    cross = lambda a, b: tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))
    once = cross(u, v)
    return tuple(f"({v[i]} + 2 * ({w}) * {once[i]} + 2 * {cross(u, once)[i]})" for i in range(3))


def _points(spark, sf_dir) -> DataFrame:
    return d.view(spark, sf_dir, d.POINTS)


@query(f"SELECT env, count(*) n, round(sum(x), 4) total FROM ({_PTS}) p WHERE sqrt(x * x + y * y + z * z) <= 9 GROUP BY 1")
def range_filtered(spark, sf_dir):
    return P.range_filter(_points(spark, sf_dir), 9.0).groupBy("env").agg(F.count("*").alias("n"), rounded(F.sum("x"), 4).alias("total"))


@query(f"SELECT env, count(*) n FROM ({_PTS}) p WHERE frame_id >= 10 AND frame_id < 1010 AND (frame_id - 10) % 3 = 0 GROUP BY 1")
def selected_frames(spark, sf_dir):
    return P.select_frames(_points(spark, sf_dir), 10, 1000, 3).groupBy("env").agg(F.count("*").alias("n"))


def _posed(spark, sf_dir) -> DataFrame:
    """Points with a pose of their env, in turn over all of its poses."""
    q = stored(d.view(spark, sf_dir, d.POSES).select("env", F.col("frame_id").alias("pose_id"), F.struct(*g.POSE).alias("pose")), "scan-poses")
    n = stored(q.groupBy("env").agg(F.count("*").alias("n")), "pose-counts")
    return _points(spark, sf_dir).join(sized(n), "env").withColumn("pose_id", F.col("frame_id") % F.col("n")).join(sized(q), ["env", "pose_id"])


_POSED = f"WITH q AS ({_POSES}), j AS (SELECT p.env, p.frame_id, p.x, p.y, p.z, q.x px, q.y py, q.z pz, qx, qy, qz, qw FROM ({_PTS}) p JOIN (SELECT *, count(*) OVER (PARTITION BY env) n FROM q) q ON q.env = p.env AND q.frame_id = p.frame_id % q.n)"
_OWN = _turned(("-qx", "-qy", "-qz"), "qw", ("(x - px)", "(y - py)", "(z - pz)"))
_WORLD = _turned(("qx", "qy", "qz"), "qw", ("x", "y", "z"))


@query(_POSED + f" SELECT env, count(*) n, round(sum(z), 4) total FROM j WHERE NOT ({' AND '.join(f'{v} BETWEEN {lo} AND {hi}' for v, lo, hi in zip(_OWN, BOX[::2], BOX[1::2]))}) GROUP BY 1")
def self_filtered(spark, sf_dir):
    kept = P.filter_self_points(_posed(spark, sf_dir), F.col("pose"), BOX)
    return kept.groupBy("env").agg(F.count("*").alias("n"), rounded(F.sum("z"), 4).alias("total"))


_INSIDE = " AND ".join(f"{v} BETWEEN {lo} AND {hi}" for v, lo, hi in zip(_OWN, BOX[::2], BOX[1::2]))


@query(_POSED + f""", k AS (SELECT env, frame_id, count(*) FILTER (NOT ({_INSIDE})) kept, count(*) FILTER ({_INSIDE}) removed FROM j GROUP BY 1, 2)
SELECT env, count(*) scans, min(kept) min_cloud_points, max(kept) max_cloud_points, CAST(sum(removed) AS BIGINT) removed_self_points, round(avg(removed), 6) mean_removed, max(removed) max_removed FROM k GROUP BY 1""")
def scan_stats(spark, sf_dir):
    return P.scan_stats(_posed(spark, sf_dir), F.col("pose"), BOX).withColumn("mean_removed", rounded("mean_removed"))


@query(c._SYNC + " SELECT bag, count(*) cloud, count(depth_idx) depth, count(color_idx) color, count(*) FILTER (color_idx IS NULL) black_color FROM s WHERE drop_reason IS NULL GROUP BY 1")
def saved_counts(spark, sf_dir):
    return sync.saved_counts(c._synced(spark, sf_dir))


_MOUNT = (0.1, -0.2, 0.3)
_ON = _turned(("qx", "qy", "qz"), "qw", tuple(f"({v}::DOUBLE)" for v in _MOUNT))


@query(f"""WITH q AS (SELECT *, CAST(env AS BIGINT) % 2 = 0 base, sin(0.25) s, cos(0.25) c FROM ({_POSES}) q)
SELECT env, frame_id, round(CASE WHEN base THEN x ELSE x + {_ON[0]} END, 6) + 0.0 x, round(CASE WHEN base THEN y ELSE y + {_ON[1]} END, 6) + 0.0 y, round(CASE WHEN base THEN z ELSE z + {_ON[2]} END, 6) + 0.0 z,
 round(CASE WHEN base THEN qx ELSE qx * c + qy * s END, 6) + 0.0 qx, round(CASE WHEN base THEN qy ELSE qy * c - qx * s END, 6) + 0.0 qy, round(CASE WHEN base THEN qz ELSE qw * s + qz * c END, 6) + 0.0 qz, round(CASE WHEN base THEN qw ELSE qw * c - qz * s END, 6) + 0.0 qw FROM q""")
def base_poses(spark, sf_dir):
    """Poses of a turned camera for odd envs, of the base for even ones."""
    q = d.view(spark, sf_dir, d.POSES)
    zero = F.lit(0.0)
    mount = g.pose(tuple(map(F.lit, _MOUNT)), (zero, zero, F.sin(F.lit(0.25)), F.cos(F.lit(0.25))))
    frame = F.when(F.col("env").cast("bigint") % 2 == 0, "base").otherwise("camera")
    p = q.select("env", "frame_id", g.to_base_frame(F.struct(*g.POSE), mount, frame, "base").alias("p"))
    return p.select("env", "frame_id", *(rounded(f"p.{n}").alias(n) for n in g.POSE))


@query(_POSED + f" SELECT env, round(avg({_WORLD[0]} + px), 6) + 0.0 x, round(avg({_WORLD[1]} + py), 6) + 0.0 y, round(avg({_WORLD[2]} + pz), 6) + 0.0 z FROM j GROUP BY 1")
def scans_in_world(spark, sf_dir):
    return P.to_world(_posed(spark, sf_dir), "base_to_world", F.col("pose")).groupBy("env").agg(*(rounded(F.avg(a)).alias(a) for a in "xyz"))


@query(f"SELECT env, round(avg(z), 6) + 0.0 mean_z FROM ({_POSES}) q GROUP BY 1")
def mean_height(spark, sf_dir):
    return P.mean_height(d.view(spark, sf_dir, d.POSES)).withColumn("mean_z", rounded("mean_z"))


@query(f"""WITH u AS (SELECT env, x, y FROM ({_PTS}) p UNION ALL SELECT env, x, y FROM ({_POSES}) q), b AS (SELECT env, min(x) - 1 lx, max(x) + 1 hx, min(y) - 1 ly, max(y) + 1 hy FROM u GROUP BY 1),
n AS (SELECT *, greatest(CAST(ceil((hx - lx) / 2.5 / 10) * 10 AS INTEGER), 10) num_x, greatest(CAST(ceil((hy - ly) / 2.5 / 10) * 10 AS INTEGER), 10) num_y FROM b)
SELECT env, num_x, num_y, round((lx + hx) / 2 - num_x / 2 * 2.5, 6) + 0.0 start_x, round((ly + hy) / 2 - num_y / 2 * 2.5, 6) + 0.0 start_y FROM n""")
def raycast_bounds(spark, sf_dir):
    b = P.raycast_bounds(_points(spark, sf_dir), d.view(spark, sf_dir, d.POSES), 2.5, 1.0)
    return b.select("env", "num_x", "num_y", rounded("start_x").alias("start_x"), rounded("start_y").alias("start_y"))


@query(c._VOTES + " SELECT env, ix, iy, free_votes FROM f")
def free_votes(spark, sf_dir):
    free = P.classify_terrain(_points(spark, sf_dir), F.lit(0.0), c.GROUND, c.HEIGHT).where("terrain = 'free'")
    return P.free_votes(P.to_cells(free, c._params(spark, sf_dir)).where("inside"))


@query(c._VOTES + """, k AS (SELECT *, hit_votes >= 2 AND ratio >= 0.5 AND NOT (free_votes >= 2 AND ratio <= 0.6) occupied FROM w)
SELECT env, count(*) FILTER (occupied) occupied, count(*) FILTER (free_votes >= 2) free, max(hit_votes) max_hits, max(free_votes) max_free, CAST(sum(hit_votes) AS BIGINT) hits FROM k GROUP BY 1""")
def raycast_stats(spark, sf_dir):
    return P.raycast_stats(c._votes(spark, sf_dir)[0]).select("env", "occupied", "free", "max_hits", "max_free", "hits")


@query(c._VOTES + """, off AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE sqrt(i * i + j * j) <= 2), near AS (SELECT DISTINCT env, ix + i ix, iy + j iy FROM f, off)
SELECT env, ix, iy FROM h WHERE env NOT IN (SELECT env FROM f) UNION ALL SELECT h.env, h.ix, h.iy FROM h SEMI JOIN near n ON n.env = h.env AND n.ix = h.ix AND n.iy = h.iy""")
def thinned(spark, sf_dir):
    votes, _ = c._votes(spark, sf_dir)
    cells = votes.select("env", "ix", "iy", "hit_votes", "free_votes")
    return P.thin_to_surface(cells.where("hit_votes > 0").select("env", "ix", "iy"), cells.where("free_votes > 0").select("env", "ix", "iy"), 0.1, c.VOXEL)


@query(c._BOUNDS + f""", q AS ({_POSES}), k AS (SELECT DISTINCT q.env, CAST(round_even((x - start_x) / {c.VOXEL}, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / {c.VOXEL}, 0) AS INTEGER) iy FROM q JOIN p USING (env)),
off AS (SELECT i, j FROM range(-7, 8) a(i), range(-7, 8) b(j) WHERE sqrt(i * i + j * j) <= {REACH / c.VOXEL})
SELECT DISTINCT k.env, CAST(ix + i AS INTEGER) ix, CAST(iy + j AS INTEGER) iy FROM k CROSS JOIN off JOIN p USING (env) WHERE ix + i >= 0 AND ix + i < num_x AND iy + j >= 0 AND iy + j < num_y""")
def corridor_cells(spark, sf_dir):
    return P.corridor(d.view(spark, sf_dir, d.POSES).select("env", "frame_id", "x", "y", "z"), c._params(spark, sf_dir), REACH, c.VOXEL)


@query(f"""WITH p AS ({_PTS}), r AS (SELECT *, row_number() OVER (PARTITION BY env, frame_id ORDER BY x, y, z) - 1 k, count(*) OVER (PARTITION BY env, frame_id) n, dense_rank() OVER (PARTITION BY env ORDER BY frame_id) f FROM p)
SELECT env, frame_id, x, y, z FROM r WHERE k % (n // 2 + 1) = 0 AND f <= 20""")
def thinned_cloud(spark, sf_dir):
    return P.sample_cloud(_points(spark, sf_dir), 2, 20)


@query(f"""WITH m AS (SELECT bag || '/' || CAST(stamp // 86400000000 AS VARCHAR) bag, topic FROM ({_M}) a), h AS (SELECT bag, count(*) FILTER (topic = 'cloud') n FROM m GROUP BY 1),
t AS (SELECT bag, CASE WHEN topic = CASE WHEN n > 0 THEN 'cloud' ELSE 'fallback' END THEN 'cloud' ELSE topic END topic FROM m JOIN h USING (bag)) SELECT bag, topic, count(*) n FROM t WHERE topic <> 'fallback' GROUP BY 1, 2""")
def picked_topics(spark, sf_dir):
    """Bags are a day's, so that some have no cloud."""
    m = c._messages(spark, sf_dir).withColumn("bag", F.expr("bag || '/' || cast(stamp div 86400000000 as string)"))
    return sync.pick_topic(m, "cloud", "fallback").groupBy("bag", "topic").agg(F.count("*").alias("n"))


@query(f"WITH m AS ({_M}), a AS (SELECT DISTINCT topic FROM m), q AS (SELECT topic FROM a WHERE topic <> 'fallback' UNION SELECT event_type FROM events) SELECT topic, topic IN (SELECT topic FROM a) present FROM q")
def topic_coverage(spark, sf_dir):
    m = c._messages(spark, sf_dir).select("topic")
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("topic"))
    return sync.topic_coverage(m.where("topic <> 'fallback'").unionByName(kinds).distinct(), m)


@query(c._SYNC + """, r AS (SELECT x.bag, coalesce(n, 0) n FROM (SELECT DISTINCT bag FROM m) x LEFT JOIN (SELECT bag, count(*) n FROM s WHERE drop_reason IS NULL GROUP BY 1) y USING (bag)), f AS (SELECT min(bag) FILTER (n = 0) stop FROM r)
SELECT count(*) FILTER (n > 0) successes, count(*) FILTER (n = 0) failures, CAST(sum(n) AS BIGINT) matches FROM r, f WHERE stop IS NULL OR bag <= stop""")
def extract_summary(spark, sf_dir):
    return sync.extract_summary(sync.bag_report(c._messages(spark, sf_dir), c._synced(spark, sf_dir)), fail_fast=True)


@query(c._SYNC + " SELECT s.bag, cloud_idx, odom_idx, m.stamp odom_stamp FROM s JOIN m ON m.bag = s.bag AND m.topic = 'odom' AND m.msg_idx = odom_idx WHERE drop_reason IS NULL")
def materialised(spark, sf_dir):
    s = c._synced(spark, sf_dir).where("drop_reason is null").select("bag", "cloud_idx", "odom_idx")
    return sync.materialise(s, c._messages(spark, sf_dir), "odom")


@query(c._SYNC + f" SELECT bag, cloud_idx FROM s WHERE drop_reason IS NULL AND greatest(stamp, stamp + odom_dt, stamp + depth_dt) - least(stamp, stamp + odom_dt, stamp + depth_dt) <= {c.SLOPS['odom']}")
def span_gated(spark, sf_dir):
    s = c._synced(spark, sf_dir).where("drop_reason is null")
    s = s.withColumn("odom_at", F.col("stamp") + F.col("odom_dt")).withColumn("depth_at", F.col("stamp") + F.col("depth_dt"))
    return robot.span_gate(s, ("stamp", "odom_at", "depth_at"), c.SLOPS["odom"]).select("bag", "cloud_idx")


@query(f"""WITH q AS ({_POSES}), a AS (SELECT env, frame_id, row_number() OVER (PARTITION BY env ORDER BY frame_id) - 1 position FROM (SELECT DISTINCT env, frame_id FROM ({_PTS}) p) x), b AS (SELECT env, frame_id pose_id, row_number() OVER (PARTITION BY env ORDER BY frame_id) - 1 position FROM q)
SELECT env, CAST(position AS INTEGER) position, frame_id, pose_id FROM a JOIN b USING (env, position)""")
def paired_frames(spark, sf_dir):
    """Scans and poses of an env, which has more of the former."""
    return pairs.pair_by_position(_points(spark, sf_dir).select("env", "frame_id").distinct(), d.view(spark, sf_dir, d.POSES).select("env", "frame_id"))


@query(f"WITH q AS ({_POSES}) SELECT env, frame_id FROM q WHERE env = (SELECT env FROM (SELECT DISTINCT env FROM q) e ORDER BY env LIMIT 1 OFFSET 3)")
def test_env_frames(spark, sf_dir):
    q = d.view(spark, sf_dir, d.POSES).select("env", "frame_id")
    envs = q.select("env").distinct()
    return pairs.select_envs(q, envs.withColumn("position", F.row_number().over(W.orderBy("env")) - 1), 3)


_NAME = "CASE label % 3 WHEN 0 THEN 'anymal_' WHEN 1 THEN CASE WHEN label % 2 = 0 THEN 'indoor_Tilt_' ELSE 'indoor_tilt_' END ELSE 'plain_' END || label"


@query(f"SELECT env, contains(env, 'anymal') robot_frame, CASE WHEN contains(env, 'anymal') THEN 0.4e0 ELSE 0e0 END \"offset\", CASE WHEN contains(env, 'anymal') OR contains(env, 'tilt') THEN 15e0 ELSE 0e0 END tilt FROM (SELECT DISTINCT {_NAME} env FROM embeddings) e")
def env_profiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(_NAME).alias("env")).distinct()
    return e.select("env", pairs.env_profile(F.col("env"), 0.4, 15.0).alias("p")).select("env", "p.*")


def _log(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"))


@query("SELECT run, epoch, val_loss, best, coalesce(val_loss < best, TRUE) saved FROM (SELECT CAST(user_id AS VARCHAR) run, event_id epoch, value val_loss, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best FROM events) e")
def best_so_far(spark, sf_dir):
    return scoring.best_so_far(_log(spark, sf_dir))


@query("""WITH RECURSIVE l AS (SELECT CAST(user_id AS VARCHAR) run, event_id epoch, value x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events),
f AS (SELECT DISTINCT run, CAST(NULL AS BIGINT) epoch, CAST(0 AS BIGINT) n, CAST('inf' AS DOUBLE) best, 0 bad, 0.01e0 lr, false "stop" FROM l
 UNION ALL SELECT run, epoch, n, best, CASE WHEN bad > 4 THEN 0 ELSE bad END, CASE WHEN bad > 4 AND lr - greatest(lr * 0.5e0, 1e-6) > 1e-8 THEN greatest(lr * 0.5e0, 1e-6) ELSE lr END, "stop" OR bad > 4 AND lr - greatest(lr * 0.5e0, 1e-6) <= 1e-8
 FROM (SELECT l.run, l.epoch, l.n, CASE WHEN x < best * 0.9999e0 THEN x ELSE best END best, CAST(CASE WHEN x < best * 0.9999e0 THEN 0 ELSE bad + 1 END AS INTEGER) bad, lr, "stop" FROM f JOIN l ON l.run = f.run AND l.n = f.n + 1) y)
SELECT run, epoch, lr, "stop" FROM f WHERE n > 0""")
def replayed_rates(spark, sf_dir):
    """Learning rate and stop of each epoch: a fold in order."""
    return scoring.replay_schedule(_log(spark, sf_dir), 0.01)


@query(c._PAIRS + f""", k AS (SELECT env, ahead, frame_id, dx + w * tx + uy * tz - uz * ty gx, dy + w * ty + uz * tx - ux * tz gy FROM t)
SELECT env, ahead, frame_id, coalesce(CASE WHEN sqrt(gx * gx + gy * gy) > 0.5 THEN gx / sqrt(gx * gx + gy * gy) > 0.9 END, TRUE) forward FROM k""")
def forward_plans(spark, sf_dir):
    p, wp = c._trajectories(spark, sf_dir)
    return p.select("traj_id", "env", "ahead", "frame_id").join(scoring.is_forward(wp, 0.5, 0.1), "traj_id").drop("traj_id")


@query(f"WITH r AS (SELECT fear > 0.5 fear, (event_id % 101) / 100e0 p FROM ({_ROBOT}) a) SELECT round(avg(-CASE WHEN x > 0 THEN greatest(ln(x), -100) ELSE -100 END), 6) loss FROM (SELECT CASE WHEN fear THEN p ELSE 1 - p END x FROM r) y")
def fear_loss(spark, sf_dir):
    r = d.view(spark, sf_dir, d.ROBOT).select((F.col("fear") > 0.5).alias("fear"), ((F.col("event_id") % 101) / 100.0).alias("p"))
    return scoring.fear_loss(r).withColumn("loss", F.round("loss", 6))


@query("""WITH b AS (SELECT user_id % 10 env, event_id % 20 batch, avg(value) loss FROM events GROUP BY 1, 2), e AS (SELECT env, avg(loss) loss FROM b GROUP BY 1)
SELECT round((SELECT avg(loss) FROM b), 6) micro, round((SELECT avg(loss) FROM e), 6) macro""")
def score_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = scoring.score_summary(e.select((F.col("user_id") % 10).alias("env"), (F.col("event_id") % 20).alias("batch"), F.col("value").alias("total")))
    return s.select(*(F.round(n, 6).alias(n) for n in ("micro", "macro")))


@query(f"SELECT ts // 86400000000 AS \"day\", count(*) n, round(avg(fear * 100), 6) mean_ms, round(max(fear * 100), 6) max_ms FROM ({_ROBOT}) r GROUP BY 1")
def latency(spark, sf_dir):
    r = d.view(spark, sf_dir, d.ROBOT).select(F.timestamp_micros("ts").alias("ts"), (F.col("fear") * 100).alias("ms"))
    day = F.expr("unix_micros(w.start) div 86400000000").alias("day")
    return robot.latency(r, "1 day").select(day, "n", F.round("mean_ms", 6).alias("mean_ms"), F.round("max_ms", 6).alias("max_ms"))


@query(f"""WITH r AS (SELECT event_id, fear, event_id % 4 <> 0 active, fear > 0.5 reacting FROM ({_ROBOT}) a)
SELECT event_id, CASE WHEN NOT active THEN 0 WHEN reacting THEN 1 ELSE 3 END n_main, CASE WHEN active AND reacting THEN 3 ELSE 0 END n_fear, CASE WHEN active THEN fear END "first" FROM r""")
def published_paths(spark, sf_dir):
    r = d.view(spark, sf_dir, d.ROBOT)
    r = r.select("event_id", F.array("fear", F.col("fear") + 1, F.col("fear") + 2).alias("path"), (F.col("event_id") % 4 != 0).alias("active"), (F.col("fear") > 0.5).alias("reacting"))
    out = robot.published_paths(r)
    return out.select("event_id", F.size("main").alias("n_main"), F.size("fear_path").alias("n_fear"), F.try_element_at("main", F.lit(1)).alias("first"))


_ANGLE = "(event_id % 13) * 0.3e0"
_AT = _turned(("0", "0", "-sin(a / 2)"), "cos(a / 2)", ("(gx - x)", "(gy - y)", "0.5e0"))


@query(f"""WITH r AS ({_ROBOT}), gl AS (SELECT robot_id, event_id, ts, fear gx, (event_id % 9) / 2e0 gy FROM r WHERE kind = 'signup'), tr AS (SELECT robot_id, event_id t_id, ts t_ts, fear * 5 x, (event_id % 7) * 1e0 y, {_ANGLE} a FROM r WHERE kind = 'click'),
j AS (SELECT *, row_number() OVER (PARTITION BY gl.robot_id, gl.event_id ORDER BY t_ts DESC, t_id DESC) rn FROM gl JOIN tr ON tr.robot_id = gl.robot_id AND t_ts <= ts)
SELECT robot_id, event_id, round({_AT[0]}, 6) + 0.0 gx, round({_AT[1]}, 6) + 0.0 gy, round({_AT[2]}, 6) + 0.0 gz FROM j WHERE rn = 1""")
def goals_in_robot_frame(spark, sf_dir):
    r = d.view(spark, sf_dir, d.ROBOT)
    goals = r.where("kind = 'signup'").select("robot_id", "event_id", "ts", F.col("fear").alias("gx"), ((F.col("event_id") % 9) / 2.0).alias("gy"), F.lit(0.5).alias("gz"))
    a = (F.col("event_id") % 13) * 0.3
    zero = F.lit(0.0)
    pose = g.pose((F.col("fear") * 5, (F.col("event_id") % 7).cast("double"), zero), (zero, zero, F.sin(a / 2), F.cos(a / 2)))
    moves = r.where("kind = 'click'").select("robot_id", "event_id", "ts", pose.alias("pose"))
    return sync.goal_to_robot_frame(goals, moves).select("robot_id", "event_id", *(rounded(f"g{n}").alias(f"g{n}") for n in "xyz"))
