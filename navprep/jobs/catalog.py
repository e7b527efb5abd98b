"""Queries over the driver's tables, each with its oracle in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as g
from ..operators import grids, pairs, points as P, scoring, sync, vectors
from ..operators.tables import stored
from ..streaming import live_sync, robot
from . import domain as d
from . import frame_queries  # noqa: F401  (registers its queries)
from .registry import ORACLES, QUERIES, query, rounded as _r  # noqa: F401

HOUR = 3_600_000_000
SLOPS = {"odom": 12 * HOUR, "depth": 24 * HOUR, "color": 6 * HOUR}
GROUND, HEIGHT, VOXEL, CLEAR = 0.25, 0.43, 0.05, 1.0


def _grid(params: str = "p") -> str:
    """CTE g: every cell of every map."""
    return f"g AS (SELECT env, ix, CAST(unnest(range(num_y)) AS INTEGER) iy, num_x, num_y FROM (SELECT env, num_x, num_y, CAST(unnest(range(num_x)) AS INTEGER) ix FROM {params}) x)"


def _smoothed(name: str, source: str, sigma: float) -> str:
    """CTEs that end in name (env, ix, iy, v): v of source by a separable Gaussian with reflected edges, line by line as lists."""
    r = int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(-r, r + 1)]
    taps = "[" + ", ".join(f"{w / sum(k)!r}::DOUBLE" for w in k) + "]"

    def step(a: str, b: str, src: str) -> str:
        lines = f"SELECT env, i{b}, list(v ORDER BY i{a}) v FROM {src} GROUP BY 1, 2"
        padded = f"SELECT env, i{b}, len(v) n, list_reverse(v[1:{r}]) || v || list_reverse(v[len(v) - {r - 1}:len(v)]) v FROM ({lines}) x"
        return f"SELECT env, i{b}, CAST(unnest(range(n)) AS INTEGER) i{a}, unnest(list_transform(range(n), lambda i: list_inner_product(v[i + 1:i + {2 * r + 1}], {taps}))) v FROM ({padded}) y"

    return f"{name}_half AS MATERIALIZED ({step('x', 'y', source)}), {name} AS MATERIALIZED ({step('y', 'x', f'{name}_half')})"


def _distances(name: str, source: str, zero: str) -> str:
    """CTEs that end in name (env, ix, iy, d): cells of source to the nearest where zero holds, exactly: along x, then over y."""
    z = f"CASE WHEN {zero} THEN ix END"
    return f"""{name}_line AS MATERIALIZED (SELECT env, ix, iy, least(ix - max({z}) OVER (PARTITION BY env, iy ORDER BY ix), min({z}) OVER (PARTITION BY env, iy ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - ix) dx FROM {source}),
{name} AS MATERIALIZED (SELECT a.env, a.ix, a.iy, sqrt(min(b.dx * b.dx + (a.iy - b.iy) * (a.iy - b.iy))) d FROM {name}_line a LEFT JOIN (SELECT * FROM {name}_line WHERE dx IS NOT NULL) b ON b.env = a.env AND b.ix = a.ix AND (a.dx IS NULL OR abs(a.iy - b.iy) <= a.dx) GROUP BY 1, 2, 3)"""


_M, _PTS, _POSES, _ROBOT = map(d.sql_for_duckdb, (d.MESSAGES, d.POINTS, d.POSES, d.ROBOT))

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.view(spark, sf_dir, d.MESSAGES)


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.nearest_sync(_messages(spark, sf_dir), SLOPS)


def _near(topic: str) -> str:
    return f"""SELECT bag, cloud_idx, idx {topic}_n, dt {topic}_d FROM (SELECT c.bag, c.msg_idx cloud_idx, o.msg_idx idx, o.stamp - c.stamp dt,
 row_number() OVER (PARTITION BY c.bag, c.msg_idx ORDER BY abs(o.stamp - c.stamp), o.stamp DESC, CASE WHEN o.stamp >= c.stamp THEN o.msg_idx ELSE -o.msg_idx END) rn
 FROM m c JOIN m o ON o.bag = c.bag AND o.topic = '{topic}' WHERE c.topic = 'cloud') x WHERE rn = 1"""


_SYNC = f"""WITH m AS ({_M}), o AS ({_near("odom")}), e AS ({_near("depth")}), k AS ({_near("color")}),
s AS (SELECT c.bag, c.msg_idx cloud_idx, c.stamp, odom_n odom_idx, depth_n depth_idx, CASE WHEN abs(color_d) <= {SLOPS["color"]} THEN color_n END color_idx, odom_d odom_dt, depth_d depth_dt,
 CASE WHEN abs(color_d) <= {SLOPS["color"]} THEN color_d END color_dt,
 CASE WHEN odom_d IS NULL THEN 'odom_missing' WHEN abs(odom_d) > {SLOPS["odom"]} THEN 'odom_slop' WHEN depth_d IS NULL THEN 'depth_missing' WHEN abs(depth_d) > {SLOPS["depth"]} THEN 'depth_slop' END drop_reason
 FROM (SELECT * FROM m WHERE topic = 'cloud') c LEFT JOIN o ON o.bag = c.bag AND o.cloud_idx = c.msg_idx LEFT JOIN e ON e.bag = c.bag AND e.cloud_idx = c.msg_idx LEFT JOIN k ON k.bag = c.bag AND k.cloud_idx = c.msg_idx)"""


@query(_SYNC + " SELECT * FROM s")
def nearest_sync(spark, sf_dir):
    return _synced(spark, sf_dir)


@query(_SYNC + """, t AS (SELECT bag, count(*) FILTER (topic = 'cloud') n_cloud, count(*) FILTER (topic = 'odom') n_odom, count(*) FILTER (topic = 'depth') n_depth, count(*) FILTER (topic = 'color') n_color FROM m GROUP BY 1),
r AS (SELECT bag, count(*) FILTER (drop_reason IS NULL) matches, count(*) FILTER (drop_reason IS NULL AND color_idx IS NOT NULL) with_color, count(*) FILTER (drop_reason = 'odom_missing') odom_missing, count(*) FILTER (drop_reason = 'odom_slop') odom_slop,
 count(*) FILTER (drop_reason = 'depth_missing') depth_missing, count(*) FILTER (drop_reason = 'depth_slop') depth_slop FROM s GROUP BY 1)
SELECT t.*, coalesce(matches, 0) matches, coalesce(with_color, 0) with_color, coalesce(odom_missing, 0) odom_missing, coalesce(odom_slop, 0) odom_slop, coalesce(depth_missing, 0) depth_missing, coalesce(depth_slop, 0) depth_slop, coalesce(matches, 0) > 0 success FROM t LEFT JOIN r USING (bag)""")  # fmt: skip
def sync_report(spark, sf_dir):
    return sync.bag_report(_messages(spark, sf_dir), _synced(spark, sf_dir))


@query(_SYNC + """, v AS (SELECT bag, abs(odom_dt) v, row_number() OVER (PARTITION BY bag ORDER BY abs(odom_dt)) rk, count(*) OVER (PARTITION BY bag) n FROM s WHERE drop_reason IS NULL)
SELECT bag, count(*) n, round(avg(v), 3) mean, max(v) FILTER (rk = round_even((n - 1) * 0.5, 0) + 1) p50, max(v) FILTER (rk = round_even((n - 1) * 0.95, 0) + 1) p95, max(v) FILTER (rk = round_even((n - 1) * 0.99, 0) + 1) p99, max(v) max FROM v GROUP BY 1""")  # fmt: skip
def dt_summary(spark, sf_dir):
    return sync.dt_summary(_synced(spark, sf_dir).where("drop_reason is null"), "odom_dt").withColumn("mean", F.round("mean", 3))


@query(_SYNC + """, a AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY stamp, cloud_idx) - 1 n FROM s WHERE drop_reason IS NULL)
SELECT bag, cloud_idx, n // 2 sample_id FROM a WHERE n % 2 = 0 AND n // 2 < 3""")
def sampled(spark, sf_dir):
    return sync.take_samples(_synced(spark, sf_dir), 2, 3).where("drop_reason is null").select("bag", "cloud_idx", "sample_id")


@query(_SYNC + """, a AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY stamp, cloud_idx) - 1 n FROM s WHERE drop_reason IS NULL), kk AS (SELECT bag, max(n) FILTER (n % 2 = 0 AND n // 2 < 3) last FROM a GROUP BY 1),
t AS (SELECT bag, count(*) accepted, count(*) FILTER (n % 2 = 0) taken FROM a JOIN kk USING (bag) WHERE n <= last OR last < 4 GROUP BY 1), w AS (SELECT bag, drop_reason, count(*) c FROM s WHERE drop_reason IS NOT NULL GROUP BY 1, 2),
y AS (SELECT bag, arg_min(drop_reason, struct_pack(a := -c, b := drop_reason)) why FROM w GROUP BY 1)
SELECT bag, coalesce(accepted, 0) accepted, coalesce(taken, 0) taken, coalesce(accepted - taken, 0) stride_drops, CASE WHEN coalesce(taken, 0) = 0 THEN 'no sample: ' || why END error FROM (SELECT DISTINCT bag FROM s) b LEFT JOIN t USING (bag) LEFT JOIN y USING (bag)""")  # fmt: skip
def sample_report(spark, sf_dir):
    """Every second match of a bag, three at most."""
    return sync.sample_report(_synced(spark, sf_dir), 2, 3)


@query(f"WITH m AS ({_M}) SELECT * FROM (SELECT DISTINCT bag, 'log_' || CASE WHEN rk < 1000 THEN lpad(CAST(rk AS VARCHAR), 3, '0') ELSE CAST(rk AS VARCHAR) END env FROM (SELECT bag, dense_rank() OVER (ORDER BY bag) - 1 rk FROM m))")
def env_names(spark, sf_dir):
    return sync.env_names(_messages(spark, sf_dir), "log")


_TERRAIN = f"""WITH pts AS ({_PTS}), t AS (SELECT *, CASE WHEN z > {GROUND} AND z < 1.5 * {HEIGHT} THEN 'obstacle' WHEN z < {GROUND} AND z > -{GROUND} THEN 'free' END terrain FROM pts)"""


@query(_TERRAIN + " SELECT env, terrain, count(*) n, round(sum(z), 6) z FROM t WHERE terrain IS NOT NULL GROUP BY 1, 2")
def terrain(spark, sf_dir):
    t = P.classify_terrain(d.view(spark, sf_dir, d.POINTS), F.lit(0.0), GROUND, HEIGHT)
    return t.groupBy("env", "terrain").agg(F.count("*").alias("n"), _r(F.sum("z")).alias("z"))


_BOUNDS = _TERRAIN + f""", o AS (SELECT * FROM t WHERE terrain = 'obstacle'), b AS (SELECT env, min(x) - {CLEAR} lx, max(x) + {CLEAR} hx, min(y) - {CLEAR} ly, max(y) + {CLEAR} hy FROM o GROUP BY 1),
n AS (SELECT *, CAST(ceil((hx - lx) / {VOXEL} / 10) * 10 AS INTEGER) num_x, CAST(ceil((hy - ly) / {VOXEL} / 10) * 10 AS INTEGER) num_y FROM b),
p AS (SELECT env, num_x, num_y, (lx + hx) / 2 - num_x / 2 * {VOXEL} start_x, (ly + hy) / 2 - num_y / 2 * {VOXEL} start_y FROM n),
c AS (SELECT o.env, CAST(round_even((x - start_x) / {VOXEL}, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / {VOXEL}, 0) AS INTEGER) iy, num_x, num_y FROM o JOIN p USING (env)), ok AS (SELECT * FROM c WHERE ix >= 0 AND ix < num_x AND iy >= 0 AND iy < num_y)"""


def _obstacles(spark, sf_dir):
    t = P.classify_terrain(d.view(spark, sf_dir, d.POINTS), F.lit(0.0), GROUND, HEIGHT)
    return t.where("terrain = 'obstacle'")


def _params(spark, sf_dir):
    return P.map_bounds(_obstacles(spark, sf_dir), VOXEL, CLEAR)


@query(_BOUNDS + " SELECT env, num_x, num_y, round(start_x, 6) start_x, round(start_y, 6) start_y FROM p")
def map_bounds(spark, sf_dir):
    return _params(spark, sf_dir).select("env", "num_x", "num_y", _r("start_x").alias("start_x"), _r("start_y").alias("start_y"))


@query(_BOUNDS + " SELECT env, ix, iy, count(*) hit_votes FROM ok GROUP BY 1, 2, 3")
def hit_votes(spark, sf_dir):
    return P.hit_votes(P.to_cells(_obstacles(spark, sf_dir), _params(spark, sf_dir)))


@query(f"""WITH pts AS ({_PTS}), lo AS (SELECT env, min(x) mx, min(y) my, min(z) mz FROM pts GROUP BY 1), k AS (SELECT env, x, y, z, floor((x - mx + 0.25) / 0.5) kx, floor((y - my + 0.25) / 0.5) ky, floor((z - mz + 0.25) / 0.5) kz FROM pts JOIN lo USING (env))
SELECT env, CAST(kx AS BIGINT) kx, CAST(ky AS BIGINT) ky, CAST(kz AS BIGINT) kz, round(avg(x), 9) x, round(avg(y), 9) y, round(avg(z), 9) z, count(*) n FROM k GROUP BY 1, 2, 3, 4""")  # fmt: skip
def voxel_downsample(spark, sf_dir):
    v = P.voxel_downsample(d.view(spark, sf_dir, d.POINTS), 0.5)
    return v.select("env", *(F.col(f"k{c}").cast("long").alias(f"k{c}") for c in "xyz"), *(_r(c, 9).alias(c) for c in "xyz"), "n")


@query(_BOUNDS + """, occ AS (SELECT DISTINCT env, ix, iy FROM ok), off AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE sqrt(i * i + j * j) <= 2)
SELECT DISTINCT occ.env, CAST(occ.ix + i AS INTEGER) ix, CAST(occ.iy + j AS INTEGER) iy FROM occ CROSS JOIN off JOIN p USING (env) WHERE occ.ix + i >= 0 AND occ.ix + i < num_x AND occ.iy + j >= 0 AND occ.iy + j < num_y""")  # fmt: skip
def inflated(spark, sf_dir):
    params = _params(spark, sf_dir)
    return P.inflate(P.occupied_cells(P.to_cells(_obstacles(spark, sf_dir), params)), params, 0.1, VOXEL)


@query(_BOUNDS + f""", {_grid()}, z AS (SELECT DISTINCT env, ix, iy FROM ok), l AS (SELECT g.*, z.env IS NOT NULL occupied FROM g LEFT JOIN z USING (env, ix, iy)), {_distances("df", "l", "occupied")}
SELECT env, ix, iy, round(d, 6) AS "value" FROM df""")  # fmt: skip
def distance_field_full(spark, sf_dir):
    """Distances on the maps' own cells."""
    params = _params(spark, sf_dir)
    return grids.distance_cells(P.occupied_cells(P.to_cells(_obstacles(spark, sf_dir), params)), params).withColumn("value", _r("value"))


@query(_BOUNDS.replace("WITH pts", "WITH RECURSIVE pts", 1) + """, o4 AS (SELECT DISTINCT env, ix, iy, CAST(ix AS BIGINT) * num_y + iy id FROM ok),
reach AS (SELECT env, id root, ix, iy, id FROM o4 UNION SELECT r.env, r.root, c.ix, c.iy, c.id FROM reach r JOIN o4 c ON c.env = r.env AND abs(c.ix - r.ix) + abs(c.iy - r.iy) = 1)
SELECT env, ix, iy, min(root) AS "label", count(*) AS "size" FROM reach GROUP BY 1, 2, 3""")  # fmt: skip
def component_labels(spark, sf_dir):
    """Labels of 4-connected obstacle cells; tested against a flood fill."""
    params = _params(spark, sf_dir)
    return grids.component_cells(P.occupied_cells(P.to_cells(_obstacles(spark, sf_dir), params)), params)


def _surface_sql(robot: float, sigma: float = 2.5) -> str:
    """CTEs and the final rows of a surface map from g (every cell), ok, fr and way (obstacle, free and corridor cells); robot and sigma in cells."""
    return f"""l AS MATERIALIZED (SELECT g.*, o.env IS NOT NULL obstacle, f.env IS NOT NULL free, w.env IS NOT NULL corridor FROM g LEFT JOIN (SELECT DISTINCT env, ix, iy FROM ok) o USING (env, ix, iy) LEFT JOIN fr f USING (env, ix, iy) LEFT JOIN way w USING (env, ix, iy)),
l0 AS (SELECT env, ix, iy, num_x, num_y, CASE WHEN obstacle THEN 1e0 ELSE 0e0 END v FROM l), l1 AS (SELECT env, ix, iy, num_x, num_y, CASE WHEN free THEN 0e0 ELSE 1e0 END v FROM l), {_smoothed("so", "l0", robot)}, {_smoothed("sl", "l1", sigma)},
m AS (SELECT l.*, so.v / (max(so.v) OVER (PARTITION BY env) + 1e-5) obs, CASE WHEN max(sl.v) OVER (PARTITION BY env) > 0 THEN sl.v / max(sl.v) OVER (PARTITION BY env) ELSE sl.v END lay FROM l JOIN so USING (env, ix, iy) JOIN sl USING (env, ix, iy)),
n1 AS MATERIALIZED (SELECT *, NOT corridor AND (obs > 0.3 OR lay >= 0.7) blocked FROM m), {_distances("ds", "n1", "NOT blocked")},
d0 AS (SELECT env, ix, iy, num_x, num_y, coalesce(d, 0) v FROM ds JOIN g USING (env, ix, iy)), {_smoothed("sd", "d0", sigma)}
SELECT env, ix, iy, round(ln(v + 1.00001), 6) + 0.0 AS "value" FROM sd"""


def _corridor_sql(poses: str, radius: float) -> str:
    """Cells within radius cells of a pose's."""
    n = int(radius) + 1
    return f"""SELECT DISTINCT k.env, ix + i ix, iy + j iy FROM (SELECT DISTINCT q.env, CAST(round_even((x - start_x) / {VOXEL}, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / {VOXEL}, 0) AS INTEGER) iy FROM ({poses}) q JOIN p USING (env)) k,
 (SELECT i, j FROM range(-{n}, {n + 1}) a(i), range(-{n}, {n + 1}) b(j) WHERE sqrt(i * i + j * j) <= {radius!r}) off"""


_FREE = f"SELECT DISTINCT t.env, CAST(round_even((x - start_x) / {VOXEL}, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / {VOXEL}, 0) AS INTEGER) iy FROM t JOIN p USING (env) WHERE terrain = 'free'"


@query(_BOUNDS + f", {_grid()}, fr AS ({_FREE}), way AS ({_corridor_sql(_POSES, 0.3 / VOXEL)}), {_surface_sql(0.3 / VOXEL)}")
def surface_map(spark, sf_dir):
    """Cost maps of all envs from obstacle and free points and the corridor of poses."""
    params = _params(spark, sf_dir)
    pts = P.classify_terrain(d.view(spark, sf_dir, d.POINTS), F.lit(0.0), GROUND, HEIGHT)
    layers = P.to_cells(pts, params).where("inside").select("env", "ix", "iy", F.col("terrain").alias("layer")).distinct()
    poses = d.view(spark, sf_dir, d.POSES).select("env", "frame_id", "x", "y", "z")
    return grids.surface_map(layers.unionByName(P.corridor(poses, params, 0.3, VOXEL).withColumn("layer", F.lit("corridor"))), params).withColumn("value", _r("value"))


_VOTES = _BOUNDS + """, h AS (SELECT env, ix, iy, count(*) hit_votes FROM ok GROUP BY 1, 2, 3), fr AS (SELECT t.env, frame_id, CAST(round_even((x - start_x) / 0.05, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / 0.05, 0) AS INTEGER) iy, num_x, num_y FROM t JOIN p USING (env) WHERE terrain = 'free'),
f AS (SELECT env, ix, iy, count(DISTINCT frame_id) free_votes FROM fr WHERE ix >= 0 AND ix < num_x AND iy >= 0 AND iy < num_y GROUP BY 1, 2, 3),
v AS (SELECT env, ix, iy, coalesce(hit_votes, 0) hit_votes, coalesce(free_votes, 0) free_votes FROM h FULL JOIN f USING (env, ix, iy)), w AS (SELECT *, hit_votes / (hit_votes + free_votes + 1e-6) ratio FROM v)"""


def _votes(spark, sf_dir):
    params = stored(_params(spark, sf_dir), "map-bounds")
    pts = P.classify_terrain(d.view(spark, sf_dir, d.POINTS), F.lit(0.0), GROUND, HEIGHT)
    cells = P.to_cells(pts, params).where("inside")
    votes = P.vote_occupancy(P.hit_votes(cells.where("terrain = 'obstacle'")), P.free_votes(cells.where("terrain = 'free'")), 2, 0.5, 2)
    return P.carve(votes, 2, 0.6), params


@query(_VOTES + " SELECT env, ix, iy, hit_votes, free_votes, round(ratio, 6) ratio, hit_votes >= 2 AND ratio >= 0.5 AND NOT (free_votes >= 2 AND ratio <= 0.6) occupied, free_votes >= 2 free FROM w")
def vote_occupancy(spark, sf_dir):
    return _votes(spark, sf_dir)[0].withColumn("ratio", _r("ratio"))


_RAY_CELLS = _VOTES + f""", {_grid()}, o0 AS (SELECT env, ix, iy FROM w WHERE hit_votes >= 2 AND ratio >= 0.5 AND NOT (free_votes >= 2 AND ratio <= 0.6)),
o1 AS (SELECT DISTINCT a.* FROM o0 a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) n(i, j) JOIN o0 b ON b.env = a.env AND b.ix = a.ix + i AND b.iy = a.iy + j),
c1 AS MATERIALIZED (SELECT g.*, o1.env IS NOT NULL occupied, o1.env IS NULL AND coalesce(w.free_votes >= 2, false) free FROM g LEFT JOIN o1 USING (env, ix, iy) LEFT JOIN w USING (env, ix, iy)), {_distances("dc", "c1", "occupied")},
c2 AS MATERIALIZED (SELECT c1.*, greatest(CASE WHEN occupied OR free THEN 0e0 ELSE 0.3e0 END, CASE WHEN occupied THEN 1e0 WHEN d IS NULL THEN 0e0 ELSE 1 / (1 + exp(least(greatest((d * {VOXEL} - 0.3) / 0.1, -60), 60))) END) v FROM c1 JOIN dc USING (env, ix, iy))"""


@query(_RAY_CELLS + f""", {_smoothed("sc", "c2", 1.0)}
SELECT env, ix, iy, round(least(greatest(sc.v, 0), 1), 6) + 0.0 AS "value", CASE WHEN occupied THEN 2 WHEN free THEN 1 ELSE 0 END state FROM sc JOIN c1 USING (env, ix, iy)""")  # fmt: skip
def raycast_map(spark, sf_dir):
    """Cost and state of each cell from votes."""
    votes, params = _votes(spark, sf_dir)
    return grids.raycast_map(votes, params, radius=0.3, softness=0.1, unknown_cost=0.3, least=2, sigma=1.0).withColumn("value", _r("value"))


_PAIRS = f"""WITH q AS ({_POSES}), a AS (SELECT q.*, unnest([1, 6, 11, 16, 21]) ahead, max(frame_id) OVER (PARTITION BY env) lf FROM q),
j AS (SELECT a.env, a.ahead, a.frame_id, a.lf, a.x ox, a.y oy, a.z oz, -a.qx ux, -a.qy uy, -a.qz uz, a.qw w, b.x - a.x dx, b.y - a.y dy, b.z - a.z dz FROM a JOIN q b ON b.env = a.env AND b.frame_id = least(a.frame_id + a.ahead, a.lf)),
t AS (SELECT *, 2 * (uy * dz - uz * dy) tx, 2 * (uz * dx - ux * dz) ty, 2 * (ux * dy - uy * dx) tz FROM j)"""


def _pairs(spark, sf_dir):
    p = d.view(spark, sf_dir, d.POSES)
    return pairs.goal_pairs(p.select("env", "frame_id", F.struct(*g.POSE).alias("pose")), 25, 5)


@query(_PAIRS + " SELECT env, (ahead - 1) // 5 * (lf + 1) + frame_id pair_id, ahead, frame_id, round(dx + w * tx + uy * tz - uz * ty, 6) + 0.0 gx, round(dy + w * ty + uz * tx - ux * tz, 6) + 0.0 gy, round(dz + w * tz + ux * ty - uy * tx, 6) + 0.0 gz FROM t")
def goal_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("env", "pair_id", "ahead", "frame_id", *(_r(F.col(f"goal.{c}")).alias(f"g{c}") for c in "xyz"))


@query(_PAIRS + " SELECT env, split, CASE split WHEN 'train' THEN CAST(floor(n * 0.9) AS BIGINT) ELSE n - CAST(floor(n * 0.9) AS BIGINT) END n FROM (SELECT env, count(*) n FROM t GROUP BY 1) CROSS JOIN (SELECT unnest(['train', 'test']) split)")
def split_sizes(spark, sf_dir):
    return pairs.exact_split(_pairs(spark, sf_dir)).groupBy("env", "split").agg(F.count("*").alias("n"))


def _trajectories(spark, sf_dir):
    """Straight plans of five keypoints to the goal of each pair."""
    p = _pairs(spark, sf_dir).withColumn("traj_id", F.xxhash64("env", "pair_id"))
    kp = p.select("traj_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("kp_idx"), "goal")
    kp = kp.select("traj_id", "kp_idx", *((F.col(f"goal.{c}") * F.col("kp_idx") / 5).alias(c) for c in "xyz"))
    return p, scoring.densify(kp)


@query(_PAIRS + ", u AS (SELECT env, ahead, frame_id, sqrt(dx * dx + dy * dy + dz * dz) len FROM t) SELECT env, ahead, frame_id, round(len, 5) path, round(len * 0, 5) + 0.0 motion, CAST(0 AS DOUBLE) goal FROM u")
def straight_plans(spark, sf_dir):
    """A straight plan has the goal's distance as length, and no motion or goal cost (rotation keeps lengths)."""
    p, wp = _trajectories(spark, sf_dir)
    s = scoring.score(wp, p.select("traj_id", *(F.col(f"goal.{c}").alias(f"g{c}") for c in "xyz")), path=True)
    return p.drop("goal").join(s, "traj_id").select("env", "ahead", "frame_id", _r("path", 5).alias("path"), _r("motion", 5).alias("motion"), _r("goal", 5).alias("goal"))


SHIFT = (0.3, -0.2)


@query(_PAIRS + f""", k AS (SELECT env, ahead, frame_id, dx + w * tx + uy * tz - uz * ty gx, dy + w * ty + uz * tx - ux * tz gy, dz + w * tz + ux * ty - uy * tx gz FROM t)
SELECT env, ahead, frame_id, CAST(i + 1 AS INTEGER) kp_idx, round(gx * i / 5 + {SHIFT[0]}, 6) + 0.0 x, round(gy * i / 5 + {SHIFT[1]}, 6) + 0.0 y, round(gz * i / 5, 6) + 0.0 z FROM k, range(0, 6) a(i)""")  # fmt: skip
def shifted_plans(spark, sf_dir):
    """Keypoints moved to a sensor away from the robot's centre."""
    p = _pairs(spark, sf_dir).withColumn("traj_id", F.struct("env", "ahead", "frame_id"))
    kp = p.select("traj_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("kp_idx"), "goal").select("traj_id", "kp_idx", *((F.col(f"goal.{c}") * F.col("kp_idx") / 5).alias(c) for c in "xyz"))
    return scoring.shift_sensor(kp, *SHIFT).select("traj_id.*", "kp_idx", *(_r(c).alias(c) for c in "xyz"))


@query(f"SELECT env, count(*) images, count(*) * 5 pairs FROM ({_POSES}) q GROUP BY 1")
def dataset_counts(spark, sf_dir):
    return pairs.dataset_counts(d.view(spark, sf_dir, d.POSES), 25, 5)


def _ray_cells(spark, sf_dir):
    votes, params = _votes(spark, sf_dir)
    return grids.raycast_map(votes, params, radius=0.3, softness=0.1, unknown_cost=0.3, least=2), params


@query(_RAY_CELLS + """ SELECT env, count(*) FILTER (occupied) occupied, count(*) FILTER (free) free, count(*) FILTER (NOT occupied AND NOT free) unknown, round(max(v), 6) + 0.0 max_cost, round(avg(v), 6) + 0.0 mean_cost FROM c2 GROUP BY 1""")
def ray_layer_stats(spark, sf_dir):
    s = grids.layer_stats(_ray_cells(spark, sf_dir)[0])
    return s.withColumns({c: _r(c) for c in ("max_cost", "mean_cost")})


@query(_TERRAIN + f""", p AS ({_BOUNDS} SELECT * FROM p), h AS ({_BOUNDS} SELECT env, ix, iy, count(*) n FROM ok GROUP BY 1, 2, 3), e AS (SELECT env, min(n) lo, max(n) hi FROM h GROUP BY 1)
SELECT env, num_y - 1 - iy AS "row", ix col, CAST(CASE WHEN hi > lo THEN trunc(CAST(n - lo AS DOUBLE) / (hi - lo) * 255) ELSE 0 END AS INTEGER) AS "value" FROM h JOIN e USING (env) JOIN p USING (env)""")
def hit_images(spark, sf_dir):
    """Hit votes as pixels of an image of each map."""
    params = stored(_params(spark, sf_dir), "map-bounds")
    hits = P.hit_votes(P.to_cells(_obstacles(spark, sf_dir), params)).withColumn("votes", F.col("hit_votes").cast("double"))
    return grids.normalised_cells(hits, params, "votes")


#: Sideways and upward bends of a plan's keypoints 1 to 5, so that paths curve and end beside their goals.
BENDS = ((0.3, 0.05), (0.5, 0.1), (0.2, 0.15), (0.0, 0.2), (0.0, 0.25))
AHEAD = 2.5


def _curved(spark, sf_dir):
    """Pairs and keypoints of plans that bend on their way to the pair's goal."""
    p = _pairs(spark, sf_dir).withColumn("traj_id", F.xxhash64("env", "pair_id"))
    bend = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(z).alias("z")) for y, z in BENDS))
    kp = p.select("traj_id", "goal", F.posexplode(bend).alias("i", "b")).withColumn("kp_idx", F.col("i") + 1)
    at = lambda c: F.col(f"goal.{c}") * F.col("kp_idx") / 5
    return p, kp.select("traj_id", "kp_idx", at("x").alias("x"), (at("y") + F.col("b.y")).alias("y"), (at("z") + F.col("b.z")).alias("z"))


def _plans_sql() -> str:
    """CTE wp (plan, wp_idx, x, y, z, gx.., pose): curved plans, densified by the cubic Hermite of their keypoints."""
    bends = " ".join(f"({i + 1}, {y}, {z})," for i, (y, z) in enumerate(BENDS)).rstrip(",")
    key, h = "env, ahead, frame_id", ("2 * t * t * t - 3 * t * t + 1", "t * t * t - 2 * t * t + t", "-2 * t * t * t + 3 * t * t", "t * t * t - t * t")
    tangent = lambda c: f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END t{c}"
    cols = [f"{a}{c}" for c in "xyz" for a in ("", "t")]
    return f"""pl AS (SELECT {key}, ox, oy, oz, ux, uy, uz, w, dx + w * tx + uy * tz - uz * ty gx, dy + w * ty + uz * tx - ux * tz gy, dz + w * tz + ux * ty - uy * tx gz FROM t),
kp AS (SELECT {key}, i, gx * i / 5 x, gy * i / 5 + b y, gz * i / 5 + c z FROM pl, (VALUES {bends}) v(i, b, c) UNION ALL SELECT {key}, 0, 0, 0, 0 FROM pl),
tn AS (SELECT *, {', '.join(map(tangent, 'xyz'))} FROM kp WINDOW w AS (PARTITION BY {key} ORDER BY i)),
sg AS (SELECT *, {', '.join(f'lead({c}) OVER w n{c}' for c in cols)} FROM tn WINDOW w AS (PARTITION BY {key} ORDER BY i)),
wp AS MATERIALIZED (SELECT {key}, CAST(i * 10 + s AS INTEGER) wp_idx, {', '.join(f'({h[0]}) * {c} + ({h[1]}) * t{c} + ({h[2]}) * n{c} + ({h[3]}) * nt{c} AS {c}' for c in 'xyz')}
 FROM (SELECT *, s / 10.0 t FROM (SELECT *, unnest(range(0, CASE WHEN i = 4 THEN 11 ELSE 10 END)) s FROM sg WHERE i < 5) a) b)"""


def _scores_sql() -> str:
    """Scores of wp by the cells of c2: 16 cells around each place, edges clamped; ground is a layer of its own."""
    key = "env, ahead, frame_id"
    weight = lambda d: f"CASE WHEN {d} <= 1 THEN (1.25 * {d} - 2.25) * {d} * {d} + 1 ELSE ((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3 END"
    return f"""ws AS (SELECT wp.*, pl.gx, pl.gy, pl.gz, (ox + x + 2 * (w * (-uy * z + uz * y) - uy * (-ux * y + uy * x) + uz * (-uz * x + ux * z)) - start_x) / {VOXEL} - 0.5 hx,
 (oy + y + 2 * (w * (-uz * x + ux * z) - uz * (-uy * z + uz * y) + ux * (-ux * y + uy * x)) - start_y) / {VOXEL} - 0.5 hy, p.num_x, p.num_y FROM wp JOIN pl USING ({key}) LEFT JOIN p USING (env)),
tp AS (SELECT {key}, wp_idx, CAST(least(greatest(floor(hx) + i, 0), num_x - 1) AS INTEGER) ix, CAST(least(greatest(floor(hy) + j, 0), num_y - 1) AS INTEGER) iy,
 ({weight('abs(hx - floor(hx) - i)')}) * ({weight('abs(hy - floor(hy) - j)')}) k FROM ws, range(-1, 3) a(i), range(-1, 3) b(j) WHERE num_x IS NOT NULL),
sm AS (SELECT {key}, wp_idx, sum(k * v) cost, sum(k * 0.02 * ((ix + 2 * iy) % 7)) ground FROM tp JOIN c2 USING (env, ix, iy) GROUP BY ALL),
sq AS (SELECT ws.*, sm.cost, sm.ground, sqrt((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o) + (z - lag(z) OVER o) * (z - lag(z) OVER o)) seg FROM ws LEFT JOIN sm USING ({key}, wp_idx) WINDOW o AS (PARTITION BY {key} ORDER BY wp_idx)),
al AS (SELECT *, coalesce(sum(seg) OVER (PARTITION BY {key} ORDER BY wp_idx), 0) along FROM sq),
tot AS (SELECT {key}, sum(cost) obstacle, sum(abs(z - ground)) height, sum(abs(sqrt(gx * gx + gy * gy + gz * gz) / 50 - seg)) motion, max(cost) FILTER (wp_idx > 0 AND along <= {AHEAD}) worst,
 ln(sqrt((any_value(gx) - max_by(x, wp_idx)) ** 2 + (any_value(gy) - max_by(y, wp_idx)) ** 2 + (any_value(gz) - max_by(z, wp_idx)) ** 2) + 1) goal FROM al GROUP BY ALL)
SELECT {key}, round(obstacle, 5) + 0.0 obstacle, round(height, 5) + 0.0 height, round(motion, 5) + 0.0 motion, round(goal, 5) + 0.0 goal, CASE WHEN obstacle IS NOT NULL THEN coalesce(worst > 0.5, false) END fear,
 round(0.5 * obstacle + height + 2 * motion + 5 * goal, 4) + 0.0 total FROM tot"""


@query(f"WITH c2 AS MATERIALIZED ({_RAY_CELLS} SELECT env, ix, iy, v FROM c2), p AS MATERIALIZED ({_BOUNDS} SELECT * FROM p), {_PAIRS.removeprefix('WITH ')}, {_plans_sql()}, {_scores_sql()}")
def plan_scores(spark, sf_dir):
    """Curved plans scored against the raycast maps and a ground layer; plans of envs without a map have no such costs."""
    cells, params = _ray_cells(spark, sf_dir)
    p, kp = _curved(spark, sf_dir)
    w = scoring.to_world(scoring.densify(kp).join(p.select("traj_id", "env", "pose"), "traj_id")).drop("pose", "wz")
    ground = cells.withColumn("ground", ((F.col("ix") + 2 * F.col("iy")) % 7) * 0.02)
    sampled = scoring.lookup(w, ground, params, {"cost": "value", "ground": "ground"})
    s = scoring.score(sampled, p.select("traj_id", *(F.col(f"goal.{c}").alias(f"g{c}") for c in "xyz")), AHEAD)
    s = p.select("traj_id", "env", "ahead", "frame_id").join(s, "traj_id").drop("traj_id")
    return s.withColumns({c: _r(c, 5) for c in ("obstacle", "height", "motion", "goal")} | {"total": _r("total", 4)})


def _planner_sql(events: str) -> str:
    """The planner's fold, event by event. events: robot_id, event_id, ts, kind, fear, forward, arrived, pushed (null: a stick with too few axes or buttons), pressed."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) n FROM ({events}) a),
f AS (SELECT DISTINCT robot_id, CAST(NULL AS BIGINT) event_id, CAST(0 AS BIGINT) n, 0 c, false k, 0 s, false a, false m FROM r
 UNION ALL SELECT robot_id, event_id, n, CAST(c1 AS INTEGER), k1, CAST(CASE WHEN plan AND k1 AND s1 = 0 THEN -1 ELSE s1 END AS INTEGER), a1, m1 FROM
 (SELECT *, CASE WHEN NOT plan THEN c0 WHEN fear > 0.5 AND forward THEN c0 + CASE WHEN k0 THEN 0 ELSE 1 END WHEN k0 THEN c0 - 1 ELSE c0 END c1,
  CASE WHEN NOT plan THEN k0 WHEN c1 > 3 THEN true WHEN c1 <= 0 THEN false ELSE k0 END k1 FROM
 (SELECT *, kind = 'tick' AND a plan, CASE WHEN plan AND arrived AND NOT m THEN CASE WHEN s = 0 THEN 1 ELSE s END WHEN kind = 'goal' THEN 0 ELSE s END s1,
  CASE WHEN kind = 'goal' THEN true WHEN stick AND m1 THEN pushed WHEN plan AND arrived AND NOT m THEN false ELSE a END a1,
  CASE WHEN kind = 'goal' OR stick AND (pressed OR m1 AND NOT pushed) THEN 0 ELSE c END c0, CASE WHEN kind = 'goal' OR stick AND (pressed OR m1 AND NOT pushed) THEN false ELSE k END k0 FROM
 (SELECT r.*, f.c, f.k, f.s, f.a, f.m, kind = 'joy' AND pushed IS NOT NULL stick, CASE WHEN kind = 'goal' THEN false WHEN stick AND pressed THEN true ELSE f.m END m1 FROM f JOIN r ON r.robot_id = f.robot_id AND r.n = f.n + 1) x) y) z)
SELECT robot_id, event_id, c fear_count, k reacting, s status, a active, m smart FROM f WHERE n > 0"""


@query(_planner_sql(f"SELECT robot_id, event_id, ts, CASE kind WHEN 'signup' THEN 'goal' ELSE 'tick' END kind, fear, forward, kind = 'purchase' arrived, CAST(NULL AS BOOLEAN) pushed, false pressed FROM ({_ROBOT}) q"))
def fear_state(spark, sf_dir):
    """Hysteresis and goal status of each robot; the stream gives the same (tested)."""
    e = d.view(spark, sf_dir, d.ROBOT)
    kind = F.when(F.col("kind") == "signup", "goal").otherwise("tick")
    return robot.fold_batch(e.withColumn("distance", F.when(F.col("kind") == "purchase", 0.0)).withColumn("kind", kind))


@query(_planner_sql(f"""SELECT r.robot_id, r.event_id, r.ts, CASE r.kind WHEN 'signup' THEN 'goal' WHEN 'click' THEN 'joy' WHEN 'error' THEN 'joy' ELSE 'tick' END kind, r.fear, r.forward, r.kind = 'purchase' arrived,
 CASE WHEN n_axes >= 2 AND r.event_id % 11 > 0 THEN sqrt(j.forward * j.forward + sideways * sideways) >= 0.6 END pushed, r.kind = 'click' pressed
 FROM ({_ROBOT}) r JOIN ({d.sql_for_duckdb(d.JOY)}) j ON j.event_id = r.event_id"""))
def planner_states(spark, sf_dir):
    """Waypoints, sticks and plans together: joystick mode, its fear reset, the guards, arrival by distance."""
    j = d.view(spark, sf_dir, d.JOY).select("event_id", F.col("forward").alias("stick_x"), F.col("sideways").alias("stick_y"), "n_axes")
    e = d.view(spark, sf_dir, d.ROBOT).join(j, "event_id").withColumn("distance", F.when(F.col("kind") == "purchase", 0.3).otherwise(3.0)).withColumn("pressed", F.col("kind") == "click")
    kind = F.when(F.col("kind") == "signup", "goal").when(F.col("kind").isin("click", "error"), "joy").otherwise("tick")
    return robot.fold_batch(e.withColumn("kind", kind).withColumn("n_buttons", (F.col("event_id") % 11).cast("int")), deadband=0.6)


@query(f"WITH r AS ({_ROBOT}) SELECT robot_id, tick, event_id FROM (SELECT robot_id, ts // 86400000000 tick, event_id, row_number() OVER (PARTITION BY robot_id, ts // 86400000000 ORDER BY ts DESC, event_id DESC) rn FROM r) WHERE rn = 1")
def rate_limited(spark, sf_dir):
    r = d.view(spark, sf_dir, d.ROBOT).select("robot_id", F.timestamp_micros("ts").alias("ts"), F.col("event_id").alias("sample_id"))
    out = robot.rate_limit(r, 86400)
    return out.select("robot_id", F.expr("unix_micros(tick.start) div 86400000000").alias("tick"), F.col("sample_id").alias("event_id"))


@query()
def live_samples(spark, sf_dir):
    """Four topics of each bag matched as they come, queues of ten; held against every combination, message by message (tests)."""
    m = d.view(spark, sf_dir, d.MESSAGES).select(F.col("bag").alias("robot_id"), "topic", F.col("stamp").alias("ts"), F.col("msg_idx").alias("msg_id"))
    return live_sync.live_sync(m, 24 * HOUR)


_SEVEN = ("x", "y", "z", "qx", "qy", "qz", "qw")


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY frame_id) n FROM ({_POSES}) q),
f AS (SELECT env, frame_id, n, {', '.join(_SEVEN)}, CAST(0 AS BIGINT) sample, true kept FROM o WHERE n = 1
 UNION ALL SELECT env, frame_id, n, {', '.join(f'CASE WHEN far THEN {v} ELSE l{v} END' for v in _SEVEN)}, sample + CASE WHEN far THEN 1 ELSE 0 END, far
 FROM (SELECT o.*, {', '.join(f'f.{v} l{v}' for v in _SEVEN)}, f.sample, sqrt({' + '.join(f'(o.{v} - f.{v}) * (o.{v} - f.{v})' for v in _SEVEN)}) >= 5 far FROM f JOIN o ON o.env = f.env AND o.n = f.n + 1) x)
SELECT env, frame_id, sample FROM f WHERE kept""")  # fmt: skip
def moved_poses(spark, sf_dir):
    """Poses away from the last one kept: a fold in order."""
    return robot.deduplicate_motion(d.view(spark, sf_dir, d.POSES), 5.0)


@query("SELECT e.vec_id, p.vec_id proto_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(p.embedding, lambda x: CAST(x AS DOUBLE))), 6) similarity FROM embeddings e CROSS JOIN embeddings p WHERE p.vec_id < 10")
def prototype_similarity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.prototype_similarity(e, e.where("vec_id < 10")).withColumn("similarity", F.round("similarity", 6))


@query('SELECT label, CAST(i - 1 AS INTEGER) "at", round(avg(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) i FROM embeddings) GROUP BY 1, 2')
def label_means(spark, sf_dir):
    return vectors.label_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("mean", _r("mean"))


@query("SELECT run, epoch, round(value, 4) v, round((5 * value + 4 * coalesce(l1, f) + 3 * coalesce(l2, f) + 2 * coalesce(l3, f) + coalesce(l4, f)) / 15, 5) smooth FROM (SELECT CAST(user_id AS VARCHAR) run, event_id epoch, value, lag(value, 1) OVER w l1, lag(value, 2) OVER w l2, lag(value, 3) OVER w l3, lag(value, 4) OVER w l4, first_value(value) OVER w f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def moving_average(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("epoch"), "value")
    return scoring.moving_average(e, 5).select("run", "epoch", F.round("value", 4).alias("v"), F.round("smooth", 5).alias("smooth"))


from . import map_queries, report_queries  # noqa: E402, F401  (registers queries built on those above)
