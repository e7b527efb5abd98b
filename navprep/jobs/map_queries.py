"""Maps of all envs by each source, on a job's own cells of 0.05 m, with the poses' places scaled to rooms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..operators.tables import sized, stored
from . import catalog as c, domain as d, frame_queries as fq, maps
from .registry import query, rounded
from .report_queries import _POSED, _WORLD
from .settings import resolve

ROBOT_HEIGHT, ROOM = 0.8, 10
_SETTINGS = {"robot_height": ROBOT_HEIGHT, "is_flat_ground": False, "trajectory_clear_radius": 0.5, "voxel_size": c.VOXEL, "depth_raycast_ray_pixel_stride": 1, "depth_raycast_hit_pixel_stride": 1}
_SMALL_POSES = f"SELECT env, frame_id, x / {ROOM} x, y / {ROOM} y, z / {ROOM} z, qx, qy, qz, qw FROM ({d.POSES}) room"
_POSES = d.sql_for_duckdb(_SMALL_POSES)


def _poses(spark, sf_dir) -> DataFrame:
    return d.view(spark, sf_dir, _SMALL_POSES)


def _frames(spark, sf_dir) -> DataFrame:
    """Frames numbered from 0 in their env, as poses are."""
    f = fq._frames(spark, sf_dir).drop("camera")
    n = d.view(spark, sf_dir, "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 n FROM embeddings")
    return f.join(n, F.col("frame_id") == F.col("vec_id")).drop("frame_id", "vec_id").withColumnRenamed("n", "frame_id")


def _scans(spark, sf_dir) -> DataFrame:
    """Points in turn over all poses of their env."""
    n = stored(_poses(spark, sf_dir).groupBy("env").agg(F.count("*").alias("n")), "pose-counts")
    return d.view(spark, sf_dir, d.POINTS).join(sized(n), "env").withColumn("frame_id", F.col("frame_id") % F.col("n")).drop("n")


def _map(spark, sf_dir, source: str, **more) -> DataFrame:
    s = resolve({**_SETTINGS, "cloud_source": source, **more})
    cells, _ = maps.build_map(s, _poses(spark, sf_dir), _frames(spark, sf_dir), _scans(spark, sf_dir))
    return cells.withColumn("value", rounded("value"))


def _voxels(name: str, source: str, size: float) -> str:
    """CTE name (env, x, y, z): the mean point of each voxel of source."""
    k = ", ".join(f"floor(({v} - m{v} + {size / 2!r}) / {size!r}) k{v}" for v in "xyz")
    low = f"SELECT env, {', '.join(f'min({v}) m{v}' for v in 'xyz')} FROM {source} GROUP BY 1"
    return f"{name} AS MATERIALIZED (SELECT env, avg(x) x, avg(y) y, avg(z) z FROM (SELECT s.env, x, y, z, {k} FROM {source} s JOIN ({low}) lo USING (env)) v GROUP BY env, kx, ky, kz)"


def _cloud_map(world: str) -> str:
    """From CTE w (env, x, y, z: points of the world): voxels, terrain, thinned obstacles without outliers, bounds, layers, surface map."""
    v, rows = c.VOXEL, "o.id, o.env, o.x, o.y, o.z"
    return f"""{world}, {_voxels("cloud", "w", 0.9 * v)},
t AS MATERIALIZED (SELECT *, CASE WHEN z > 0.25 AND z < {1.5 * ROBOT_HEIGHT!r} THEN 'obstacle' WHEN z < 0.25 AND z > -0.25 THEN 'free' END terrain FROM cloud), ob AS (SELECT * FROM t WHERE terrain = 'obstacle'), {_voxels("thin", "ob", v)},
o AS MATERIALIZED (SELECT *, row_number() OVER () id FROM thin),
nn AS (SELECT {rows}, list_avg(min(sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y) + (o.z - b.z) * (o.z - b.z)), 50)) m FROM o JOIN o b ON b.env = o.env GROUP BY {rows}),
ce AS (SELECT env, sum(m) / count(*) centre FROM nn GROUP BY 1), sp AS (SELECT env, any_value(centre) + 2 * sqrt(sum((m - centre) * (m - centre)) FILTER (m > 0) / (count(*) - 1)) most FROM nn JOIN ce USING (env) GROUP BY 1),
kept AS MATERIALIZED (SELECT nn.* FROM nn JOIN sp USING (env) WHERE m > 0 AND m < most), bo AS (SELECT env, min(x) - 1 lx, max(x) + 1 hx, min(y) - 1 ly, max(y) + 1 hy FROM kept GROUP BY 1),
nb AS (SELECT *, CAST(ceil((hx - lx) / {v} / 10) * 10 AS INTEGER) num_x, CAST(ceil((hy - ly) / {v} / 10) * 10 AS INTEGER) num_y FROM bo),
p AS MATERIALIZED (SELECT env, num_x, num_y, (lx + hx) / 2 - num_x / 2 * {v} start_x, (ly + hy) / 2 - num_y / 2 * {v} start_y FROM nb),
ok AS (SELECT DISTINCT env, CAST(round_even((x - start_x) / {v}, 0) AS INTEGER) ix, CAST(round_even((y - start_y) / {v}, 0) AS INTEGER) iy FROM kept JOIN p USING (env)),
{c._grid()}, fr AS ({c._FREE}), way AS ({c._corridor_sql(_POSES, 0.5 / v)}), {c._surface_sql(0.3 / v)}"""


_PIXELS = fq._PX + f""", s AS (SELECT *, mm / 1000.0 d, (u - {fq.CENTRE}) * mm / 1000.0 / {fq.FOCAL} cx, (v - {fq.CENTRE}) * mm / 1000.0 / {fq.FOCAL} cy FROM px WHERE {{where}}),
t0 AS (SELECT *, 2 * (qy * d - qz * cy) tx, 2 * (qz * cx - qx * d) ty, 2 * (qx * cy - qy * cx) tz FROM s),
w AS MATERIALIZED (SELECT env, frame_id, x / {ROOM} camx, y / {ROOM} camy, x / {ROOM} + cx + qw * tx + qy * tz - qz * ty x, y / {ROOM} + cy + qw * ty + qz * tx - qx * tz y, z / {ROOM} + d + qw * tz + qx * ty - qy * tx z FROM t0)"""


@query(_cloud_map(_PIXELS.format(where="mm BETWEEN 200 AND 10000")))
def map_from_depth(spark, sf_dir):
    return _map(spark, sf_dir, "depth")


@query()
def map_from_fused_depth(spark, sf_dir):
    """Tested on small scenes and a plane; its parts after the cloud are those of the other sources."""
    return _map(spark, sf_dir, "depth_tsdf")


_MOVED = _POSED.replace("q.x px, q.y py, q.z pz", f"q.x / {ROOM} px, q.y / {ROOM} py, q.z / {ROOM} pz")


@query(_cloud_map(_MOVED + f", w AS MATERIALIZED (SELECT env, px + {_WORLD[0]} x, py + {_WORLD[1]} y, pz + {_WORLD[2]} z FROM j WHERE sqrt(x * x + y * y + z * z) <= 10)"))
def map_from_scans(spark, sf_dir):
    return _map(spark, sf_dir, "scan", scan_transform_mode="base_to_world")


def _ray_map() -> str:
    """Hits, rays cell by cell, votes, thinning by free evidence, clearance cost and smoothing."""
    v, margin, disc = c.VOXEL, max(1, math.ceil(0.08 / c.VOXEL)), 0.5 / c.VOXEL
    n, cell = int(disc) + 1, lambda a, x: f"CAST(round_even(({x} - start_{a}) / {v}, 0) AS INTEGER)"
    ends = f"SELECT w.env, frame_id, {cell('x', 'x')} ix, {cell('y', 'y')} iy, {cell('x', 'camx')} ax, {cell('y', 'camy')} ay, z, num_x, num_y FROM w JOIN p USING (env)"
    step = lambda q: f"CAST(CASE WHEN n = 0 THEN 0 WHEN abs({q}) = n THEN sign({q}) * k ELSE sign({q}) * ceil(k * abs({q}) / CAST(n AS DOUBLE) - 0.5) END AS INTEGER)"
    return f"""{_PIXELS.format(where="mm BETWEEN 350 AND 10000")},
fr0 AS (SELECT env, x / {ROOM} camx, y / {ROOM} camy FROM f), ex AS (SELECT env, x, y FROM w UNION ALL SELECT env, camx, camy FROM fr0),
bo AS (SELECT env, min(x) - 1 lx, max(x) + 1 hx, min(y) - 1 ly, max(y) + 1 hy FROM ex GROUP BY 1),
nb AS (SELECT *, greatest(10, CAST(ceil((hx - lx) / {v} / 10) * 10 AS INTEGER)) num_x, greatest(10, CAST(ceil((hy - ly) / {v} / 10) * 10 AS INTEGER)) num_y FROM bo),
p AS MATERIALIZED (SELECT env, num_x, num_y, (lx + hx) / 2 - num_x / 2 * {v} start_x, (ly + hy) / 2 - num_y / 2 * {v} start_y FROM nb),
e0 AS MATERIALIZED (SELECT * FROM ({ends}) z WHERE ix >= 0 AND ix < num_x AND iy >= 0 AND iy < num_y),
h AS (SELECT env, ix, iy, count(*) hit_votes FROM e0 WHERE z > 0.25 AND z < {1.5 * ROBOT_HEIGHT!r} GROUP BY 1, 2, 3),
r0 AS (SELECT DISTINCT env, frame_id, ax, ay, ix, iy, num_x, num_y, sqrt((ix - ax) * (ix - ax) + (iy - ay) * (iy - ay)) len FROM e0 WHERE ax >= 0 AND ax < num_x AND ay >= 0 AND ay < num_y),
r1 AS (SELECT *, CAST(round_even(ax + (ix - ax) * ((len - {margin}) / len), 0) AS INTEGER) bx, CAST(round_even(ay + (iy - ay) * ((len - {margin}) / len), 0) AS INTEGER) b_y FROM r0 WHERE len > {margin} + 1),
r2 AS (SELECT env, frame_id, CASE WHEN b_y < ay THEN bx ELSE ax END x0, CASE WHEN b_y < ay THEN b_y ELSE ay END y0, CASE WHEN b_y < ay THEN ax ELSE bx END x1, CASE WHEN b_y < ay THEN ay ELSE b_y END y1 FROM r1),
r3 AS (SELECT *, x1 - x0 dx, y1 - y0 dy, greatest(abs(x1 - x0), abs(y1 - y0)) n FROM r2), r4 AS (SELECT *, unnest(range(0, n + 1)) k FROM r3),
fv AS (SELECT env, ix, iy, count(*) free_votes FROM (SELECT DISTINCT env, frame_id, x0 + {step('dx')} ix, y0 + {step('dy')} iy FROM r4) a GROUP BY 1, 2, 3),
vo AS (SELECT env, ix, iy, coalesce(hit_votes, 0) hv, coalesce(free_votes, 0) fv FROM h FULL JOIN fv USING (env, ix, iy)),
k0 AS MATERIALIZED (SELECT *, hv >= 2 AND hv / (hv + fv + 1e-6) >= 0.35 occupied, fv >= 2 free FROM vo),
near AS (SELECT DISTINCT env, ix + i ix, iy + j iy FROM (SELECT * FROM k0 WHERE free) a, (SELECT i, j FROM range(-{n}, {n + 1}) a(i), range(-{n}, {n + 1}) b(j) WHERE sqrt(i * i + j * j) <= {disc!r}) off),
o1 AS (SELECT env, ix, iy FROM k0 WHERE occupied AND env NOT IN (SELECT env FROM k0 WHERE free) UNION ALL SELECT k0.env, k0.ix, k0.iy FROM k0 SEMI JOIN near USING (env, ix, iy) WHERE occupied), {c._grid()},
c1 AS MATERIALIZED (SELECT g.*, o1.env IS NOT NULL occupied, o1.env IS NULL AND coalesce(k0.free, false) free FROM g LEFT JOIN o1 USING (env, ix, iy) LEFT JOIN k0 USING (env, ix, iy)), {c._distances("dc", "c1", "occupied")},
c2 AS MATERIALIZED (SELECT c1.*, greatest(CASE WHEN occupied OR free THEN 0e0 ELSE 1e0 END, CASE WHEN occupied THEN 1e0 WHEN d IS NULL THEN 0e0 ELSE 1 / (1 + exp(least(greatest((d * {v} - 0.3) / 0.05, -60), 60))) END) v FROM c1 JOIN dc USING (env, ix, iy)), {c._smoothed("sc", "c2", 2.5)}
SELECT env, ix, iy, round(least(greatest(v, 0), 1), 6) + 0.0 AS "value" FROM sc"""


@query(_ray_map())
def map_from_rays(spark, sf_dir):
    return _map(spark, sf_dir, "depth_raycast_2d", depth_raycast_surface_thinning_radius=0.5)
