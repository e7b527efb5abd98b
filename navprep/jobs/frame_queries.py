"""Queries over frames, clouds and joystick events, each with its oracle in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g
from ..operators import frames as fr, fusion, points as P, vectors
from ..streaming import robot
from . import domain as d
from .registry import query, rounded

FOCAL, CENTRE = 6.0, 3.5
_FR, _JOY = map(d.sql_for_duckdb, (d.FRAMES, d.JOY))


def _frames(spark, sf_dir) -> DataFrame:
    f = d.view(spark, sf_dir, d.FRAMES)
    mm = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20000).cast("int"))
    return f.select("env", "frame_id", "height", "width", mm.alias("data"), *(F.lit(v).alias(c) for c, v in (("fx", FOCAL), ("fy", FOCAL), ("cx", CENTRE), ("cy", CENTRE))), F.struct(*g.POSE).alias("camera"))


_PX = f"""WITH f AS ({_FR}), e AS (SELECT * EXCLUDE (embedding), unnest(embedding) val, unnest(range(0, 64)) k FROM f), px AS (SELECT *, CAST(floor(abs(CAST(val AS DOUBLE)) * 20000) AS INTEGER) mm, k % 8 u, k // 8 v FROM e)"""


@query(_PX + " SELECT env, frame_id, count(*) FILTER (mm > 0 AND mm <= 3000) n, round(sum(mm / 1000.0) FILTER (mm <= 3000), 6) total FROM px GROUP BY 1, 2")
def clean_depth(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("data", fr.clean_depth(F.col("data"), max_depth=3.0))
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return f.select("env", "frame_id", F.size(F.filter("data", lambda x: x > 0)).cast("long").alias("n"), rounded(total).alias("total"))


_WORLD = _PX + f""", s AS (SELECT *, mm / 1000.0 d, (u - {CENTRE}) * mm / 1000.0 / {FOCAL} cx, (v - {CENTRE}) * mm / 1000.0 / {FOCAL} cy FROM px WHERE u % 2 = 0 AND v % 2 = 0 AND v < 7 AND mm BETWEEN 450 AND 10000),
t AS (SELECT *, 2 * (qy * d - qz * cy) tx, 2 * (qz * cx - qx * d) ty, 2 * (qx * cy - qy * cx) tz FROM s)"""


@query(_WORLD + " SELECT env, frame_id, CAST(u AS INTEGER) u, CAST(v AS INTEGER) v, round(x + cx + qw * tx + qy * tz - qz * ty, 6) + 0.0 x, round(y + cy + qw * ty + qz * tx - qx * tz, 6) + 0.0 y, round(z + d + qw * tz + qx * ty - qy * tx, 6) + 0.0 z FROM t")
def depth_points(spark, sf_dir):
    px = fr.sample_pixels(_frames(spark, sf_dir), 2, 1, 0.45, 10.0)
    pts = P.back_project(px, *(F.col(c) for c in ("fx", "fy", "cx", "cy")), F.col("camera"))
    return pts.select("env", "frame_id", "u", "v", *(rounded(c).alias(c) for c in "xyz"))


@query(_WORLD.replace("u % 2 = 0 AND v % 2 = 0 AND v < 7 AND mm BETWEEN 450 AND 10000", "mm BETWEEN 1 AND 10000") + """, w AS (SELECT env, x + cx + qw * tx + qy * tz - qz * ty x, y + cy + qw * ty + qz * tx - qx * tz y, z + d + qw * tz + qx * ty - qy * tx z FROM t),
lo AS (SELECT env, min(x) mx, min(y) my, min(z) mz FROM w GROUP BY 1), k AS (SELECT env, x, y, z, floor((x - mx + 0.05) / 0.1) kx, floor((y - my + 0.05) / 0.1) ky, floor((z - mz + 0.05) / 0.1) kz FROM w JOIN lo USING (env))
SELECT env, CAST(kx AS BIGINT) kx, CAST(ky AS BIGINT) ky, CAST(kz AS BIGINT) kz, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y, round(avg(z), 6) + 0.0 z, count(*) n FROM k GROUP BY 1, 2, 3, 4""")  # fmt: skip
def depth_cloud(spark, sf_dir):
    """Cloud of all frames' measured pixels up to 10 m, those nearer than a map job's 0.2 m too."""
    v = fr.depth_cloud(_frames(spark, sf_dir), 0.1, low=0.001)
    return v.select("env", *(F.col(f"k{c}").cast("long").alias(f"k{c}") for c in "xyz"), *(rounded(c).alias(c) for c in "xyz"), "n")


@query()
def fused_cloud(spark, sf_dir):
    """Surface of the fused frames; tested on a plane."""
    return fusion.fused_cloud(_frames(spark, sf_dir), 0.2, 0.8, 10.0)


@query()
def resized_depth(spark, sf_dir):
    """Frames cropped to 4 : 3 and shrunk; tested by brute force."""
    f = _frames(spark, sf_dir)
    return fr.crop_resize(f.withColumn("data", fr.clean_depth(F.col("data"))), 4, 3)


@query(_PX + " SELECT env, frame_id, CAST((v // 4) * 2 + u // 4 AS INTEGER) tile, CAST(sum(mm) AS BIGINT) total FROM px GROUP BY 1, 2, 3 UNION ALL SELECT env, frame_id, 4, CAST(sum(mm) AS BIGINT) FROM px WHERE u BETWEEN 2 AND 5 AND v BETWEEN 2 AND 5 GROUP BY 1, 2")
def tiles(spark, sf_dir):
    total = F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + x)
    return fr.split_tiles(_frames(spark, sf_dir), 4, 4, centre=True).select("env", "frame_id", "tile", total.alias("total"))


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each frame with the one of the next id."""
    f = _frames(spark, sf_dir)
    nxt = f.select((F.col("frame_id") - 1).alias("pair_id"), F.col("data").alias("b"))
    return f.select(F.col("frame_id").alias("pair_id"), "height", "width", F.col("data").alias("a")).join(nxt, "pair_id")


_NEXT = _PX + ", q AS (SELECT a.frame_id pair_id, a.u, a.v, a.mm a, b.mm b FROM px a JOIN px b ON b.frame_id = a.frame_id + 1 AND b.k = a.k)"


@query(_NEXT + """, w AS (SELECT pair_id, y.y AS "row", x.x AS col, avg(abs(CAST(a AS DOUBLE) - b)) AS "value" FROM q JOIN (SELECT unnest([0, 2, 4]) y) y ON v BETWEEN y.y AND y.y + 3 JOIN (SELECT unnest([0, 2, 4]) x) x ON u BETWEEN x.x AND x.x + 3 GROUP BY 1, 2, 3)
SELECT pair_id, "value", "row", col FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY "value" DESC, "row", col) rn FROM w) z WHERE rn = 1""")  # fmt: skip
def worst_patch(spark, sf_dir):
    return fr.worst_patch(_neighbours(spark, sf_dir), 4, 4, 2, 2)


@query(_NEXT + """, m AS (SELECT avg(CAST(a AS DOUBLE)) ma, avg(CAST(b AS DOUBLE)) mb FROM q), c AS (SELECT pair_id, a - ma x, b - mb y FROM q, m)
SELECT pair_id, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) + 0.0 loss FROM c GROUP BY 1""")  # fmt: skip
def pearson_losses(spark, sf_dir):
    return vectors.pearson_losses(_neighbours(spark, sf_dir)).withColumn("loss", rounded("loss"))


def _shift_sql(pairs: str, ids: str) -> str:
    """The best circular shift of each pair (ids, u, v, a; px as b by id y): sums of products over all shifts, over both norms, no mean taken off."""
    return f"""{pairs}, n AS (SELECT {ids}, sqrt(sum(CAST(a AS DOUBLE) * a)) * sqrt(sum(CAST(b AS DOUBLE) * b)) scale FROM q GROUP BY ALL),
s AS (SELECT {ids}, down, "right", sum(CAST(x.a AS DOUBLE) * y.b) t FROM q x CROSS JOIN range(8) r(down) CROSS JOIN range(8) d("right") JOIN q y USING ({ids}) WHERE y.v = (x.v + down) % 8 AND y.u = (x.u + "right") % 8 GROUP BY ALL),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY t DESC, down, "right") = 1)"""


@query(_shift_sql(_NEXT, "pair_id") + """ SELECT m.pair_id, round(least(greatest(m.t / scale, -1), 1), 6) + 0.0 AS "value", CAST(m.down AS INTEGER) down, CAST(m."right" AS INTEGER) AS "right",
 round(z.t / scale, 6) + 0.0 still, round((1 - least(m.t / scale, 1)) / 2, 6) + 0.0 loss FROM m JOIN n USING (pair_id) JOIN s z ON z.pair_id = m.pair_id AND z.down = 0 AND z."right" = 0""")  # fmt: skip
def best_shifts(spark, sf_dir):
    """Best circular shift between each frame and the next."""
    return fr.best_shifts(_neighbours(spark, sf_dir)).withColumns({c: rounded(c) for c in ("value", "still", "loss")})


@query(_shift_sql(_PX + ", q AS (SELECT x.frame_id x_id, y.frame_id y_id, x.u, x.v, x.mm a, y.mm b FROM px x JOIN px y ON y.k = x.k WHERE y.frame_id < 5)", "x_id, y_id") + """
SELECT x_id, y_id, round(least(greatest(t / scale, -1), 1), 6) + 0.0 AS "value", CAST(down AS INTEGER) down, CAST("right" AS INTEGER) AS "right" FROM m JOIN n USING (x_id, y_id)""")
def pairwise_shifts(spark, sf_dir):
    """Every frame against a stated set of five."""
    f = _frames(spark, sf_dir).select(F.col("frame_id").alias("id"), "height", "width", "data")
    return fr.pairwise_shifts(f, f.where("id < 5")).withColumn("value", rounded("value"))


@query()
def blurred(spark, sf_dir):
    """Augmented frames; tested by brute force."""
    return fr.motion_blur(_frames(spark, sf_dir)).select("env", "frame_id", "reach", "data")


@query(f"""WITH j AS (SELECT * REPLACE (CASE kind WHEN 'click' THEN 'enable' WHEN 'signup' THEN 'goal' ELSE 'stick' END AS kind) FROM ({_JOY}) r), h AS (SELECT *, kind = 'goal' OR n_axes >= 2 heard FROM j),
l AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'goal' THEN false WHEN kind = 'enable' AND heard THEN true END IGNORE NULLS) OVER w, false) smart FROM h WINDOW w AS (PARTITION BY robot_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN kind = 'goal' THEN 1.0 WHEN heard AND smart THEN CASE WHEN sqrt(forward * forward + sideways * sideways) >= 0.2 THEN 5.0 ELSE 0.0 END END k FROM l),
p AS (SELECT *, max(CASE WHEN k IS NOT NULL THEN n END) OVER (PARTITION BY robot_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last_n FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) n FROM c) z)
SELECT p.robot_id, p.event_id, p.smart, CASE WHEN s.k > 0 THEN round(s.forward * s.k, 6) + 0.0 END goal_x, CASE WHEN s.k > 0 THEN round(s.sideways * s.k, 6) + 0.0 END goal_y, coalesce(s.k > 0, false) active FROM p LEFT JOIN p s ON s.robot_id = p.robot_id AND s.n = p.last_n""")  # fmt: skip
def joystick_goals(spark, sf_dir):
    e = d.view(spark, sf_dir, d.JOY).withColumn("pressed", F.col("kind") == "click").withColumnsRenamed({"forward": "stick_x", "sideways": "stick_y"})
    j = robot.joystick_goals(e.withColumn("kind", F.when(F.col("kind") == "signup", "goal").otherwise("joy")), deadband=0.2)
    return j.drop("fear_count", "reacting").withColumn("goal_x", rounded("goal_x")).withColumn("goal_y", rounded("goal_y"))
