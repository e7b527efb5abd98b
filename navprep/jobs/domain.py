"""Domain views of the driver's tables, as SQL that Spark and DuckDB both run ({us}: microseconds of a timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES = """SELECT CAST(user_id AS STRING) bag, CASE event_type WHEN 'click' THEN 'cloud' WHEN 'view' THEN 'odom' WHEN 'purchase' THEN 'depth' WHEN 'error' THEN 'color' ELSE 'fallback' END topic,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 msg_idx, {us} stamp FROM events"""
_E = "element_at(embedding, {})"


def _v(i: int, cast: str = "DOUBLE") -> str:
    return f"CAST(embedding[{{o}}{i}] AS {cast})"


POSES = f"""SELECT env, frame_id, x, y, z, qx / n qx, qy / n qy, qz / n qz, qw / n qw FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) n FROM (
 SELECT CAST(label AS STRING) env, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 frame_id, {_v(0)} * 10 x, {_v(1)} * 10 y, {_v(2)} * 10 z, {_v(3)} qx, {_v(4)} qy, {_v(5)} qz, {_v(6)} qw FROM embeddings) a) b"""
POINTS = "SELECT CAST(l_suppkey % 8 AS STRING) env, l_orderkey frame_id, l_quantity * 0.2 x, l_extendedprice / 10000 y, l_discount * 10 - 0.3 z FROM lineitem"
ROBOT = "SELECT user_id robot_id, event_id, {us} ts, event_type kind, value / 500 fear, event_id % 3 <> 0 forward FROM events"

#: Frames of 8 x 8 mm with the pose of their vector as camera.
FRAMES = f"""SELECT env, frame_id, 8 height, 8 width, embedding, x, y, z, qx / n qx, qy / n qy, qz / n qz, qw / n qw FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) n FROM (
 SELECT CAST(label AS STRING) env, vec_id frame_id, embedding, {_v(0)} * 10 x, {_v(1)} * 10 y, {_v(2)} * 10 z, {_v(3)} qx, {_v(4)} qy, {_v(5)} qz, {_v(6)} qw FROM embeddings) a) b"""
JOY = "SELECT user_id robot_id, event_id, {us} ts, event_type kind, value / 250 - 1 forward, (event_id % 7 - 3) / 6e0 sideways, event_id % 5 + 1 n_axes FROM events"


def sql_for_spark(q: str) -> str:
    for i in range(8):
        q = q.replace(f"embedding[{{o}}{i}]", f"embedding[{i}]")
    return q.replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))")


def sql_for_duckdb(q: str) -> str:
    for i in range(8):
        q = q.replace(f"embedding[{{o}}{i}]", f"embedding[{i + 1}]")
    return q.replace("{us}", "epoch_us(ts)").replace("AS STRING", "AS VARCHAR")


def view(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    """q over the tables that it names, without leaving views behind."""
    out = sql_for_spark(q)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings", "lineitem") if t in q}
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(out, **tables)
