"""A store of recorded environments that commits whole envs: poses, calibration, clouds, ground, frames, maps and splits, each a table with an env column.

A write goes to files of a version of its own; what makes it count is one file, renamed into place when all tables are written. Readers see, for each env, the
tables of the last version that holds it, so an env is there as a whole or not at all, and a failed or running write is never seen.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators.pairs import exact_split
from ..operators.tables import sized

_COMMITS, _COMMIT = "commits", "env string, version string, turn long, tables map<string, string>"


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> DataFrame:
    """env, version, turn, tables (name to schema) of every commit; no row where nothing was committed."""
    at, fs = _files(spark, f"{path}/{_COMMITS}")
    if not fs.exists(at):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.option("recursiveFileLookup", "true").schema(_COMMIT).parquet(f"{path}/{_COMMITS}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of each env."""
    last = F.row_number().over(W.partitionBy("env").orderBy(F.desc("turn"), F.desc("version")))
    return commits(spark, path).withColumn("_r", last).where("_r = 1").drop("_r")


def write_environments(tables: dict[str, DataFrame], path: str) -> str:
    """The tables (each with env) of some envs as their new and only content; the version. An env that a table lacks has no rows in it.

    Other envs stay as they are. A null env is an error."""
    if not tables or any("env" not in t.columns for t in tables.values()):
        raise ValueError("each table needs an env column")
    spark = next(iter(tables.values())).sparkSession
    version, written, schemas = uuid.uuid4().hex, [], []
    for name, t in sorted(tables.items()):
        t = t.withColumn("env", F.col("env").cast("string"))
        t.write.partitionBy("env").parquet(f"{path}/tables/{name}/version={version}")
        schemas += [F.lit(name), F.lit(t.schema.json())]
        written.append(spark.read.schema(t.schema).parquet(f"{path}/tables/{name}/version={version}").select("env"))
    envs = reduce(DataFrame.union, written).distinct()
    if envs.where("env is null").limit(1).count():
        raise ValueError("an env has no name")
    turn = (commits(spark, path).agg(F.max("turn")).first()[0] or 0) + 1
    rows = envs.select("env", F.lit(version).alias("version"), F.lit(turn).cast("long").alias("turn"), F.create_map(*schemas).alias("tables"))
    rows.coalesce(1).write.parquet(f"{path}/pending/{version}")
    source, fs = _files(spark, f"{path}/pending/{version}")
    target, _ = _files(spark, f"{path}/{_COMMITS}/{version}")
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not commit {version}")
    return version


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of all envs as last committed, without the envs whose last commit doesn't hold it; None if no commit does."""
    holds = current(spark, path).where(F.map_contains_key("tables", name)).select(F.col("env").alias("_env"), F.col("version").alias("_version"), F.col("tables")[name].alias("_schema"))
    parts = []
    for version, schema in holds.select("_version", "_schema").distinct().collect():  # as many as there are writes that still count
        one = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/tables/{name}/version={version}")
        parts.append(one.join(sized(holds.where(F.col("_version") == version)), F.col("env") == F.col("_env"), "left_semi"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def kept_split(spark: SparkSession, pairs: DataFrame, path: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """pairs (env, pair_id, ..) with split: the stored one for envs whose number of pairs is the stored one's, else a new one, which is stored for those envs.

    As the count alone decides, pairs of other ids than the stored have a null split, as a list of places in a list would be wrong for them."""
    have = read_table(spark, path, "split")
    fresh = pairs
    if have is not None:
        same = pairs.groupBy("env").agg(F.count("*").alias("n")).join(have.groupBy("env").agg(F.count("*").alias("n")), ["env", "n"], "left_semi").select("env")
        fresh = pairs.join(same, "env", "left_anti")
    if have is None or fresh.limit(1).count():
        write_environments({"split": exact_split(fresh.select("env", "pair_id"), share, seed).select("env", "pair_id", "split")}, path)
        have = read_table(spark, path, "split")
    if have is None:  # there was no pair
        return pairs.withColumn("split", F.lit(None).cast("string"))
    return pairs.join(have.select("env", "pair_id", "split"), ["env", "pair_id"], "left")
