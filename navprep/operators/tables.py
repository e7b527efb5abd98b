"""Intermediate tables in the folder that all executors share, and joins with a side whose size is known."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
#: Rows of a few numbers each that may be broadcast; beyond, the same join is a shuffle join.
MAX_BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset on a single machine (tests), a temporary folder kept for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base and app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="navprep-")
    return base or _LOCAL[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its plan runs once, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df (stored, or cheap to count) for a join's small side: broadcast up to `most` rows, else shuffled. The result is the same."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
