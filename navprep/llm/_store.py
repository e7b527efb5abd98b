"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F


_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


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
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors and prunes columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables once all that was made of them is stored, too: nothing that is still to be read, or to be made again, may need them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of ids or keys that may be broadcast; above this the same join is a shuffle join.
MAX_BROADCAST_IDS = 2_000_000


def sized(df: DataFrame, max_rows: int = MAX_BROADCAST_IDS) -> DataFrame:
    """df for a join's small side, its rows counted first: broadcast up to max_rows rows (of a few numbers each), shuffled beyond. The result is the same."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def keep_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is in ids (one column, named key)."""
    return docs.join(sized(ids), key, "left_semi")
