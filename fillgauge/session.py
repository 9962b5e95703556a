"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge.defaults import MAX_BROADCAST_ROWS

#: Starts the names of intermediate tables.
PREFIX = "fillgauge-"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what result values depend on. Only runtime settings, safe on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's ``spark.checkpoint.dir``.

    Where the session names no such folder, a local session gets a temporary one;
    on a cluster each machine would have its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="fillgauge-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{PREFIX}{purpose}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Remove all intermediate tables below the shared folder once no result needs them."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{PREFIX}*")
        for found in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ():
            drop_path(spark, found.getPath().toString())


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back.

    Used for aggregated or narrowed frames whose inputs would otherwise be
    computed once per step; the written table also cuts the lineage.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table on whatever file system it lives."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lookup(small: DataFrame, keys: list[str], max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``small`` for broadcast when a count of its keys proves it is small.

    Beyond ``max_rows`` it is returned unmarked: the join then shuffles and
    adaptive execution splits the skewed partitions.
    """
    if small.select(*keys).limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(small)
    return small
