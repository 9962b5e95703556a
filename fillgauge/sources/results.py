"""Published results that readers see whole: a version is written aside, then a pointer to it is swapped.

A run writes a folder of its own below the result's root and only then renames a small
pointer file over the old one. A run that dies before leaves the old result as it was;
a run that is repeated replaces it. A few earlier versions stay for readers that have
begun, named in the pointer after the current one; all others go with the next run, and
with them what dead runs left behind. A result has one writer at a time and any number
of readers.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fillgauge.session import drop_path

POINTER = "CURRENT"
KEEP = 2


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, root: str, versions: list[str]) -> None:
    """Write the pointer beside the old one and rename it over that."""
    jvm, target, fs = _hadoop(spark, f"{root}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer-{uuid.uuid4().hex}")
    stream = fs.create(fresh)
    stream.write(bytearray("\n".join(versions).encode()))
    stream.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(fresh), fs.makeQualified(target), how
    )


def published(spark: SparkSession, root: str) -> list[str]:
    """The versions that readers may use, the current one first; none before the first run."""
    _, target, fs = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(target):
        return []
    return spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0].split("\n")


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the published version; None before the first."""
    versions = published(spark, root)
    return f"{root}/{versions[0]}" if versions else None


def publish(df: DataFrame, root: str, form: str = "parquet", keep: int = KEEP, **options) -> str:
    """Replace the result at ``root`` by ``df``; returns the new version's folder."""
    spark = df.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists").format(form)
    (writer.option("header", True) if form == "csv" else writer).options(**options).save(f"{root}/{version}")
    kept = [version, *published(spark, root)][:keep]
    _swap(spark, root, kept)
    jvm, _, fs = _hadoop(spark, root)
    found = [s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/version-*")) or ()]
    for name in found:
        if name < version and name not in kept:
            drop_path(spark, f"{root}/{name}")
    return f"{root}/{version}"


def read(spark: SparkSession, root: str, schema: T.StructType | str, form: str = "parquet", **options) -> DataFrame:
    """The published version, whole; later runs do not change it under the reader."""
    at = current(spark, root)
    if at is None:
        raise FileNotFoundError(f"{root} has no published result")
    reader = spark.read.schema(schema).format(form)
    return (reader.option("header", True) if form == "csv" else reader).options(**options).load(at)
