"""Snapshot feeds as files: read, publish, sample, export."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6

TYPES = {
    "ts": "timestamp_ntz",
    "station_id": "bigint",
    "station_name": "string",
    "lat": "double",
    "lon": "double",
    "capacity": "int",
    "bikes": "int",
    "docks": "int",
    "occupancy_raw": "double",
    "is_empty": "int",
    "is_full": "int",
    "delta_bikes": "int",
    "hour": "int",
    "day_of_week": "int",
    "is_weekend": "int",
    "is_holiday": "int",
    "is_rush_hour": "int",
    "is_tourist_season": "int",
    "temp": "double",
    "rain": "double",
    "wind": "double",
    "weather_type": "string",
}


def newest(spark: SparkSession, pattern: str) -> str:
    """The most recently modified file or folder matching a glob, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(path) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString())).getPath().toString()


#: Files whose first lines are read side by side.
HEADERS_AT_ONCE = 8


def header_of(spark: SparkSession, path: str) -> str | None:
    """First line of a CSV file, None of an empty one; reads one line."""
    first = spark.read.text(path).limit(1).first()
    return first[0] if first else None


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a file, folder or glob by their first lines; one line of each is read."""
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    with ThreadPool(HEADERS_AT_ONCE) as pool:
        lines = pool.map(inheritable_thread_target(spark)(lambda f: header_of(spark, f)), files)
    found: dict[str, list[str]] = {}
    for file, line in zip(files, lines):
        if line is not None:
            found.setdefault(line, []).append(file)
    return found


def canonical(header: str, sep: str) -> list[str]:
    """Header names in lower case, as the canonical columns where an alias exists."""
    names = [h.strip().strip('"').lstrip("﻿").lower() for h in header.split(sep)]
    return [D.TRACKING_ALIASES.get(name, name) for name in names]


def typed(name: str, decimal: str, occupancy_scale: float) -> Column:
    kind, raw = TYPES.get(name, "string"), F.trim(F.col(name))
    if kind == "double" and decimal == ",":
        raw = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    value = raw.try_cast(kind) if kind not in ("int", "bigint") else raw.try_cast("double").try_cast(kind)
    if name == "occupancy_raw" and occupancy_scale != 1:
        value = value / float(occupancy_scale)
    return value.alias(name)


def scan_tracking(
    spark: SparkSession, path: str, *, sep: str | None = None, decimal: str = ".", occupancy_scale: float = 1
) -> DataFrame:
    """Snapshot CSV with canonical names and types, of one file, a folder or a glob.

    Files are grouped by their headers, and each group is read under its own; a
    column that a group lacks is null. The separator is taken from the header where
    it is not given. Everything is read as text under an explicit schema, so nothing
    is inferred from data.
    """
    groups = headers(spark, path)
    if not groups:
        raise ValueError(f"{path} has no header")

    def read(header: str, files: list[str]) -> DataFrame:
        mark = sep or (";" if header.count(";") > header.count(",") else ",")
        names = canonical(header, mark)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(schema).csv(files, sep=mark, header=True, enforceSchema=True)
        return raw.select(*[typed(n, decimal, occupancy_scale) for n in names])

    scans = [read(h, files) for h, files in sorted(groups.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def scan_newest(spark: SparkSession, pattern: str, **kwargs) -> DataFrame:
    return scan_tracking(spark, newest(spark, pattern), **kwargs)


def publish_tracking(df: DataFrame, out: str, *, key="station_id", time="ts") -> DataFrame:
    """Write sorted by (station, time) and read back.

    Ranges are cut on both columns, so one busy station spreads over several
    files, and the file statistics serve filters on either.
    """
    df.repartitionByRange(key, time).sortWithinPartitions(key, time).write.mode("errorifexists").parquet(out)
    return df.sparkSession.read.parquet(out)


def sample_and_cap(df: DataFrame, *, key="event_id", keep_one_in=20) -> DataFrame:
    """A fixed share of the rows by key; the same rows whatever the partitioning."""
    return df.where(C.fold(key, keep_one_in) == 0)


def export_frames(
    df: DataFrame, *, key="station_id", time="ts", level="bikes", capacity="capacity", seconds=300, per_doc=1000
) -> DataFrame:
    """One nested document per time frame: localised day, date, clock and the stations.

    Stations are averaged within a frame first. A document holds the stations of
    one id range of ``per_doc``; a larger network has several documents a frame.
    """
    frame = C.floor_time(time, seconds).alias("frame_ts")
    stations = df.groupBy(frame, key).agg(
        F.min_by(F.struct("station_name", "lat", "lon", capacity), time).alias("s"),
        r6(F.avg(level)).alias("bikes"),
        r6(F.avg(C.occupancy(level, capacity))).alias("occupancy"),
    )
    part = F.floor(F.col(key) / per_doc).cast("bigint")
    item = F.struct(
        F.col(key),
        F.col("s.station_name").alias("name"),
        r6(F.col("s.lat")).alias("lat"),
        r6(F.col("s.lon")).alias("lon"),
        F.col(f"s.{capacity}").alias("capacity"),
        "bikes",
        "occupancy",
    )
    docs = stations.groupBy("frame_ts", part.alias("part")).agg(
        F.sort_array(F.collect_list(item)).alias("stations"),
        F.count("*").cast("bigint").alias("n_stations"),
        r6(F.sum("bikes")).alias("bikes_sum"),
    )
    names = F.array(*[F.lit(d) for d in D.DAY_NAMES_ES])
    return docs.select(
        "frame_ts",
        "part",
        F.element_at(names, C.weekday_of("frame_ts") + 1).alias("day"),
        F.date_format("frame_ts", "dd/MM").alias("date"),
        F.date_format("frame_ts", "HH:mm").alias("hour"),
        "stations",
        "n_stations",
        "bikes_sum",
    )


def write_frames(frames: DataFrame, out: str) -> None:
    """JSON lines, one frame document per line."""
    frames.write.mode("errorifexists").json(out)
