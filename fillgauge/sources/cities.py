"""Other cities' data brought to one feature schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6


def load_hourly_city(df: DataFrame, *, city="dc", rush=D.RUSH_COMMUTE) -> DataFrame:
    """Hourly rental counts (dteday, hr, cnt, weathersit, temp, weekday with Sunday 0).

    Occupancy is approximated by the count's share of the largest count.
    """
    top = df.agg(F.max("cnt")).scalar()
    sunday_first = F.col("weekday")
    return df.withColumn("_top", top).select(
        F.lit(city).alias("city"),
        C.naive(F.col("dteday").cast("timestamp") + F.make_interval(hours=F.col("hr"))).alias("ts"),
        F.col("hr").cast("int").alias("hour"),
        F.pmod(sunday_first + 6, F.lit(7)).cast("int").alias("day_of_week"),
        C.flag(sunday_first.isin(0, 6)).alias("is_weekend"),
        C.in_ranges(F.col("hr"), rush).alias("is_rush_hour"),
        C.flag(F.col("weathersit") >= 3).alias("is_raining"),
        r6(C.ratio(F.col("cnt"), F.col("_top"))).alias("occupancy"),
        r6(F.col("temp") * 47 - 8).alias("temperature"),
    )


# Column names of station pings -> canonical.
PING_ALIASES = {"num_bikes_available": "bikes", "num_docks_available": "docks"}
TIME_COLUMNS = ("timestamp", "last_reported", "last_updated", "ts")


def read_pings(spark: SparkSession, folder: str) -> DataFrame:
    """Station pings from ``folder``: parquet where present, else CSV."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder + "/*.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if list(fs.globStatus(path) or []):
        return spark.read.parquet(folder + "/*.parquet")
    return spark.read.csv(folder + "/*.csv", header=True)


def load_station_city(
    df: DataFrame, *, city="barcelona", rush=D.RUSH_THREE_PEAKS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Station pings with capacity, occupancy and calendar columns."""
    low = df.toDF(*[c.lower() for c in df.columns]).withColumnsRenamed(PING_ALIASES)
    time = next(c for c in TIME_COLUMNS if c in low.columns)
    kind = dict(low.dtypes)[time]
    raw = F.col(time)
    ts = raw if kind.startswith("timestamp") else F.timestamp_seconds(raw.cast("double"))
    if kind == "string":
        ts = F.coalesce(raw.try_cast("timestamp"), F.timestamp_seconds(raw.try_cast("double")))
    pings = low.withColumn("_ts", C.naive(ts)).select(
        F.lit(city).alias("city"),
        F.col("station_id").cast("bigint").alias("station_id"),
        *keep,
        F.col("_ts").alias("ts"),
        F.col("bikes").cast("int").alias("bikes"),
        F.col("docks").cast("int").alias("docks"),
    )
    room = F.nullif(F.col("bikes") + F.col("docks"), F.lit(0))
    return (
        pings.withColumn("capacity", room.cast("int"))
        .withColumn("occupancy", r6(F.coalesce(C.ratio(F.col("bikes"), F.col("capacity")), F.lit(0.0))))
        .withColumn("hour", C.hour_of("ts"))
        .withColumn("day_of_week", C.weekday_of("ts"))
        .withColumn("is_weekend", C.weekend(F.col("day_of_week")))
        .withColumn("is_rush_hour", C.in_ranges(F.col("hour"), rush))
    )


def load_trip_city(spark: SparkSession, path: str, *, city="madrid") -> DataFrame:
    """Trips passed through as they are (CSV, or JSON lines), with the city added."""
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True)
    return raw.withColumn("city", F.lit(city))


def unify_cities(*frames: DataFrame, out: str | None = None) -> DataFrame:
    """All cities under one another; what a city lacks is null. ``out`` writes by city and reads back."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if out is None:
        return united
    united.write.mode("errorifexists").partitionBy("city").parquet(out)
    return united.sparkSession.read.schema(united.schema).parquet(out)
