"""Readings and stations joined with dimension, weather, cluster and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.defaults import MAX_BROADCAST_ROWS
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.slices import asof, asof_small
from fillgauge.session import lookup

EARTH_M = 6_371_000.0
CUBE = ("cx", "cy", "cz")


def enrich_status(status: DataFrame, dimension: DataFrame, *, key="station_id", time="ts") -> DataFrame:
    """Readings of known stations with the dimension's attributes; unknown ids are dropped."""
    levels = ["bikes", "docks"]
    return status.select(key, time, *levels).join(lookup(dimension, [key]), key).select(
        key, "station_name", "lat", "lon", "capacity", *levels, time
    )


def weather_asof(
    snaps, readings, *, key="station_id", time="ts", tie="event_id", max_broadcast=MAX_BROADCAST_ROWS, **kwargs
):
    """Each reading with the last known weather; before the first one the collector's start values.

    A weather table of proven size is broadcast and the readings stay where
    they are; a larger one meets them in time slices.
    """
    values = ["temp", "rain", "wind", "code"]
    rows = snaps.select(key, time, tie)
    found = asof_small(rows, readings, time, time, values, tie, max_broadcast)
    if found is None:
        found = asof(rows, readings, time, time, values, tie=tie, **kwargs)
    return found.select(
        key,
        time,
        tie,
        F.col("_found.temp").alias("temp"),
        F.coalesce("_found.rain", F.lit(0.0)).alias("rain"),
        F.coalesce("_found.wind", F.lit(0.0)).alias("wind"),
        F.coalesce("_found.code", F.lit(0)).cast("int").alias("code"),
    )


def stats_with_cluster(df, assignment, *, key="station_id", level="bikes", capacity="capacity"):
    stats = df.groupBy(key).agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.avg(capacity).alias("capacity"),
        F.avg(level).alias("bikes"),
        F.avg(C.occupancy(level, capacity)).alias("occupancy"),
    )
    return stats.join(assignment, key, "left").select(
        F.col(key).alias("station"),
        *[r6(F.col(c)).alias(c) for c in ("lat", "lon", "capacity", "bikes", "occupancy")],
        "cluster",
    )


def merge_coverage(districts, coverage, *, district="district", default=1):
    return districts.select(district).join(coverage, district, "left").select(
        district, F.coalesce("n_stations", F.lit(default)).cast("bigint").alias("n_stations")
    )


def flow_geometry(edges, stations, *, key="station_id"):
    """Edges with the position of both ends; an edge with an unknown end is dropped."""

    def end(prefix: str) -> DataFrame:
        return stations.select(
            F.col(key).alias(f"{prefix}_id"),
            F.col("lat").alias(f"{prefix}_lat"),
            F.col("lon").alias(f"{prefix}_lon"),
        )

    return edges.join(end("from"), "from_id").join(end("to"), "to_id").select(
        *[r6(F.col(c)).alias(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon", "strength")]
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def coverage_radius(points, stations, *, point="point_id", radius_m=500.0):
    """Stations within ``radius_m`` of each point, anywhere on the globe.

    Equal positions are counted once on either side before anything meets. Then
    cubes at least as wide as the radius, laid through the globe, are joined with
    their neighbours: a straight line is never longer than the way along the
    surface, and neither the poles nor the date line are special to it.
    """
    step = radius_m * 1.001

    def cubes(lat: str, lon: str) -> list[Column]:
        north, east = F.radians(lat), F.radians(lon)
        axes = (F.cos(north) * F.cos(east), F.cos(north) * F.sin(east), F.sin(north))
        return [F.floor(axis * EARTH_M / step).cast("bigint") for axis in axes]

    sites = stations.groupBy("lat", "lon").agg(F.count("*").alias("n")).select(
        F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "n", *(c.alias(n) for c, n in zip(cubes("lat", "lon"), CUBE))
    )
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    places = points.select("lat", "lon").distinct().withColumns(dict(zip(CUBE, cubes("lat", "lon"))))
    for name in CUBE:
        places = places.withColumn("_d", F.explode(around)).withColumn(name, F.col(name) + F.col("_d")).drop("_d")
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= radius_m
    counted = places.join(sites, list(CUBE)).where(near).groupBy("lat", "lon").agg(F.sum("n").alias("n"))
    return points.join(counted, ["lat", "lon"], "left").select(
        point, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_stations")
    )
