"""Nested JSON feeds: station information and status, weather, district polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids come as text or number; text reads both.
INFORMATION = (
    "data struct<stations: array<struct<station_id: string, name: string, lat: double, lon: double, capacity: int>>>"
)
STATUS = (
    "data struct<stations: array<struct<station_id: string, num_bikes_available: int, num_docks_available: int>>>"
)
CURRENT = (
    "current struct<temperature_2m: double, precipitation: double, wind_speed_10m: double, weather_code: int>"
)
FEATURES = (
    "features array<struct<properties: struct<OBJECTID: bigint, CAPA: string>, "
    "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
)


def _stations(df: DataFrame, json: str, schema: str) -> DataFrame:
    return df.select(F.from_json(json, schema).alias("d")).select(F.explode("d.data.stations").alias("s"))


def flatten_station_info(df: DataFrame, *, json="payload") -> DataFrame:
    return _stations(df, json, INFORMATION).select(
        F.col("s.station_id").try_cast("bigint").alias("station_id"),
        F.col("s.name").alias("station_name"),
        "s.lat",
        "s.lon",
        F.coalesce("s.capacity", F.lit(0)).alias("capacity"),
    )


def flatten_station_status(df: DataFrame, *, json="payload") -> DataFrame:
    return _stations(df, json, STATUS).select(
        F.col("s.station_id").try_cast("bigint").alias("station_id"),
        F.coalesce("s.num_bikes_available", F.lit(0)).alias("bikes"),
        F.coalesce("s.num_docks_available", F.lit(0)).alias("docks"),
    )


def parse_weather(df: DataFrame, *, json="payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Readings of weather documents; a document without ``current`` yields no row."""
    zero = lambda name, kind: F.coalesce(f"w.{name}", F.lit(0)).cast(kind)
    return (
        df.select(*keep, F.from_json(json, CURRENT)["current"].alias("w"))
        .where("w is not null")
        .select(
            *keep,
            zero("temperature_2m", "double").alias("temp"),
            zero("precipitation", "double").alias("rain"),
            zero("wind_speed_10m", "double").alias("wind"),
            zero("weather_code", "int").alias("code"),
        )
    )


def polygon_centroids(df: DataFrame, *, json="payload") -> DataFrame:
    """Districts with the mean of their outer ring's vertices; no centroid for other shapes."""
    feature = df.select(F.explode(F.from_json(json, FEATURES)["features"]).alias("f"))
    ring = F.when(F.col("f.geometry.type") == "Polygon", F.try_element_at("f.geometry.coordinates", F.lit(1)))

    def mean(i: int):
        total = F.aggregate("ring", F.lit(0.0), lambda acc, v: acc + v[i])
        return F.round(total / F.nullif(F.size("ring"), F.lit(0)), 6)

    return feature.select(
        F.col("f.properties.OBJECTID").alias("district_id"),
        F.coalesce("f.properties.CAPA", F.lit("Desconocido")).alias("name"),
        ring.alias("ring"),
    ).select("district_id", "name", mean(0).alias("lon"), mean(1).alias("lat"))
