"""Feature jobs on tables small enough to check by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.operators import features

START = datetime(2024, 1, 1)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def readings(spark, rows):
    """rows: (event_id, station_id, minutes since start, bikes[, capacity])."""
    full = [(r[0], r[1], START + timedelta(minutes=r[2]), r[3], r[4] if len(r) > 4 else 10) for r in rows]
    df = spark.createDataFrame(full, "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int, capacity int")
    return df.withColumn("docks", F.col("capacity") - F.col("bikes"))


def by_event(df, col):
    return {r["event_id"]: r[col] for r in df.collect()}


def test_occupancy_without_capacity_is_zero_and_clips_on_request(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, None), (3, 12, 0, 10)], "station_id bigint, bikes int, docks int, capacity int").withColumn(
        "ts", F.lit(START)
    )
    raw = {r["station_id"]: r["occupancy"] for r in features.occupancy_ratio(df).collect()}
    assert raw == {1: 0.0, 2: 0.0, 3: 1.2}
    clipped = {r["station_id"]: r["occupancy"] for r in features.occupancy_ratio(df, clip=True).collect()}
    assert clipped == {1: 0.0, 2: 0.0, 3: 1.0}


def test_capacity_falls_back_to_the_sum(spark):
    df = spark.createDataFrame([(0, 3, 4), (None, 1, 1), (9, 3, 4)], "capacity int, bikes int, docks int")
    got = [r[0] for r in df.select(C.capacity_or_sum("capacity", "bikes", "docks")).collect()]
    assert got == [7, 2, 9]


def test_single_row_station(spark):
    df = readings(spark, [(1, 1, 0, 5)])
    assert one(features.bike_delta(df))["delta"] is None
    assert one(features.bike_delta(df, first=0))["delta"] == 0
    assert one(features.time_split(df))["split"] == "train"


def test_two_row_station_splits_in_half(spark):
    df = readings(spark, [(1, 1, 0, 5), (2, 1, 5, 6)])
    assert by_event(features.time_split(df), "split") == {1: "train", 2: "test"}


def test_arrival_at_an_empty_station(spark):
    df = readings(spark, [(1, 1, 0, 0), (2, 1, 5, 4)])
    assert by_event(features.bike_delta(df), "delta")[2] == 4
    assert by_event(features.bike_delta(df, zero_is_missing=True), "delta")[2] == 0


def test_night_gap_crosses_rows_but_not_time(spark):
    df = readings(spark, [(1, 1, 55, 3), (2, 1, 420, 8)])
    rows = features.future_status_target(df, horizon=1)
    assert one(rows)["future_bikes"] == 8
    timed = by_event(features.time_horizon_target(df), "future_bikes")
    assert timed == {1: None, 2: None}


def test_time_horizon_takes_the_first_reading_in_tolerance(spark):
    df = readings(spark, [(1, 1, 0, 9), (2, 1, 29, 8), (3, 1, 31, 2), (4, 1, 40, 7), (5, 2, 30, 1)])
    got = {r["event_id"]: (r["future_bikes"], r["will_be_empty"]) for r in features.time_horizon_target(df).collect()}
    assert got[1] == (2, 1)
    assert got[5] == (None, None)


def test_rows_without_a_future_are_dropped_not_labelled(spark):
    df = readings(spark, [(i, 1, 5 * i, i) for i in range(8)])
    rows = features.future_status_target(df).collect()
    assert sorted(r["event_id"] for r in rows) == [0, 1]


def test_delta_target_keeps_rows_without_a_future(spark):
    df = readings(spark, [(i, 1, 5 * i, i) for i in range(8)])
    kept = {r["event_id"]: (r["delta_next"], r["will_increase"]) for r in features.delta_target(df).collect()}
    assert kept[0] == (0.6, 1)
    assert kept[7] == (None, 0)
    assert features.delta_target(df, drop_no_future=True).count() == 2


def test_trend_features(spark):
    df = readings(spark, [(i, 1, 5 * i, b) for i, b in enumerate([2, 5, 4, 9])])
    got = {r["event_id"]: tuple(r)[1:] for r in features.trend_features(df).collect()}
    assert got[0] == (0.0, 0, 0)
    assert got[1] == (0.0, 3, 3)
    assert got[2] == (0.0, -1, -4)
    assert got[3] == (round(7 / 10.001, 6), 5, 6)


@pytest.mark.parametrize(
    ("code", "label"),
    [
        (0, "clear"), (1, "cloudy"), (3, "cloudy"), (4, "other"), (50, "other"), (51, "rain"), (67, "rain"),
        (68, "other"), (71, "snow"), (77, "snow"), (80, "showers"), (82, "showers"), (83, "other"), (95, "storm"),
        (99, "storm"), (-1, "cloudy"),
    ],
)
def test_weather_codes(spark, code, label):
    assert one(spark.range(1).select(C.weather_type(F.lit(code)).alias("w")))["w"] == label


def bands(spark, values, *args):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [r[0] for r in df.select(C.band(F.col("v"), *args)).collect()]


def test_bins_are_right_closed(spark):
    trend = bands(spark, [-0.2, -0.1, -0.02, 0.02, 0.1, 0.11], D.TREND_EDGES, D.TREND_LABELS, True)
    assert trend == ["bajada_fuerte", "bajada_fuerte", "bajada", "estable", "subida", "subida_fuerte"]
    priority = bands(spark, [0, 0.1, 40, 60, 100, 101], D.PRIORITY_EDGES, D.PRIORITY_LABELS)
    assert priority == [None, "Baja", "Baja", "Media", "Alta", None]
    income = bands(spark, [28000, 28001, 35000, 70000], D.INCOME_EDGES, D.INCOME_LABELS)
    assert income == ["Baja", "Media", "Media", "Alta"]


def test_rush_hour_variants(spark):
    hours = spark.range(24)
    pick = lambda ranges: [r["id"] for r in hours.where(C.in_ranges(F.col("id"), ranges) == 1).collect()]
    assert pick(D.RUSH_THREE_PEAKS) == [7, 8, 9, 14, 15, 16, 18, 19, 20]
    assert pick(D.RUSH_COMMUTE) == [7, 8, 9, 17, 18, 19]
    assert pick(D.RUSH_COMMUTE_LONG) == [7, 8, 9, 17, 18, 19, 20]
    assert [r["id"] for r in hours.where(~C.in_service(F.col("id"))).collect()] == [1, 2, 3, 4, 5, 6]


def test_zscore_of_a_constant_group_is_zero(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, 1.0), ("b", 4, 3.0), ("c", 5, 2.0)]
    df = spark.createDataFrame(rows, "city string, station_id bigint, temperature double").withColumn("ts", F.lit(START))
    got = {r["station_id"]: r["zscore"] for r in features.zscore_by_group(df).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: -0.707107, 4: 0.707107, 5: None}


def test_poorly_covered_optional_column_costs_no_rows(spark):
    rows = [(i, 1, None if i % 2 else 1.0, 2.0 if i else None) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id bigint, station_id bigint, opt double, need double").withColumn("ts", F.lit(START))
    kept = features.complete_cases(df, ["need"], "opt").collect()
    assert len(kept) == 9 and {r["opt"] for r in kept} == {None}
    strict = features.complete_cases(df, ["need"], "opt", min_coverage=0.4).collect()
    assert sorted(r["event_id"] for r in strict) == [2, 4, 6, 8]


def test_splits_partition_the_rows_in_time_order(spark):
    rows = [(i, i % 3, (i * 37) % 1000, 1) for i in range(100)]
    df = readings(spark, rows)
    split = features.with_time_split(df)
    assert split.count() == 100
    edges = split.groupBy("station_id").agg(
        F.max(F.when(F.col("split") == "train", F.struct("ts", "event_id"))).alias("last"),
        F.min(F.when(F.col("split") == "test", F.struct("ts", "event_id"))).alias("first"),
    )
    assert edges.where("last >= first").count() == 0


def test_repartitioning_changes_nothing(spark):
    df = readings(spark, [(i, i % 4, (i * 13) % 500, i % 11) for i in range(200)])
    key = lambda frame: sorted(map(tuple, frame.select("event_id", "delta").collect()))
    assert key(features.bike_delta(df)) == key(features.bike_delta(df.repartition(7, "bikes")))


def test_unified_features_keep_cities_apart(spark):
    rows = [("a", 1, 1, 0, 0.1), ("a", 1, 2, 5, 0.5), ("b", 1, 3, 2, 0.9), ("b", 1, 4, 7, 0.2)]
    df = spark.createDataFrame(
        [(c, s, e, START + timedelta(minutes=m), o, 10.0 + e) for c, s, e, m, o in rows],
        "city string, station_id bigint, event_id bigint, ts timestamp_ntz, occupancy double, temperature double",
    )
    got = {r["event_id"]: (r["delta_next"], r["will_increase"], r["will_decrease"]) for r in features.transfer_features(df, horizon=1).collect()}
    assert got == {1: (0.4, 1, 0), 2: (None, 0, 0), 3: (-0.7, 0, 1), 4: (None, 0, 0)}


def test_each_series_has_its_own_horizon(spark):
    """Stations look two rows ahead, the hourly city one, in one pass."""
    stations = [("a", 1, e, 5 * e, o) for e, o in enumerate((0.1, 0.2, 0.5, 0.9))]
    hourly = [("dc", None, None, 60 * h, o) for h, o in enumerate((0.3, 0.6, 0.1))]
    df = spark.createDataFrame(
        [(c, s, e, START + timedelta(minutes=m), o, 10.0) for c, s, e, m, o in stations + hourly],
        "city string, station_id bigint, event_id bigint, ts timestamp_ntz, occupancy double, temperature double",
    )
    rows = features.transfer_features(df, horizon=2).orderBy("city", "timestamp").collect()
    assert [r["delta_next"] for r in rows] == [0.4, 0.7, None, None, 0.3, -0.5, None]
    assert [r["delta_30min"] for r in rows] == [0.4, 0.7, None, None, None, None, None]
    assert [(r["will_increase"], r["will_decrease"]) for r in rows][4:] == [(1, 0), (0, 1), (0, 0)]


def test_occupancy_of_a_station_without_capacity(spark):
    df = spark.createDataFrame([(1, 3, 9, None), (2, 3, 3, 0), (3, 3, 3, 12)], "station_id bigint, bikes int, docks int, capacity int")
    got = [(r["capacity"], r["occupancy"]) for r in features.occupancy_ratio(df.withColumn("ts", F.lit(START))).orderBy("station_id").collect()]
    assert got == [(12, 0.25), (6, 0.5), (12, 0.25)]
