"""Feeds and files."""

from __future__ import annotations

import json
import os
import time
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fillgauge.session import PREFIX, lookup, shared_dir
from fillgauge.sources import cities, feeds, results, tracking

START = datetime(2024, 1, 1)


def documents(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")


def test_spanish_sheet_with_decimal_comma(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        "Timestamp;ID;Nombre;Lat;Capacidad;Bicis;Ocupación;Lluvia;Clima\n"
        "2026-01-27T08:00:00.000Z;7;Plaza;43,36;20;9;474;0,5;rain\n"
        "2026-01-27T08:05:00.000Z;7;Plaza;43,36;20;;450;;\n",
        encoding="utf-8",
    )
    rows = tracking.scan_tracking(spark, str(path), decimal=",", occupancy_scale=1000).orderBy("ts").collect()
    assert rows[0].asDict() == {
        "ts": datetime(2026, 1, 27, 8), "station_id": 7, "station_name": "Plaza", "lat": 43.36, "capacity": 20,
        "bikes": 9, "occupancy_raw": 0.474, "rain": 0.5, "weather_type": "rain",
    }
    assert rows[1]["bikes"] is None and rows[1]["rain"] is None


def test_separator_is_taken_from_the_header(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("timestamp,id,name,bicis,ocupacion\n2026-01-27 08:00:00,1,A,3,0.474\n")
    row = tracking.scan_tracking(spark, str(path)).first()
    assert (row["station_id"], row["bikes"], row["occupancy_raw"]) == (1, 3, 0.474)


def test_files_with_unlike_headers_are_read_by_their_own(spark, tmp_path):
    """Two exports of other column orders, one with a column more and another separator, an empty one, and a repeat of the first header."""
    folder = tmp_path / "the exports"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp,id,name,bicis,docks\n2026-01-01 00:00:00,1,A,3,7\n")
    (folder / "b.csv").write_text("id;docks;timestamp;bicis;temp\n2;6;2026-01-01 00:05:00;4;12.5\n")
    (folder / "c.csv").write_text("")
    (folder / "d.csv").write_text("timestamp,id,name,bicis,docks\n2026-01-01 00:10:00,3,C,5,5\n")
    rows = tracking.scan_tracking(spark, f"{folder}/*.csv").orderBy("station_id").collect()
    assert [(r["station_id"], r["bikes"], r["docks"], r["station_name"], r["temp"], r["ts"].minute) for r in rows] == [
        (1, 3, 7, "A", None, 0), (2, 4, 6, None, 12.5, 5), (3, 5, 5, "C", None, 10),
    ]
    assert sorted(map(len, tracking.headers(spark, str(folder)).values())) == [1, 2]
    assert tracking.scan_tracking(spark, str(folder)).count() == 3
    with pytest.raises(ValueError):
        tracking.scan_tracking(spark, f"{folder}/c.csv")


def test_a_result_is_replaced_whole_or_not_at_all(spark, tmp_path):
    root = f"{tmp_path}/result"
    one = spark.createDataFrame([(1, "é;x"), (2, None)], "id bigint, name string")
    two = spark.createDataFrame([(3, "y")], "id bigint, name string")
    broken = spark.range(5).select("id", F.when(F.col("id") < 4, "z").otherwise(F.raise_error(F.lit("killed"))).alias("name"))
    with pytest.raises(FileNotFoundError):
        results.read(spark, root, one.schema, "csv")
    for form in ("csv", "parquet"):
        at = f"{root}-{form}"
        results.publish(one, at, form)
        opened = results.read(spark, at, one.schema, form)
        with pytest.raises(Exception, match="killed"):
            results.publish(broken, at, form)
        assert sorted(map(tuple, results.read(spark, at, one.schema, form).collect())) == [(1, "é;x"), (2, None)]
        results.publish(two, at, form)
        # whoever had opened the old version still reads it whole
        assert opened.count() == 2
        assert [tuple(r) for r in results.read(spark, at, one.schema, form).collect()] == [(3, "y")]
        for _ in range(3):
            results.publish(two, at, form)
        kept = [p for p in os.listdir(at) if p.startswith("version-")]
        assert len(kept) == results.KEEP and results.current(spark, at).rsplit("/", 1)[1] == max(kept)
        assert not [p for p in os.listdir(at) if p.startswith("_pointer")]


def test_newest_file_wins(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text(f"timestamp,id\n2026-01-0{i + 1} 00:00:00,{i}\n")
        os.utime(tmp_path / name, (time.time() + i * 10,) * 2)
    assert tracking.scan_newest(spark, f"{tmp_path}/*.csv").first()["station_id"] == 1
    with pytest.raises(FileNotFoundError):
        tracking.scan_newest(spark, f"{tmp_path}/*.none")


def test_station_feeds(spark):
    info = documents(spark, {"data": {"stations": [
        {"station_id": "1", "name": "A", "lat": 1.5, "lon": 2.5, "capacity": None},
        {"station_id": "2", "name": "B", "lat": 1.0, "lon": 2.0, "capacity": 12, "extra": True},
    ]}})
    got = [tuple(r) for r in feeds.flatten_station_info(info).orderBy("station_id").collect()]
    assert got == [(1, "A", 1.5, 2.5, 0), (2, "B", 1.0, 2.0, 12)]
    status = documents(spark, {"data": {"stations": [{"station_id": "1", "num_bikes_available": 4}]}})
    assert tuple(feeds.flatten_station_status(status).first()) == (1, 4, 0)


def test_weather_without_current_yields_no_row(spark):
    docs = documents(spark, {"current": {"temperature_2m": 12.5, "weather_code": 61}}, {"error": True})
    assert [tuple(r) for r in feeds.parse_weather(docs).collect()] == [(12.5, 0.0, 0.0, 61)]


def test_centroids(spark):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    docs = documents(spark, {"features": [
        {"properties": {"OBJECTID": 1, "CAPA": "X"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"OBJECTID": 2}, "geometry": {"type": "MultiPolygon", "coordinates": []}},
    ]})
    got = {r["district_id"]: tuple(r)[1:] for r in feeds.polygon_centroids(docs).collect()}
    # the closing vertex counts, as in the mean over the ring
    assert got == {1: ("X", 0.8, 0.8), 2: ("Desconocido", None, None)}


def test_hourly_city(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 7), 8, 50, 3, 0.5, 0), (date(2024, 1, 8), 12, 100, 1, 0.2, 1)],
        "dteday date, hr int, cnt int, weathersit int, temp double, weekday int",
    )
    rows = cities.load_hourly_city(df).orderBy("ts").collect()
    sunday = rows[0]
    assert (sunday["ts"], sunday["day_of_week"], sunday["is_weekend"], sunday["is_rush_hour"]) == (datetime(2024, 1, 7, 8), 6, 1, 1)
    assert (sunday["is_raining"], sunday["occupancy"], sunday["temperature"]) == (1, 0.5, 15.5)
    assert rows[1]["is_weekend"] == 0 and rows[1]["day_of_week"] == 0


def test_station_city_from_epoch_seconds_and_files(spark, tmp_path):
    df = spark.createDataFrame([("3", 4, 6, 1704096000), ("4", 0, 0, 1704096000)], "STATION_ID string, Num_Bikes_Available int, num_docks_available int, last_reported bigint")
    got = {r["station_id"]: r for r in cities.load_station_city(df).collect()}
    assert got[3]["ts"] == datetime(2024, 1, 1, 8) and got[3]["capacity"] == 10 and got[3]["occupancy"] == 0.4
    assert got[4]["capacity"] is None and got[4]["occupancy"] == 0.0
    df.write.csv(f"{tmp_path}/pings", header=True)
    assert cities.load_station_city(cities.read_pings(spark, f"{tmp_path}/pings")).count() == 2
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/pings")
    assert cities.read_pings(spark, f"{tmp_path}/pings").count() == 1


def test_trips_pass_through(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert cities.load_trip_city(spark, f"{tmp_path}/t.jsonl").select("city").distinct().first()[0] == "madrid"


def test_cities_unite_with_nulls(spark, tmp_path):
    a = spark.createDataFrame([("a", 1, 2.0)], "city string, id bigint, temp double")
    b = spark.createDataFrame([("b", 2)], "city string, id bigint")
    united = cities.unify_cities(a, b, out=f"{tmp_path}/u")
    assert {r["city"]: r["temp"] for r in united.collect()} == {"a": 2.0, "b": None}
    assert sorted(p for p in os.listdir(f"{tmp_path}/u") if p.startswith("city=")) == ["city=a", "city=b"]


def frames_input(spark):
    rows = [(1, 0, 4), (1, 2, 6), (2, 1, 1), (1, 6, 3), (1500, 1, 2)]
    full = [(i, s, f"n{s}", START + timedelta(minutes=m), b, 10, 43.0, -8.0) for i, (s, m, b) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id bigint, station_id bigint, station_name string, ts timestamp_ntz, bikes int, capacity int, lat double, lon double")


def test_frames(spark, tmp_path):
    frames = tracking.export_frames(frames_input(spark))
    rows = {(r["frame_ts"], r["part"]): r for r in frames.collect()}
    head = rows[START, 0]
    assert (head["day"], head["date"], head["hour"], head["n_stations"], head["bikes_sum"]) == ("Lunes", "01/01", "00:00", 2, 6.0)
    assert [s["station_id"] for s in head["stations"]] == [1, 2] and head["stations"][0]["occupancy"] == 0.5
    assert rows[START, 1]["n_stations"] == 1
    tracking.write_frames(frames, f"{tmp_path}/frames")
    assert spark.read.json(f"{tmp_path}/frames").count() == 3


def test_published_table_is_sorted_within_files(spark, tmp_path):
    out = tracking.publish_tracking(frames_input(spark).repartition(3), f"{tmp_path}/p")
    assert out.count() == 5
    files = out.select(F.input_file_name().alias("f"), "station_id", "ts").collect()
    for f in {r["f"] for r in files}:
        keys = [(r["station_id"], r["ts"]) for r in files if r["f"] == f]
        assert keys == sorted(keys)


def test_shared_folder_is_the_sessions():
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/folder/"})
    assert shared_dir(session, "x").startswith(f"/shared/folder/{PREFIX}x-")
    assert shared_dir(session, "x") != shared_dir(session, "x")


def test_lookup_broadcasts_only_what_is_small(spark):
    big, small = spark.range(1000), spark.range(50).withColumn("v", F.lit(1))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(big.join(lookup(small, ["id"], 50), "id"))
    assert "strategy=broadcast" not in plan(big.join(lookup(small, ["id"], 49), "id"))
