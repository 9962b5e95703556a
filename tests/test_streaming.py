"""Streams give what the batch jobs give, across restarts, replays and late rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fillgauge.functions import columns as C
from fillgauge.operators.features import bike_delta
from fillgauge.operators.health import snapshot_health
from fillgauge.plans import replay
from fillgauge.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int, docks int, capacity int"


def piece(spark, rows):
    full = [(i, s, START + timedelta(minutes=m), b, None if b is None else 10 - b, 10) for i, s, m, b in rows]
    return spark.createDataFrame(full, SCHEMA)


def result(spark, out):
    return spark.read.parquet(out)


@pytest.mark.parametrize("zero_is_missing", [False, True])
def test_deltas_cross_batches(spark, zero_is_missing):
    """Each piece restarts the query from its checkpoint, so the state outlives it."""
    rng = random.Random(1)
    rows = [(i, 1 if i % 2 else rng.randrange(5), 5 * i, rng.choice((None, 0, 3, 9))) for i in range(60)]
    pieces = [piece(spark, rng.sample(rows[a : a + 20], 20)) for a in (0, 20, 40)]

    def start(stream, out, checkpoint):
        return replay.to_parquet(lambda s: jobs.stream_delta(s, zero_is_missing=zero_is_missing))(stream, out, checkpoint)

    got = result(spark, replay.replay(spark, pieces, start, "t")).select("event_id", "delta", "abs_delta", "late").collect()
    expected = bike_delta(piece(spark, rows), zero_is_missing=zero_is_missing).select("event_id", "delta", "abs_delta", F.lit(0)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected)))


@pytest.mark.parametrize("zero_is_missing", [False, True])
def test_stations_share_a_bounded_number_of_states(spark, zero_is_missing):
    """Groups of stations change nothing: null stations, levels and tie-breakers and long ids included."""
    rng, long = random.Random(6), (1 << 53) + 1
    rows = [(long + i, rng.choice((None, *range(long, long + 25))), 5 * (i // 2), rng.choice((None, 0, 3, 9))) for i in range(240)]
    pieces = [piece(spark, rng.sample(rows[a : a + 80], 80)) for a in (0, 80, 160)]
    pieces.append(piece(spark, [(None, long, 5 * 120, 7)]))

    def start(stream, out, checkpoint):
        return replay.to_parquet(lambda s: jobs.stream_delta(s, zero_is_missing=zero_is_missing, groups=3))(stream, out, checkpoint)

    out = replay.replay(spark, pieces, start, "t")
    got = result(spark, out).where("event_id is not null").select("event_id", "station_id", "bikes", "delta", "abs_delta", "late").collect()
    whole = bike_delta(piece(spark, rows), zero_is_missing=zero_is_missing)
    expected = whole.select("event_id", "station_id", "bikes", "delta", "abs_delta", F.lit(0)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected)))
    alone = result(spark, out).where("event_id is null").collect()
    assert [(r["station_id"], r["bikes"], r["late"]) for r in alone] == [(long, 7, 0)]
    state = spark.read.format("statestore").load(f"{out.removesuffix('/out')}/checkpoint")
    assert 0 < state.count() <= 4


def test_batches_are_published_as_partitions(spark):
    pieces = [piece(spark, [(1, 1, 0, 5), (2, 2, 0, 5)]), piece(spark, [(3, 1, 5, 5)])]
    out = result(spark, replay.replay(spark, pieces, jobs.batch_sink, "t"))
    assert sorted((r["batch"], r["event_id"]) for r in out.collect()) == [(0, 1), (0, 2), (1, 3)]


def test_late_rows_change_nothing(spark):
    pieces = [piece(spark, [(1, 1, 0, 5), (2, 1, 10, 7)]), piece(spark, [(3, 1, 5, 0), (4, 1, 15, 6)])]
    path = replay.replay(spark, pieces, replay.delta_starter, "t")
    rows = result(spark, path)
    assert {r["event_id"]: r["delta"] for r in rows.where("late = 0").collect()} == {1: None, 2: 2, 4: -1}
    assert [(r["event_id"], r["bikes"], r["delta"]) for r in rows.where("late = 1").collect()] == [(3, 0, None)]


def test_rows_of_no_time_or_of_the_last_one_are_late(spark):
    pieces = [
        spark.createDataFrame([(1, 1, START, 5, 5, 10), (2, 1, None, 7, 5, 10), (3, None, START, 4, 5, 10)], SCHEMA),
        piece(spark, [(1, 1, 0, 5), (4, 1, 0, 9), (5, None, 5, 1)]),
    ]
    rows = result(spark, replay.replay(spark, pieces, replay.delta_starter, "t")).collect()
    assert sorted((r["event_id"], r["delta"]) for r in rows if not r["late"] and r["delta"] is not None) == [(4, 4), (5, -3)]
    assert sorted(r["event_id"] for r in rows if r["late"]) == [1, 2]


def test_replayed_poll_counts_once(spark):
    rows = [(1, 1, 0, 5), (2, 2, 0, 5), (3, 1, 5, 5)]
    pieces = [piece(spark, rows + rows), piece(spark, [(4, 1, 5, 5), (5, 1, 8, 5)])]
    out = result(spark, replay.replay(spark, pieces, replay.to_parquet(jobs.stream_dedup), "t"))
    got = sorted((r["station_id"], r["ts"].minute) for r in out.collect())
    assert got == [(1, 0), (1, 5), (1, 8), (2, 0)]


def test_health_windows_close_behind_the_watermark(spark):
    pieces = [
        piece(spark, [(1, 1, 0, 0), (2, 2, 1, 9), (3, 1, 40, 5)]),
        piece(spark, [(4, 2, 2, 5), (5, 1, 41, 5), (6, 1, 70, 5)]),  # the first is too late
    ]
    out = result(spark, replay.replay(spark, pieces, replay.to_parquet(jobs.stream_system_health), "t"))
    got = {r["ts"]: (r["total_stations"], r["empty_stations"], r["full_stations"], r["health_score"]) for r in out.collect()}
    assert got == {START: (2, 1, 1, 0.0), START + timedelta(minutes=40): (2, 0, 0, 100.0)}


def test_late_readings_correct_reported_windows(spark):
    """However the readings are dealt to batches, and though many come late, the totals are those of all of them at once."""
    rng = random.Random(3)
    rows = [(i, i % 7, 3 * i, rng.randrange(11)) for i in range(90)]
    whole = snapshot_health(piece(spark, rows).withColumn("ts", C.floor_time("ts", 300)))
    for cut in ((30, 60), (89, 90)):
        dealt = rng.sample(rows, len(rows))
        pieces = [piece(spark, dealt[a:b]) for a, b in zip((0, *cut), (*cut, 90)) if a < b]
        out = result(spark, replay.replay(spark, pieces, jobs.window_partials, "t"))
        got = jobs.window_totals(out).withColumn("ts", C.naive(F.col("ts"))).select(whole.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_hourly_activity_from_deltas(spark):
    pieces = [piece(spark, [(1, 1, 0, 5), (2, 1, 30, 2), (3, 1, 70, 6)]), piece(spark, [(4, 1, 200, 6)])]
    out = result(spark, replay.replay(spark, pieces, replay.chained(jobs.stream_hourly_activity), "t"))
    assert {r["hour_ts"]: r["activity"] for r in out.collect()} == {START: 3, START + timedelta(hours=1): 4}


def test_enrichment_drops_unknown_stations(spark):
    dimension = spark.createDataFrame([(1, "A", 10)], "station_id bigint, station_name string, capacity int")
    job = lambda s: jobs.stream_enrich(s, dimension)
    pieces = [piece(spark, [(1, 1, 480, 3), (2, 9, 480, 3)])]
    rows = result(spark, replay.replay(spark, pieces, replay.to_parquet(job), "t")).collect()
    assert len(rows) == 1
    assert (rows[0]["station_name"], rows[0]["is_rush_hour"], rows[0]["is_empty"], rows[0]["is_full"]) == ("A", 1, 1, 0)
