"""Snapshots by sweeping over spans, against a dense table of stations by frames."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fillgauge.operators import fleet, health, pairs, snapshots

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int, capacity int"


def readings(spark, rows):
    """rows: (station_id, seconds, bikes)."""
    full = [(i, s, None if t is None else START + timedelta(seconds=t), b, 10) for i, (s, t, b) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("docks", F.col("capacity") - F.col("bikes"))


def dense(rows, hold):
    """Every station's value in every frame, the slow way."""
    last = {}
    for i, (s, t, b) in enumerate(rows):
        if t is not None:
            f = t // 300
            if (s, f) not in last or last[s, f][:2] <= (t, i):
                last[s, f] = (t, i, b)
    frames = range(min(f for _, f in last), max(f for _, f in last) + 1)
    out = {}
    for f in frames:
        held = {}
        for s in {s for s, _ in last}:
            seen = [g for r, g in last if r == s and g <= f]
            if seen and (hold is None or f < max(seen) + hold):
                held[s] = last[s, max(seen)][2]
        out[f] = held
    return out


def states_of(spark, rows, hold, max_rows=1_000_000):
    at = snapshots.aligned(readings(spark, rows), values=["bikes", "capacity", "docks"], tie="event_id")
    spans = snapshots.spans(at, hold=hold, max_rows=max_rows)
    return spans, snapshots.states(spans, {"bikes": F.col("bikes"), "capacity": F.col("capacity")}, max_rows=max_rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(rng.choice((1, 1, 1, 2, 3, None)), rng.randrange(60 * 300), rng.randrange(11)) for _ in range(150)]
    return [*made, (2, None, 4), (3, 17, 1), (3, 17, 9)]


@pytest.mark.parametrize("hold", [None, 1, 5])
@pytest.mark.parametrize("max_rows", [1_000_000, 20])
def test_states_are_those_of_a_dense_table(spark, rows, hold, max_rows):
    _, states = states_of(spark, rows, hold, max_rows)
    want = dense(rows, hold)
    seen = set()
    for r in states.orderBy("ts").collect():
        first = int((r["ts"] - START).total_seconds()) // 300
        for f in range(first, first + r["frames"]):
            held = want[f]
            assert (r["present"], r["bikes"], r["capacity"]) == (len(held), sum(held.values()), 10 * len(held)), f
            seen.add(f)
    assert seen == set(want)


def test_denser_readings_change_the_snapshots(spark, rows):
    """A reading between two others, of the same day and station, moves the totals of the frames it holds for."""
    base = [(1, 0, 5), (2, 0, 5), (1, 3000, 7), (2, 3000, 5)]
    few, more = (states_of(spark, r, None)[1].collect() for r in (base, [*base, (1, 900, 0), (1, 1800, 9)]))
    assert [(r["bikes"], r["frames"]) for r in few] == [(10, 10), (12, 1)]
    assert [(r["bikes"], r["frames"]) for r in more] == [(10, 3), (5, 3), (14, 4), (12, 1)]
    used = [fleet.utilisation_of(states_of(spark, r, None)[1]).first()["bikes_mean"] for r in (base, [*base, (1, 900, 0), (1, 1800, 9)])]
    assert used == pytest.approx([112 / 11, (30 + 15 + 56 + 12) / 11], abs=1e-6)


def test_health_and_deficit_of_states(spark):
    rows = [(1, 0, 0), (2, 0, 9), (3, 600, 4), (1, 900, 6)]
    spans, _ = states_of(spark, rows, 4)
    got = [(int((r["ts"] - START).total_seconds()), r["total_stations"], r["empty_stations"], r["full_stations"], r["health_score"], r["frames"]) for r in health.health_states(spans).orderBy("ts").collect()]
    assert got == [(0, 2, 1, 1, 0.0, 2), (600, 3, 2, 1, 0.0, 1), (900, 3, 1, 1, 0.0, 1)]
    sums = {"bikes": F.col("bikes"), "capacity": F.col("capacity"), "short": F.greatest(F.lit(0), 2 - F.col("bikes"))}
    states = snapshots.states(spans, sums)
    worst = fleet.deficit_of(states, fleet.station_capacities(spans)).first()
    # at the start station 1 lacks two and station 3 is absent
    assert (worst["peak_deficit"], worst["worst_ts"], worst["fleet"], worst["docks"]) == (4, START, 19, 30)
    whole = snapshots.complete(states, F.lit(3)).select("ts")
    assert sorted(r["station_id"] for r in fleet.of_complete(spans, whole).collect()) == [1, 3]


def test_a_network_that_falls_silent_has_no_score(spark):
    """Both stations leave after a frame; one comes back much later."""
    spans, _ = states_of(spark, [(1, 0, 5), (2, 0, 5), (1, 3000, 5)], 1)
    got = [(r["total_stations"], r["health_score"], r["frames"]) for r in health.health_states(spans).orderBy("ts").collect()]
    assert got == [(2, 100.0, 1), (0, None, 9), (1, 100.0, 1)]


def test_no_readings_give_no_states(spark):
    spans, states = states_of(spark, [(1, None, 5)], None)
    assert spans.count() == 0 and states.count() == 0


def test_flows_of_frames_use_the_last_reading_of_each(spark):
    rng = random.Random(6)
    rows = []
    for f in range(60):
        move = rng.choice((-2, -1, 1, 2))
        rows += [(1, 300 * f, 0), (1, 300 * f + 200, 5 + move), (2, 300 * f + 100, 5 - move), (3, 300 * f, rng.randrange(9))]
    df = snapshots.aligned(readings(spark, rows), values=["bikes"], tie="event_id")
    assert df.count() == 180
    edges = pairs.infer_flows(df).collect()
    assert (edges[0]["from_id"], edges[0]["to_id"]) == (1, 2) and edges[0]["strength"] == pytest.approx(1, abs=1e-6)
