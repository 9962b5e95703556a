"""Sliced windows must equal plain windows, whatever the slice size."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fillgauge.operators.learners import model_frame
from fillgauge.operators.slices import SLICE, asof, asof_small, hot_keys, ranked, running_sums, shift, shift_by, slice_count, with_slice


@pytest.fixture(scope="module")
def readings(spark):
    """One station owns most rows, most of them within one hour."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        station = 1 if i % 3 else 2 + i % 5
        seconds = rng.randrange(3600) if i % 2 else rng.randrange(10 * 86400)
        rows.append((i, station, start + timedelta(seconds=seconds), rng.randrange(20)))
    return spark.createDataFrame(rows, "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int").cache()


def as_set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("max_rows", [9, 60, 1000])
def test_shift_equals_plain_window(readings, max_rows):
    w = Window.partitionBy("station_id").orderBy("ts", "event_id")
    plain = readings.select(
        "event_id",
        F.lag("bikes", 1).over(w).alias("prev"),
        F.lag("bikes", 3).over(w).alias("prev3"),
        F.lead("bikes", 6).over(w).alias("future"),
    )
    ours = shift(
        readings,
        "station_id",
        ["ts", "event_id"],
        {"prev": ("bikes", -1), "prev3": ("bikes", -3), "future": ("bikes", 6)},
        max_rows=max_rows,
    ).select("event_id", "prev", "prev3", "future")
    key = lambda r: r[0]
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


@pytest.mark.parametrize("max_rows", [12, 1000])
def test_ranked_equals_plain_window(readings, max_rows):
    w = Window.partitionBy("station_id").orderBy("ts", "event_id")
    plain = readings.select(
        "event_id", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("station_id"))
    )
    ours = ranked(readings, "station_id", ["ts", "event_id"], max_rows).select("event_id", "_rank", "_total")
    assert as_set(ours) == as_set(plain)


@pytest.fixture(scope="module")
def odd_readings(spark):
    """Null keys and times, a burst within a second, and many rows at one instant."""
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 10 == 0 else 1, None if i % 7 == 0 else start + timedelta(microseconds=i * 1000), i % 13) for i in range(400)]
    rows += [(i, 1, start + timedelta(days=1), i % 11) for i in range(400, 800)]
    return spark.createDataFrame(rows, "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int").cache()


@pytest.mark.parametrize("name", ["readings", "odd_readings"])
def test_every_slice_stays_small(request, name):
    rows = request.getfixturevalue(name)
    sliced = with_slice(rows, ["station_id", "ts", "event_id"], rows.count(), max_rows=50)
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert sum(sizes) == rows.count() and max(sizes) <= 100 and len(sizes) > 8


def test_slices_follow_the_cluster():
    assert slice_count(10**12, 10**6, 10_000) == 40_000
    assert slice_count(10**12, 10**6, 8) == 32
    assert slice_count(3 * 10**6, 10**6, 8) == 5
    assert slice_count(0, 10**6, 8) == 1


def test_only_hot_keys_are_sliced(readings, odd_readings):
    hot = hot_keys(readings, ["station_id"], 100)
    dense, others = hot.parts(readings)
    assert [r[0] for r in hot.table.collect()] == [1] and hot.rows == dense.count() == 400 and others.count() == 200
    # null is a key, and may be hot
    hot = hot_keys(odd_readings, ["station_id"], 30)
    assert hot.all and hot.parts(odd_readings)[1] is None and hot.rows == 800
    assert hot_keys(odd_readings, ["station_id"], 800) is None
    dense, others = hot_keys(odd_readings, ["station_id"], 40).parts(odd_readings)
    assert (dense.count(), others.where("station_id is null").count(), others.count()) == (760, 40, 40)


@pytest.mark.parametrize("max_rows", [40, 30, 10_000])
def test_offsets_of_their_own(odd_readings, max_rows):
    """Each row looks as many rows ahead as it says, also under a null key."""
    offset = F.col("event_id") % 4
    ours = shift_by(odd_readings, "station_id", ["ts", "event_id"], "bikes", offset, "then", max_rows=max_rows).select("event_id", "then")
    w = Window.partitionBy("station_id").orderBy("ts", "event_id")
    leads = [F.lead("bikes", k).over(w) for k in range(4)]
    plain = odd_readings.select("event_id", F.coalesce(*[F.when(offset == k, lead) for k, lead in enumerate(leads)]))
    key = lambda r: r[0]
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_no_row_is_lost_with_nulls_bursts_and_one_instant(odd_readings):
    order = ["ts", "event_id"]
    shifts = {"prev": ("bikes", -2), "next": ("bikes", 1)}
    for rank in (False, True):
        plain, sliced = (shift(odd_readings, "station_id", order, shifts, n, rank=rank).drop("ts") for n in (10_000, 50))
        assert sorted(map(str, sliced.collect())) == sorted(map(str, plain.select(sliced.columns).collect()))
    plain, sliced = (ranked(odd_readings, "station_id", order, n).drop("ts") for n in (10_000, 50))
    assert sorted(map(str, sliced.collect())) == sorted(map(str, plain.select(sliced.columns).collect()))
    left, right = odd_readings.where("event_id % 3 <> 0"), odd_readings.where("event_id % 3 = 0")
    for keys in ([], ["station_id"]):
        plain, sliced = (asof(left, right, "ts", "ts", ["event_id"], keys, "event_id", False, n) for n in (10_000, 50))
        assert sorted(map(str, sliced.collect())) == sorted(map(str, plain.select(sliced.columns).collect()))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("max_rows", [25, 10_000])
def test_asof_equals_brute_force(readings, forward, keyed, max_rows):
    left = readings.where("event_id % 4 <> 0")
    right = readings.where("event_id % 4 = 0")
    keys = ["station_id"] if keyed else []
    ours = asof(left, right, "ts", "ts", ["event_id"], keys, "event_id", forward, max_rows)
    check_asof(ours, left, right, keyed, forward)


def test_asof_with_a_small_side_equals_brute_force(readings):
    left = readings.where("event_id % 4 <> 0")
    right = readings.where("event_id % 4 = 0 and ts > timestamp_ntz'2024-01-01 00:05:00' and ts < timestamp_ntz'2024-01-08'")
    again = right.unionByName(right.limit(20).withColumn("event_id", F.col("event_id") + 1000))  # equal times
    ours = asof_small(left, again, "ts", "ts", ["event_id"], "event_id")
    assert ours.columns == [*left.columns, "_found"]
    check_asof(ours, left, again, False, False)
    assert asof_small(left, right, "ts", "ts", ["event_id"], "event_id", max_rows=10) is None
    assert asof_small(left, right.limit(0), "ts", "ts", ["event_id"], "event_id") is None


def check_asof(ours, left, right, keyed, forward):
    got = {r["event_id"]: r["_found"]["event_id"] if r["_found"] else None for r in ours.collect()}
    candidates = [r.asDict() for r in right.collect()]
    expected = {}
    for row in left.collect():
        pool = [c for c in candidates if not keyed or c["station_id"] == row["station_id"]]
        if forward:
            pool = [(c["ts"], c["event_id"]) for c in pool if c["ts"] >= row["ts"]]
            best = min(pool, default=None)
        else:
            pool = [(c["ts"], c["event_id"]) for c in pool if c["ts"] <= row["ts"]]
            best = max(pool, default=None)
        expected[row["event_id"]] = best[1] if best else None
    assert got == expected


@pytest.mark.parametrize("max_rows", [60, 1000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_plain_window(spark, descending, max_rows):
    df = spark.range(500).select((F.col("id") * 7 % 501).cast("double").alias("s"), F.col("id").alias("v"))
    order = F.col("s").desc() if descending else F.col("s")
    plain = df.select("s", F.sum("v").over(Window.orderBy(order)).alias("t"))
    ours = running_sums(df, "s", {"t": "v"}, descending, max_rows).select("s", "t")
    assert as_set(ours) == as_set(plain)


def test_a_hot_key_costs_few_scans(spark):
    """The plan behind the model frame reads written tables, not the input again."""
    start = datetime(2024, 1, 1)
    rows = [(i, i % 2, start + timedelta(minutes=i), i % 7, 7 - i % 7, 7) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int, docks int, capacity int")
    hot, plain = model_frame(df, max_rows=60), model_frame(df)
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3 and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.select(hot.columns).collect()))
