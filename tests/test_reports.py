"""Aggregations, fleet, pairs, clusters, evaluation, growth and siting by hand."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fillgauge.operators import clusters, demand, distinct, enrich, evaluation, fleet, growth, health, learners, pairs, siting

START = datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def readings(spark, rows):
    """rows: (station_id, minutes, bikes[, capacity])."""
    full = [(i, r[0], START + timedelta(minutes=r[1]), r[2], r[3] if len(r) > 3 else 10) for i, r in enumerate(rows)]
    return frame(spark, full, "event_id bigint, station_id bigint, ts timestamp_ntz, bikes int, capacity int").withColumn(
        "docks", F.col("capacity") - F.col("bikes")
    )


def first(df):
    return df.first().asDict()


def test_absent_station_counts_into_the_deficit(spark):
    df = readings(spark, [(1, 0, 5), (2, 0, 1), (3, 0, 4), (1, 5, 0), (2, 5, 3)])
    got = first(fleet.fleet_deficit(df))
    # second snapshot: station 1 lacks 2, station 3 is absent and lacks 2
    assert (got["peak_deficit"], got["worst_ts"], got["fleet"], got["docks"]) == (4, START + timedelta(minutes=5), 10, 30)


def test_complete_snapshots(spark):
    df = readings(spark, [(1, 0, 5), (2, 0, 1), (1, 5, 0)])
    assert fleet.complete_snapshots(df, min_stations=2).count() == 2


def test_health_score_does_not_go_below_zero(spark):
    df = readings(spark, [(1, 0, 0), (2, 0, 1), (3, 0, 9)])
    assert first(health.snapshot_health(df))["health_score"] == 0.0


def test_station_mode_tie_takes_the_smallest(spark):
    df = readings(spark, [(1, 0, 10), (1, 5, 0), (1, 10, 10), (1, 15, 0), (2, 0, 10), (3, 0, 4)])
    got = {r["station_id"]: (r["mode_bikes"], r["state"]) for r in health.station_mode(df).collect()}
    assert got == {1: (0, "shortage"), 2: (10, "saturation"), 3: (4, "normal")}


def test_downtime_action(spark):
    df = readings(spark, [(1, i, 0 if i < 2 else 5) for i in range(10)] + [(2, i, 0 if i < 1 else 5) for i in range(10)])
    got = [(r["station_id"], r["downtime_pct"], r["action"]) for r in health.downtime_top(df).collect()]
    assert got == [(1, 20.0, "Ampliar Docks (+5)"), (2, 10.0, "Rebalanceo Prioritario")]


def test_sketches_add_up_over_days(spark):
    """Errors stay within the bound, few keys are exact, and no plan has a row for each key."""
    rows = spark.range(400_000).select(
        F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("station_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts")
    )
    days = distinct.daily_sketches(rows)
    found = {str(r["date"]): r for r in distinct.distinct_by_day(days).collect()}
    truth = {str(r[0]): r[1] for r in rows.groupBy(F.to_date("ts")).agg(F.count_distinct("station_id")).collect()}
    assert set(found) == set(truth) and all(found[d]["keys_of_day"] == pytest.approx(n, rel=0.05) for d, n in truth.items())
    total = rows.select("station_id").distinct().count()
    assert found[max(found)]["keys_so_far"] == pytest.approx(total, rel=0.05) == found[max(found)]["keys_of_month"]
    plan = health.system_overview(rows.withColumn("capacity", F.lit(1)), approx=True)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[station_id" not in plan and "hll_union_agg" in plan
    few = readings(spark, [(s, 1440 * d, 1) for d in range(4) for s in range(d, d + 30)] + [(None, 0, 1)])
    got = distinct.distinct_by_day(distinct.daily_sketches(few)).orderBy("date").collect()
    assert [(r["keys_of_day"], r["keys_so_far"], r["keys_of_month"]) for r in got] == [(30, 30 + d, 33) for d in range(4)]


def test_overview_and_report(spark):
    df = readings(spark, [(1, 0, 5), (1, 1500, 5), (2, 10, 4, 20)])
    got = first(health.system_overview(df))
    assert (got["days"], got["n_stations"], got["capacity_total"], got["obs_per_day"]) == (2, 2, 30, 1.5)
    assert first(health.system_overview(df, approx=True))["n_stations"] == 2
    long = health.report({"overview": health.system_overview(df).select("days", "n_obs")})
    assert sorted(map(tuple, long.collect())) == [("overview", "days", "2"), ("overview", "n_obs", "3")]


def test_cluster_scorecard_without_stockouts_is_zero(spark):
    df = readings(spark, [(1, 0, 5), (1, 5, 7), (2, 0, 1)])
    given = frame(spark, [(1, 0), (2, 1)], "station_id bigint, cluster int")
    got = {r["cluster"]: (r["bikes_std"], r["stockout_pct"]) for r in health.cluster_scorecard(df, given).collect()}
    assert got == {0: (1.414214, 0.0), 1: (None, 100.0)}


def test_constant_series_has_no_correlation(spark):
    df = readings(spark, [(1, 60 * i, i % 3) for i in range(6)]).withColumns(
        {"rain": F.lit(0.5), "wind": F.col("bikes").cast("double"), "temp": F.lit(None).cast("double")}
    )
    assert demand.weather_correlation(df.withColumn("temp", F.lit(1.0))).where("factor = 'rain'").first()["r"] is None
    assert demand.rain_occupancy_impact(df).count() == 0


def test_published_cost_figures(spark):
    """721 lost hours a week are 2 451 trips and about 102 thousand a year."""
    df = spark.range(721 * 12).select(F.lit(0).alias("bikes"))
    got = first(demand.stockout_roi(df))
    assert (got["hours_lost"], got["trips_lost"], got["value"], got["churners"]) == (721.0, 2451, 1960.8, 49)
    assert got["value_year_k"] == 101.9616


def test_shares_of_the_day(spark):
    df = readings(spark, [(1, 60 * i, (i * 7) % 10) for i in range(48)])
    rows = {r["band"]: r for r in demand.activity_by_band(df).collect()}
    assert set(rows) == {"night", "morning", "midday", "afternoon", "evening"}
    assert sum(rows[b]["share_pct"] for b in ("morning", "afternoon", "evening")) == pytest.approx(100, abs=1e-4)
    assert demand.stockout_heatmap(df).count() == 168


# --- pairs --------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "stretch": 7}])
def test_flows_equal_the_dense_matrix(spark, sizes):
    rng = random.Random(3)
    rows = [(s, 5 * t, rng.randrange(12)) for t in range(40) for s in range(9) if rng.random() < 0.8 or t == 0]
    df = readings(spark, rows)
    by = {(s, m): b for s, m, b in ((r[0], r[1], r[2]) for r in rows)}
    moves: dict[tuple[int, int], int] = {}
    for s in range(9):
        times = sorted(m for (x, m) in by if x == s)
        for a, b in zip(times, times[1:]):
            moves[s, b] = by[s, b] - by[s, a]
    times = sorted({m for _, m in moves})
    dense = np.array([[moves.get((s, m), 0) for m in times] for s in range(9)])
    r = np.corrcoef(dense)
    expected = {(a, b): round(-r[a, b], 6) for a in range(9) for b in range(a + 1, 9) if r[a, b] < -0.15}
    got = {(x["from_id"], x["to_id"]): x["strength"] for x in pairs.infer_flows(df, **sizes).collect()}
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k], abs=2e-6) for k in got)


@pytest.mark.parametrize("present_only", [True, False])
def test_only_wanted_pairs_leave_and_sums_are_whole(spark, present_only):
    """Many stretches, several blocks, stations silent for long; against sums over all pairs."""
    rng = random.Random(21)
    values = {(s, t): rng.randrange(1, 9) for s in range(14) for t in range(60) if (t // 20 != s % 3) and rng.random() < 0.7}
    df = frame(spark, [(s, t, v) for (s, t), v in values.items()], "s bigint, t bigint, v bigint")
    expected = {}
    for a in range(14):
        for b in range(a + 1, 14):
            times = [t for t in range(60) if not present_only or ((a, t) in values and (b, t) in values)]
            x, y = (np.array([values.get((k, t), 0) for t in times], dtype="int64") for k in (a, b))
            n = len(times) if present_only else 0
            expected[a, b] = (n, *(int(z) for z in (x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())))
    for block, stretch in ((512, 7), (4, 7), (3, 1000)):
        for keep in (None, lambda n, sx, sy, sxx, syy, sxy: sxy > 300):
            rows = pairs.pair_moments(df, 14, 60, present_only=present_only, keep=keep, block=block, stretch=stretch).collect()
            got = {(r["a"], r["b"]): tuple(r[c] for c in pairs.MOMENTS) for r in rows}
            assert len(got) == len(rows)
            assert got == {k: v for k, v in expected.items() if keep is None or v[5] > 300}


def test_only_the_best_of_each_two_blocks_leave(spark):
    """Ties, constant series and copies; the best of all are the same whether few or all pairs leave."""
    rng = random.Random(22)
    series = [[rng.randrange(3) for _ in range(8)] for _ in range(12)] + [[1] * 8]
    df = frame(spark, [(s, t, series[s % 13][t]) for s in range(60) for t in range(8) if (s + t) % 5], "s bigint, t bigint, v bigint")
    sums = dict(present_only=True, keep=lambda n, *_: n >= 4, block=15, stretch=5)
    r = pairs.r6(pairs.exact_pearson(F.col("n")))
    every = sorted((x["r"], x["a"], x["b"]) for x in pairs.pair_moments(df, 60, 8, **sums).withColumn("r", r).where("r is not null").collect())
    few = pairs.pair_moments(df, 60, 8, best=pairs.best_few(7, -0.5, 0.5, 4), **sums).withColumn("r", r).collect()
    got = sorted((x["r"], x["a"], x["b"]) for x in few)
    assert got[:7] == every[:7] and every[6][0] < -0.5
    up = lambda x: (-x[0], *x[1:])
    assert sorted(got, key=up)[:7] == sorted(every, key=up)[:7] and len(got) <= 14 * 10 < len(every)


def test_distances_of_blocks_are_exact(spark):
    """Profiles that are equal or almost so, far from the origin; and blocks of a few stations as one block."""
    p = np.random.default_rng(1).random((40, 24)) + 100
    p[20:30] = p[:10]
    p[30:] = p[:10] + 1e-7
    want = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    assert np.abs(clusters.distances(p, p) - want).max() < 1e-9
    df = readings(spark, [(s, 60 * h, (h * s) % 9) for s in range(11) for h in range(24)])
    given = df.select("station_id").distinct().select("station_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    given = given.withColumn("cluster", F.col("station_id") % F.col("k"))
    rows = [sorted(map(tuple, clusters.silhouette_pick(df, given, block=b).collect())) for b in (100, 3, 1)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 2


def test_station_names_serve_as_keys(spark):
    df = readings(spark, [(s, 60 * h, (h * (s + 1)) % 7 if s < 2 else 9 - (h * 2) % 7) for s in range(3) for h in range(20)])
    named = df.withColumn("name", F.concat(F.lit("n"), "station_id"))
    by_id = [(f"n{r['a']}", f"n{r['b']}", r["r"]) for r in pairs.twin_stations(df).collect()]
    assert [tuple(r) for r in pairs.twin_stations(named, key="name").select("a", "b", "r").collect()] == by_id and by_id
    flows = [(f"n{r['from_id']}", r["strength"]) for r in pairs.infer_flows(df).collect()]
    assert [(r["from_id"], r["strength"]) for r in pairs.infer_flows(named, key="name").collect()] == flows and flows
    given = named.select("name").distinct().select("name", F.lit(2).alias("k"), F.length("name").alias("cluster"))
    assert clusters.silhouette_pick(named, given, key="name").count() == 1


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "stretch": 5}])
def test_twins_equal_pairwise_complete_correlation(spark, sizes):
    rng = random.Random(5)
    base = [rng.random() for _ in range(24)]
    rows = []
    for s in range(6):
        for h in range(24):
            if rng.random() < 0.85:
                level = base[h] if s % 2 else 1 - base[h]
                rows.append((s, 60 * h, int(100 * level + rng.randrange(3)), 100))
    df = readings(spark, rows)
    values = {(s, m): b / 100 for s, m, b, _ in rows}
    expected = {}
    for a in range(6):
        for b in range(a + 1, 6):
            both = [h * 60 for h in range(24) if (a, h * 60) in values and (b, h * 60) in values]
            r = np.corrcoef([values[a, m] for m in both], [values[b, m] for m in both])[0, 1]
            if r < -0.6 or r > 0.95:
                expected[a, b] = (round(r, 6), len(both))
    got = {(x["a"], x["b"]): (x["r"], x["n_hours"]) for x in pairs.twin_stations(df, **sizes).collect()}
    assert set(got) == set(expected) and len(got) > 6
    for k in got:
        assert got[k][0] == pytest.approx(expected[k][0], abs=1e-5) and got[k][1] == expected[k][1]


def test_radius_counts_equal_brute_force(spark):
    rng = random.Random(11)
    stations = [(i, 43.3 + rng.random() / 50, -8.4 + rng.random() / 50) for i in range(80)] + [(100 + i, 43.31, -8.39) for i in range(20)]
    points = [(i, 43.3 + rng.random() / 50, -8.4 + rng.random() / 50) for i in range(30)]
    got = {
        r["point_id"]: r["n_stations"]
        for r in enrich.coverage_radius(
            frame(spark, points, "point_id bigint, lat double, lon double"),
            frame(spark, stations, "station_id bigint, lat double, lon double"),
        ).collect()
    }

    def metres(a, b):
        p, q = np.radians(a), np.radians(b)
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.sqrt(h))

    for i, lat, lon in points:
        assert got[i] == sum(metres((lat, lon), (a, b)) <= 500 for _, a, b in stations)


def test_radius_holds_near_the_pole_and_across_the_date_line(spark):
    stations = [(1, 85.0, 10.04), (2, -17.0, -179.9999), (3, 89.9999, -90.0)]
    points = [(1, 85.0, 10.0), (2, -17.0, 179.9999), (3, 89.9999, 90.0), (4, 0.0, 0.0)]
    got = enrich.coverage_radius(
        frame(spark, points, "point_id bigint, lat double, lon double"),
        frame(spark, stations, "station_id bigint, lat double, lon double"),
    )
    assert {r["point_id"]: r["n_stations"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


# --- clusters -----------------------------------------------------------------


def profiles(spark, levels):
    """One reading per hour; levels: station -> 24 bike counts of 100."""
    return readings(spark, [(s, 60 * h, hours[h], 100) for s, hours in levels.items() for h in range(24)])


@pytest.mark.parametrize("block", [256, 3])
def test_silhouette_equals_direct_distances(spark, block):
    rng = random.Random(2)
    levels = {s: [rng.randrange(100) if s % 3 else rng.randrange(30) for _ in range(24)] for s in range(10)}
    df = profiles(spark, levels)
    groups = [(s, k, s % k if s else k) for s in levels for k in (2, 3)]  # station 0 sits alone
    got = {r["k"]: r["silhouette"] for r in clusters.silhouette_pick(df, frame(spark, groups, "station_id bigint, k int, cluster int"), block=block).collect()}
    x = {s: np.array(v) / 100 for s, v in levels.items()}
    for k in (2, 3):
        label = {s: c for s, kk, c in groups if kk == k}
        scores = []
        for s in x:
            mean = lambda c: np.mean([np.linalg.norm(x[s] - x[o]) for o in x if o != s and label[o] == c])
            others = [o for o in x if o != s and label[o] == label[s]]
            if not others:
                scores.append(0.0)
                continue
            a, b = mean(label[s]), min(mean(c) for c in set(label.values()) - {label[s]})
            scores.append((b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(scores), abs=1e-6)


def test_clusters_recover_planted_groups(spark):
    rng = random.Random(4)
    peak = lambda s, h: 80 if abs(h - (4 + 6 * (s % 3))) <= 2 else 10
    df = profiles(spark, {s: [peak(s, h) + rng.randrange(5) for h in range(24)] for s in range(24)})
    found = {r["station_id"]: r["cluster"] for r in clusters.cluster_stations(df, k=3, restarts=4).collect()}
    assert len({(s % 3, c) for s, c in found.items()}) == 3
    assert found[0] == 0  # equal sizes: the lowest member names the cluster
    curve = clusters.elbow_curve(df, ks=range(2, 6), restarts=3)
    inertia = [r["inertia"] for r in curve.orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    assert clusters.elbow_pick(curve).first()["k"] == 3


def test_elbow_of_a_straight_line_falls_back(spark):
    curve = frame(spark, [(k, 100.0 - 10 * k) for k in range(2, 7)], "k int, inertia double")
    assert clusters.elbow_pick(curve).first()["k"] == 3


def test_archetype_rules_in_order(spark):
    day = lambda m, d, e: [m if 7 <= h <= 9 else d if 13 <= h <= 15 else e if 17 <= h <= 19 else 0 for h in range(24)]
    df = profiles(spark, {1: day(10, 50, 60), 2: day(60, 20, 30), 3: day(30, 90, 30), 4: day(30, 20, 30)})
    given = frame(spark, [(s, s) for s in range(1, 5)], "station_id bigint, cluster int")
    got = {r["cluster"]: r["label"].split("/")[0].split(" ")[0] for r in clusters.cluster_archetypes(df, given).collect()}
    assert got == {1: "RESIDENCIAL", 2: "TRABAJO", 3: "OCIO", 4: "MIXTO"}


# --- evaluation ---------------------------------------------------------------


def scores(spark, rows):
    return frame(spark, rows, "label int, score double")


def test_metrics_are_zero_where_undefined(spark):
    one_class = scores(spark, [(0, 0.1), (0, 0.2)])
    got = first(evaluation.classification_metrics(one_class))
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert first(evaluation.roc_auc(one_class))["roc_auc"] is None
    assert evaluation.threshold_sweep(one_class).where("is_best = 1").count() == 0


def test_threshold_is_strict(spark):
    assert first(evaluation.classification_metrics(scores(spark, [(1, 0.6), (1, 0.61)])))["tp"] == 1


def test_equal_scores_give_half(spark):
    assert first(evaluation.roc_auc(scores(spark, [(0, 0.5), (1, 0.5), (0, 0.5)])))["roc_auc"] == 0.5


def test_auc_and_average_precision_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(300)]
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert first(evaluation.roc_auc(scores(spark, rows)))["roc_auc"] == pytest.approx(auc, abs=1e-6)
    ap, before = 0.0, 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        chosen = [l for l, s in rows if s >= cut]
        recall = sum(chosen) / len(pos)
        ap += (recall - before) * sum(chosen) / len(chosen)
        before = recall
    assert first(evaluation.average_precision(scores(spark, rows)))["average_precision"] == pytest.approx(ap, abs=1e-6)


def test_regression_metrics(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 0.0, 1.0)], "g string, y double, p double")
    got = {r["group"]: r for r in evaluation.regression_metrics(df, y="y", pred="p", group=F.col("g"), min_rows=2).collect()}
    assert set(got) == {"all", "a"}
    assert got["a"]["rmse"] == round(0.5**0.5, 6) and got["a"]["mape"] == 50.0 and got["a"]["r2"] == 0.5
    assert got["all"]["mape"] == 50.0  # the zero target has no relative error


def test_learner_beats_persistence_on_a_planted_signal(spark):
    """Twenty stations are empty exactly from 8 to 10 o'clock."""
    rows = [
        (s, 30 * i, 0 if (i // 2) % 24 in (8, 9, 10) else 8 + (s + i) % 3, 20) for s in range(20) for i in range(500)
    ]
    df = readings(spark, rows)
    learned = first(learners.train_classifier(df, features=learners.SHARED_FEATURES, rounds=10))
    naive = first(evaluation.persistence_baseline(df))
    assert learned["f1"] > naive["f1"] and learned["f1"] > 0.9
    assert learned["roc_auc"] > 0.95 and learned["n_test"] == naive["n"]


def test_boosting_goes_on_until_patience_ends_it(spark):
    """A smooth signal under noise: one tree is not enough, and stopping early must not cost quality."""
    rng = random.Random(5)
    rows = []
    for i in range(8000):
        x = [rng.random() for _ in range(4)]
        chance = 1 / (1 + np.exp(1 - 4 * x[0] + 3 * x[1] - 3 * np.sin(6 * x[2])))
        rows.append((*x, int(rng.random() < chance), ("train", "valid", "test")[0 if i < 4500 else 1 if i < 6000 else 2]))
    frame_ = spark.createDataFrame(rows, "a double, b double, c double, d double, t int, part string").coalesce(1).cache()
    test = frame_.where("part = 'test'")
    stopped = learners.fit_classifier(frame_, "t", ["a", "b", "c", "d"], 30, 1, patience=10)
    whole = learners.fit_classifier(frame_.where("part <> 'valid'"), "t", ["a", "b", "c", "d"], 30, 1)
    found = [evaluation.roc_auc(learners.class_scores(m, test, "t")).first()[0] for m in (stopped, whole)]
    assert learners.tree_count(stopped) > 10 and learners.tree_count(whole) == 30
    assert found[0] >= found[1] - 0.005


def test_the_best_round_is_kept():
    losses = [abs(n - 90) for n in range(1, 501)]
    assert learners.best_round(losses, 50) == 90
    assert learners.best_round(losses[:70], 50) == 70
    assert learners.best_round([3, 2, 2, 2, 1], 2) == 2  # patience ends before the last
    assert learners.best_round([3, 2, 2, 2, 1], 3) == 5


def test_boosting_repeats_few_rounds(monkeypatch):
    """The round kept is that of one fit of all rounds; what is grown beyond it stays small."""
    monkeypatch.setattr(learners, "first_trees", lambda _, n: n)
    monkeypatch.setattr(learners, "tree_count", lambda model: model)

    class Rows:
        def isEmpty(self):
            return False

    def grown(losses):
        fits = []
        kept = learners.stopped(lambda n: fits.append(n) or n, Rows(), lambda n, _: losses[:n], 500, 50)
        assert kept == learners.best_round(losses, 50)
        return fits

    assert grown([abs(n - 16) for n in range(500)]) == [80]
    assert sum(grown([abs(n - 44) for n in range(500)])) == 80 + 95
    assert sum(grown([abs(n - 119) for n in range(500)])) == 80 + 160 + 170
    assert sum(grown([-n for n in range(500)])) == 80 + 160 + 320 + 500
    rng = random.Random(4)
    for _ in range(200):
        grown([abs(n - rng.randrange(1, 600)) + rng.randrange(200) for n in range(500)])


def test_a_cut_ensemble_is_a_shorter_fit(spark):
    rng = random.Random(8)
    rows = [(i, *(rng.random() for _ in range(3)), "train") for i in range(600)]
    frame_ = spark.createDataFrame(rows, "event_id bigint, a double, b double, c double, part string").coalesce(1)
    frame_ = frame_.withColumns({"t": (F.col("a") + F.col("b") > 1).cast("int"), "delta_next": F.col("a") * F.col("b")}).cache()
    for fit in (
        lambda n: learners.fit_classifier(frame_, "t", ["a", "b", "c"], n, 1),
        lambda n: learners.fit_regressor(frame_, ["a", "b", "c"], n, 1, patience=100),
    ):
        cut, short = learners.first_trees(fit(12), 5), fit(5)
        assert learners.tree_count(cut) == learners.tree_count(short) == 5
        got, want = ([r["prediction"] for r in m.transform(frame_).orderBy("event_id").collect()] for m in (cut, short))
        assert got == pytest.approx(want, abs=1e-12)


def test_a_regression_grows_over_bounded_cells(spark, monkeypatch):
    """More rows of the same values make the cells heavier, not more; every row that is not tested on counts."""
    found = []
    real = learners.cells
    monkeypatch.setattr(learners, "cells", lambda *args: found.append(real(*args)) or found[-1])
    monkeypatch.setattr(learners, "FEW_ROWS", 1000)
    for n in (2000, 40000):
        ids = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("a"), (F.col("id") % 97 / 97).alias("b"))
        frame_ = ids.withColumn("delta_next", F.when(F.col("event_id") % 11 > 0, F.col("a") * F.col("b") + F.sin("event_id")))
        learners.fit_regressor(frame_, ["a", "b"], 2, 1)
        used = frame_.where("delta_next IS NOT NULL").withColumn("part", learners.regression_part()).where("part <> 'val'")
        assert found[-1].agg(F.sum("weight")).first()[0] == used.count() > 0.7 * n
        assert {r["part"] for r in found[-1].select("part").distinct().collect()} == {"train", "stop"}
    assert [f.count() <= 2 * 7 * learners.BINS for f in found] == [True, True]
    monkeypatch.undo()
    learners.fit_regressor(frame_, ["a", "b"], 2, 1)
    assert len(found) == 2  # few rows stand for themselves


def test_cells_give_the_trees_and_losses_of_their_rows(spark):
    """Without drawing of rows, whose order differs, both fits are one."""
    rng = random.Random(12)
    rows = [(rng.choice((0.0, 0.0, 0.0, rng.expovariate(1))), rng.randrange(24), rng.random(), rng.choice(("train", "stop"))) for _ in range(6000)]
    frame_ = spark.createDataFrame(rows, "a double, b int, c double, part string").coalesce(1)
    frame_ = frame_.withColumn("y", F.sin("b") * F.col("c") + F.col("a") + F.pmod(F.hash("c"), F.lit(100)) / 100).cache()
    names = ["a", "b", "c"]
    bins = learners.feature_bins(frame_.where("part = 'train'"), names)
    assemble = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    whole = assemble.transform(bins.transform(frame_).withColumn("weight", F.lit(1.0)))
    grouped = assemble.transform(learners.cells(frame_, bins, "y"))
    assert grouped.count() < whole.count()
    boosted = GBTRegressor(labelCol="y", weightCol="weight", maxIter=6, maxDepth=4, stepSize=0.3, seed=1)
    models = [boosted.fit(rows_.where("part = 'train'")) for rows_ in (whole, grouped)]
    got, want = ([r["prediction"] for r in m.transform(whole).select("prediction").collect()] for m in models)
    assert got == pytest.approx(want, abs=1e-9)
    by_row, by_cell = (np.array(models[0].evaluateEachIteration(rows_.where("part = 'stop'"), "squared")) for rows_ in (whole, grouped))
    assert by_row - by_row[0] == pytest.approx(by_cell - by_cell[0], abs=1e-9) and len(by_row) == 6


def test_predictions_of_cells_are_those_of_their_rows(spark, monkeypatch):
    """Also of rows that repeat an id or hold values that no bin was made for; incomplete rows are left out."""
    ids = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 50 / 7).alias("a"), (F.col("id") % 3).cast("int").alias("b"))
    frame_ = ids.withColumn("delta_next", F.sin("a") * F.col("b"))
    model = learners.fit_regressor(frame_, ["a", "b"], 3, 1)
    more = spark.createDataFrame([(1, -9.0, 7), (1, 99.0, 0), (2, None, 1)], "event_id bigint, a double, b int").withColumn("delta_next", F.lit(0.0))
    rows = frame_.unionByName(frame_.limit(40)).unionByName(more)
    want = sorted(tuple(r) for r in learners.score_and_label(model, rows, ["a", "b"]).collect())
    monkeypatch.setattr(learners, "FEW_ROWS", 10)
    found = []
    real = learners.materialise
    monkeypatch.setattr(learners, "materialise", lambda df, purpose: found.append(real(df, purpose)) or found[-1])
    got = sorted(tuple(r) for r in learners.score_and_label(model, rows, ["a", "b"]).collect())
    assert got == want and len(got) == 642 and found[0].count() < 110


def test_bins_of_features(spark):
    rows = [(float(i % 32), 0.0 if i % 10 else i / 1000, 5.0, None if i % 2 else float(i)) for i in range(10000)]
    frame_ = spark.createDataFrame(rows, "few double, heavy double, same double, holes double")
    bins = learners.feature_bins(frame_, ["few", "heavy", "same", "holes"])
    binned = bins.transform(frame_.where("holes IS NOT NULL"))
    sizes = {c: {r[f"{c}_bin"]: r["count"] for r in binned.groupBy(f"{c}_bin").count().collect()} for c in ("few", "heavy", "same", "holes")}
    assert len(bins.transform(frame_.drop("holes").withColumn("holes", F.lit(0.0))).select("few", "few_bin").distinct().collect()) == 32
    # a value that most rows have is one bin and leaves the others their shares
    assert 25 <= len(sizes["heavy"]) <= learners.BINS and len(sizes["same"]) == 1
    assert 25 <= len(sizes["holes"]) <= learners.BINS and max(sizes["holes"].values()) < 5000 / 20


def test_a_fit_that_80_rounds_do_not_settle_is_grown_at_once(monkeypatch):
    monkeypatch.setattr(learners, "first_trees", lambda _, n: n)
    monkeypatch.setattr(learners, "tree_count", lambda model: model)

    class Rows:
        def isEmpty(self):
            return False

    for losses, want in (
        ([-n for n in range(500)], [80, 500]),
        ([abs(n - 16) for n in range(500)], [80]),
        ([abs(n - 44) for n in range(500)], [80, 95]),
    ):
        fits = []
        kept = learners.stopped(lambda n: fits.append(n) or n, Rows(), lambda n, _: losses[:n], 500, 50, growth=500)
        assert fits == want and kept == learners.best_round(losses, 50)


def test_a_regression_confirms_its_best_round_before_it_grows_in_full(spark, monkeypatch):
    """A best round that lies only a few rounds back asks for those that confirm it, not for all."""
    real, policy = learners.stopped, {}
    monkeypatch.setattr(learners, "stopped", lambda fit, valid, score, rounds, patience, **more: policy.update(more))
    frame_ = spark.range(100).selectExpr("id as event_id", "id % 5 as a", "double(id % 3) as delta_next")
    learners.fit_regressor(frame_, ["a"], 500, 1)
    monkeypatch.setattr(learners, "first_trees", lambda _, n: n)
    monkeypatch.setattr(learners, "tree_count", lambda model: model)

    class Rows:
        def isEmpty(self):
            return False

    for losses, want in (
        ([abs(n - 55) for n in range(500)], [80, 106]),
        ([abs(n - 69) for n in range(500)], [80, 120]),
        ([abs(n - 70) for n in range(500)], [80, 500]),
        ([-n for n in range(500)], [80, 500]),
        # the confirming rounds find a better one: the rest is grown at once
        ([min(abs(n - 55), 100 - n) for n in range(500)], [80, 106, 500]),
    ):
        fits = []
        kept = real(lambda n: fits.append(n) or n, Rows(), lambda n, _: losses[:n], 500, 50, **policy)
        assert fits == want and kept == learners.best_round(losses, 50)


def test_a_transferred_regression_beats_both_its_parents(spark):
    """The local city follows the other one with a shift of its own, and has few events."""
    rng = random.Random(9)

    def city(n, shift):
        rows = []
        for i in range(n):
            hour, occ = rng.randrange(24), rng.random()
            y = 0.3 * np.sin(hour / 24 * 2 * np.pi) + 0.4 * (0.5 - occ) * (hour % 7) / 6 + shift * (hour >= 12) + rng.gauss(0, 0.02)
            rows.append((i, float(np.sin(2 * np.pi * hour / 24)), float(np.cos(2 * np.pi * hour / 24)), occ, float(y)))
        return spark.createDataFrame(rows, "event_id bigint, hour_sin double, hour_cos double, occupancy double, delta_next double").coalesce(1).cache()

    names = ["hour_sin", "hour_cos", "occupancy"]
    source, local = city(6000, 0.0), city(300, 0.15)
    pretrained = learners.fit_regressor(source, names, 150, 1)
    models = [learners.fit_regressor(local, names, 150, 1), pretrained, learners.continued(pretrained, local, names, 150, 1, step=0.05)]
    test = city(2000, 0.15)
    rmse = [first(evaluation.regression_metrics(m.transform(test), y="delta_next", pred="prediction"))["rmse"] for m in models]
    assert rmse[2] < 0.9 * rmse[0] and rmse[2] < 0.5 * rmse[1]
    # the sum is one model: what its trees predict together
    parts = models[2].stages[-1]
    assert len(parts.treeWeights) == learners.tree_count(models[2]) > learners.tree_count(pretrained)


def test_definitions_are_compared_by_models(spark):
    rows = [(s, 30 * i, 0 if (i // 2) % 24 in (8, 9, 10) else 8 + (s + i) % 3, 20) for s in range(6) for i in range(300)]
    df = readings(spark, rows)
    future = F.col("future_bikes")
    found = learners.definition_sweep(
        df, {"below 5": future < 5, "never": future < 0}, {"below 5": F.col("bikes") < 5, "never": F.col("bikes") < 0},
        features=learners.SHARED_FEATURES, rounds=10,
    )
    got = {r["definition"]: r for r in found.collect()}
    assert got["below 5"]["f1"] > max(0.9, got["below 5"]["persistence_f1"]) and 10 < got["below 5"]["pct_empty"] < 15
    assert got["never"]["f1"] == got["never"]["pct_empty"] == 0


def test_regressor_labels_importance_and_published_model(spark, tmp_path):
    rows = [(s, 60 * i, 2 + 6 * (i % 2), 10) for s in range(4) for i in range(60)]
    df = readings(spark, rows).withColumns({"rain": F.lit(0.0), "temp": F.lit(10.0)})
    frame_ = learners.delta_frame(df, horizon=1)
    model = learners.fit_regressor(frame_, rounds=15)
    labels = {r["trend"] for r in learners.score_and_label(model, frame_).collect()}
    assert labels == {"bajada_fuerte", "subida_fuerte"}
    ranks = learners.feature_importance(model, spark).orderBy("rank").collect()
    assert ranks[0]["feature"] == "occupancy" and sum(r["importance"] for r in ranks) == pytest.approx(1, abs=1e-4)
    quality = learners.train_delta_regressor(df, rounds=15, horizon=1)
    assert {r["split"]: r["r2"] > 0.5 for r in quality.collect()} == {"train": True, "val": True}
    assert quality.first()["n_trees"] > 1
    learners.publish_model(model, quality, f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m/model")
    assert learners.score_and_label(again, frame_).exceptAll(learners.score_and_label(model, frame_)).count() == 0
    assert spark.read.parquet(f"{tmp_path}/m/metrics").count() == 2


# --- growth and siting ----------------------------------------------------------

# Public yearly figures of a bike-share system: year, month, active users, uses, uses per user, growth %.
HISTORY = [
    (2009, 7, 500, 2000, 4.0, None),
    (2010, 12, 800, 15000, 18.8, 60.0),
    (2015, 12, 1500, 45000, 30.0, 87.5),
    (2020, 12, 2000, 60000, 30.0, 33.333333),
    (2021, 12, 2200, 75000, 34.1, 10.0),
    (2022, 6, 2673, 90000, 33.7, 21.5),
    (2022, 12, 8500, 450000, 52.9, 217.994762),
    (2023, 6, 12000, 650000, 54.2, 41.176471),
    (2023, 12, 13669, 1200000, 87.8, 13.908333),
    (2024, 6, 14691, 700000, 47.6, 7.476772),
    (2024, 12, 14800, 1337882, 90.4, 0.741951),
    (2025, 10, 16000, 203285, 12.7, 8.108108),
    (2025, 12, 16331, 2000000, 122.5, 2.06875),
]


@pytest.fixture(scope="module")
def history(spark):
    rows = [("city", datetime(y, m, 1), users, uses) for y, m, users, uses, _, _ in HISTORY]
    return frame(spark, rows, "series string, month timestamp_ntz, users bigint, uses bigint")


def test_published_growth_figures(spark, history):
    got = [r["growth_pct"] for r in growth.growth_metrics(history).orderBy("month").collect()]
    assert got == [row[5] for row in HISTORY]
    per_user = [r["uses_per_user"] for r in growth.growth_metrics(history, uses="uses").orderBy("month").collect()]
    assert per_user == [row[4] for row in HISTORY]


def test_cagr_splits_at_the_regime(spark, history):
    got = {r["regime"]: r for r in growth.cagr(history).collect()}
    years = (datetime(2021, 12, 1) - datetime(2009, 7, 1)).days / 365.25
    assert got["pre"]["cagr_pct"] == pytest.approx(100 * ((2200 / 500) ** (1 / years) - 1), abs=1e-6)
    assert (got["post"]["first"], got["post"]["last"]) == (2673, 16331)


def test_fits_recover_exact_curves(spark):
    rows = []
    for i in range(40):
        month = datetime(2010 + i // 12, 1 + i % 12, 1)
        x = round((month - datetime(2010, 1, 1)).days / 30.44)
        rows.append(("s", month, int(round(10000 / (1 + np.exp(-0.2 * (x - 20)))))))
        rows.append(("e", month, int(round(1000 * np.exp(0.05 * x)))))
    df = frame(spark, rows, "series string, month timestamp_ntz, users bigint")
    fit = {r["series"]: r for r in growth.fit_logistic(df).collect()}["s"]
    assert fit["r2"] > 0.999 and fit["k"] == pytest.approx(0.2, rel=0.05) and fit["x0"] == pytest.approx(20, rel=0.05)
    curve = {r["series"]: r for r in growth.fit_exponential(df).collect()}["e"]
    assert curve["r2"] > 0.999 and curve["b"] == pytest.approx(0.05, rel=0.05)
    ahead = growth.project_growth(df.where("series = 's'")).orderBy("month").collect()
    assert len(ahead) == 24 and ahead[0]["month"] == datetime(2013, 5, 1)
    assert all(a["users"] <= b["users"] for a, b in zip(ahead, ahead[1:])) and ahead[-1]["saturation_pct"] <= 100


def months_of(n, year=2010):
    return [datetime(year + i // 12, 1 + i % 12, 1) for i in range(n)]


def test_regimes_are_fitted_on_their_own(spark):
    """Two planted curves, one after the other, each with its time from its own first month."""
    dates = months_of(100)
    cut = dates[40]
    x = lambda d, d0: round((d - d0).days / 30.44)
    rows = [("s", d, 1e6 * 300 * np.exp(0.031 * x(d, dates[0])) + 2e8) for d in dates[:40]]
    rows += [("s", d, 2.5e10 / (1 + np.exp(-0.083 * (x(d, cut) - 21.4)))) for d in dates[40:]]
    df = frame(spark, [(s, d, int(round(y))) for s, d, y in rows], "series string, month timestamp_ntz, users bigint")
    slow = {r["regime"]: r for r in growth.fit_exponential(df, split_date=str(cut.date())).collect()}["pre"]
    assert (slow["a"], slow["b"], slow["c"]) == pytest.approx((3e8, 0.031, 2e8), rel=1e-3)
    fast = {r["regime"]: r for r in growth.fit_logistic(df, split_date=str(cut.date())).collect()}["post"]
    assert (fast["l"], fast["k"], fast["x0"]) == pytest.approx((2.5e10, 0.083, 21.4), rel=1e-3) and fast["r2"] > 0.999999
    ahead = growth.project_growth(df, split_date=str(cut.date()), months=2).orderBy("month").collect()
    want = [2.5e10 / (1 + np.exp(-0.083 * (x(dates[-1], cut) + i - 21.4))) for i in (1, 2)]
    assert [r["users"] for r in ahead] == pytest.approx(want, rel=1e-4) and {r["regime"] for r in ahead} == {"post"}


def test_grids_only_improve_on_the_straight_lines():
    """The squared error of noisy points never exceeds that of the best line in logarithms or logits."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = np.arange(float(rng.integers(4, 60)))
        y = np.maximum(1, rng.uniform(50, 5000) * np.exp(rng.uniform(-0.05, 0.1) * x) + rng.normal(0, 30, len(x)) + rng.uniform(0, 500))
        found = growth.exponential_curve(x, y)
        lines = []
        for cand in range(20):
            c = y.min() * cand / 20
            slope, intercept = np.polyfit(x, np.log(y - c), 1)
            lines.append(((y - np.exp(intercept + slope * x) - c) ** 2).sum())
        error = ((y - found["a"] * np.exp(found["b"] * x) - found["c"]) ** 2).sum()
        assert error <= min(lines) * (1 + 1e-9)
        y = np.sort(np.maximum(1, 4000 / (1 + np.exp(-0.15 * (x - 20))) * rng.uniform(0.9, 1.1, len(x))))
        found = growth.logistic_curve(x, y)
        if found is None:
            continue
        lines = []
        for cand in range(1, 301):
            top = y[-1] * (100 + cand) / 100
            slope, intercept = np.polyfit(x, np.log(y / (top - y)), 1)
            if 0.01 <= slope <= 0.5 and 5 <= -intercept / slope <= 50:
                lines.append(((y - top / (1 + np.exp(-slope * x - intercept))) ** 2).sum())
        error = ((y - found["l"] / (1 + np.exp(-found["k"] * (x - found["x0"])))) ** 2).sum()
        assert error <= min(lines) * (1 + 1e-9)


def test_short_flat_and_empty_series_have_no_curve(spark):
    dates = months_of(3)
    rows = [("one", dates[0], 5), *(("flat", d, 7) for d in dates), *(("none", d, None) for d in dates), ("two", dates[0], 1), ("two", dates[1], 2)]
    df = frame(spark, rows, "series string, month timestamp_ntz, users bigint")
    for fits in (growth.fit_exponential(df), growth.fit_logistic(df)):
        got = {r["series"]: r["r2"] for r in fits.collect()}
        assert set(got) == {"one", "flat", "none", "two"} and all(v is None for v in got.values())
    assert growth.fit_exponential(df.where("false")).count() == 0


def test_a_far_ceiling_is_found_and_no_series_vanishes(spark):
    """One series ends at a third of its ceiling; the other falls, so no curve within the bounds fits it."""
    rows = []
    for i in range(30):
        month = datetime(2015 + i // 12, 1 + i % 12, 1)
        x = round((month - datetime(2015, 1, 1)).days / 30.44)
        rows.append(("far", month, int(round(90000 / (1 + np.exp(-0.1 * (x - 36)))))))
        rows.append(("falls", month, 5000 - 100 * i))
    df = frame(spark, rows, "series string, month timestamp_ntz, users bigint")
    fit = {r["series"]: r for r in growth.fit_logistic(df).collect()}
    assert fit["far"]["l"] == pytest.approx(90000, rel=0.03) and fit["far"]["l"] > 2.5 * rows[-2][2]
    assert fit["falls"]["l"] is None and fit["falls"]["r2"] is None
    ahead = growth.project_growth(df, months=3).collect()
    assert sorted((r["series"], r["users"] is None) for r in ahead) == [("falls", True)] * 3 + [("far", False)] * 3


# Public figures of twenty districts: name, people, income, density, stations -> published total and priority.
DISTRICTS = [
    ("Os Mallos", 18000, 25869, 11000, 2, 64.1, "Alta"),
    ("Juan Flórez", 10000, 66774, 13000, 4, 57.6, "Media"),
    ("Mesoiro", 13000, 34500, 8000, 2, 54.0, "Media"),
    ("La Torre", 12000, 34000, 9000, 2, 53.2, "Media"),
    ("San Pablo", 8000, 62000, 12000, 3, 53.0, "Media"),
    ("Ensanche", 20000, 38000, 14000, 8, 52.5, "Media"),
    ("Monte Alto", 12000, 28500, 9500, 2, 51.2, "Media"),
    ("Agra do Orzán", 15000, 25751, 12500, 3, 50.1, "Media"),
    ("Matogrande", 10000, 36000, 8500, 2, 49.5, "Media"),
    ("Santa Margarita", 9000, 33000, 9800, 2, 47.9, "Media"),
    ("Los Rosales", 15000, 35000, 10000, 4, 47.9, "Media"),
    ("Barrio de las Flores", 8000, 30000, 9500, 1, 47.1, "Media"),
    ("Marineda", 11000, 31000, 7000, 2, 46.9, "Media"),
    ("Elviña", 14000, 35500, 6500, 3, 44.2, "Media"),
    ("Labañou", 8000, 27000, 7500, 1, 42.8, "Media"),
    ("Palavea", 6000, 37000, 5500, 1, 40.8, "Media"),
    ("Plaza de Pontevedra", 7000, 40000, 11500, 3, 39.6, "Baja"),
    ("Ventorrillo", 6000, 26000, 6800, 1, 37.3, "Baja"),
    ("Feáns", 5000, 32500, 4500, 0, 33.3, "Baja"),
    ("Ciudad Vieja", 5000, 32000, 15000, 5, 30.4, "Baja"),
]


@pytest.fixture(scope="module")
def districts(spark):
    rows = [(n, p, float(i), d, s) for n, p, i, d, s, _, _ in DISTRICTS]
    return frame(spark, rows, "district string, population bigint, income double, density bigint, n_stations bigint")


def test_published_siting_ranking(districts):
    got = {r["district"]: (r["score_total"], r["priority"]) for r in siting.siting_score(districts).collect()}
    assert got == {n: (total, priority) for n, *_, total, priority in DISTRICTS}


def test_siting_reasons(districts):
    top = siting.siting_top_n(districts).orderBy("rank").collect()
    assert [r["district"] for r in top] == [d[0] for d in DISTRICTS[:5]]
    assert top[0]["reasons"] == "Alta poblacion (18000 hab), Alta densidad urbana"
    assert top[1]["reasons"] == "Poder adquisitivo alto (sostenibilidad economica), Alta densidad urbana"


def test_income_fields_and_totals(districts):
    got = {r["district"]: (r["income_month"], r["income_band"]) for r in siting.income_fields(districts).collect()}
    assert got["Os Mallos"] == (2156.0, "Baja") and got["Monte Alto"] == (2375.0, "Media") and got["Elviña"] == (2958.0, "Alta")
    assert first(siting.city_totals(districts))["richest"] == "Juan Flórez"
    counts = {r["priority"]: r["n"] for r in siting.priority_distribution(districts).select("priority", "n").distinct().collect()}
    assert counts == {"Alta": 1, "Media": 15, "Baja": 4}


def test_degenerate_siting_component_is_fifty(spark):
    same = frame(spark, [("x", 10, 5.0, 7, 1), ("y", 10, 5.0, 7, 1)], "district string, population bigint, income double, density bigint, n_stations bigint")
    got = first(siting.siting_score(same))
    assert (got["score_population"], got["score_coverage"], got["score_total"]) == (15.0, 12.5, 55.0)


def test_fits_run_side_by_side(spark):
    """Jobs that wait for each other all run; training rows fill the cores, and a task's share is bounded."""
    together = threading.Barrier(5, timeout=30)
    assert sorted(learners.side_by_side(spark, *(lambda k=k: (together.wait(), k)[1] for k in range(5)))) == list(range(5))
    assert [learners.partitions_for(n, 12) for n in (0, 20_000, 60_001, 4_000_000, 60_000_000)] == [1, 1, 4, 12, 120]


@pytest.mark.parametrize("present_only", [True, False])
def test_readings_are_copied_by_groups_of_blocks(spark, monkeypatch, present_only):
    """Ten blocks in four groups: the pairs are those of single blocks, and a reading is copied four times, not ten."""
    rng = random.Random(23)
    values = [(s, t, rng.randrange(-9, 1_000_000)) for s in range(60) for t in range(30) if (t // 10 != s % 3) and rng.random() < 0.7]
    df = frame(spark, values, "s bigint, t bigint, v bigint")
    copies, found, real = [], [], pairs.in_block_pairs
    monkeypatch.setattr(pairs, "in_block_pairs", lambda packed, n: copies.append(n) or real(packed, n))
    monkeypatch.setattr(pairs, "PAIRS_PER_CORE", 0.5)
    for held in (0, 32 << 20):
        monkeypatch.setattr(pairs, "GROUP_BYTES", held)
        best = pairs.best_few(3, -0.2, 0.2, instants=None if present_only else 30)
        sums = pairs.pair_moments(df, 60, 30, present_only=present_only, best=best, block=6, stretch=7)
        found.append(sorted(tuple(r) for r in sums.collect()))
    assert copies == [10, 4] and found[0] == found[1] and len(found[0]) > 60
