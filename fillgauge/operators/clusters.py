"""Groups of stations by their daily profile."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.demand import hourly_profile, hourly_profile_long
from fillgauge.operators.pairs import block_count, spread_of
from fillgauge.session import materialise

HOURS = [f"h{h}" for h in range(24)]
# Spark compares a centre's move, others its square: this is the usual 1e-4 on squares.
TOLERANCE = 0.01
#: Stations of a block whose distances are taken together, and rows of a strip of them.
BLOCK, STRIP = 4096, 256
#: Squared distances below this share of the squared lengths are taken from differences, as products lose digits there.
NEAR = 1e-4


def profile_vectors(df: DataFrame, key: str, **columns) -> DataFrame:
    """(key, features): the standardised hourly profile of each station."""
    profile = materialise(hourly_profile(df, key=key, **columns), "profiles")
    raw = VectorAssembler(inputCols=HOURS, outputCol="raw").transform(profile).select(key, "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return scaler.fit(raw).transform(raw).select(key, "features")


def cached(vectors: DataFrame, per_partition: int = 20_000) -> tuple[DataFrame, int]:
    """Vectors kept in memory for the iterations, in partitions worth a task, and their count."""
    n = vectors.count()
    kept = vectors.coalesce(max(1, math.ceil(n / per_partition))).persist()
    return kept, n


def best_kmeans(vectors: DataFrame, k: int, restarts: int, seed: int):
    """Lowest-cost fit of several seeds, the first on ties."""
    return min(fits(vectors, [(k, seed + i) for i in range(restarts)]), key=lambda m: m.summary.trainingCost)


def fits(vectors: DataFrame, runs: list[tuple[int, int]], parallelism: int = 8) -> list:
    """Independent k-means fits (k, seed), submitted side by side as Spark's own tuning does."""
    fit = inheritable_thread_target(vectors.sparkSession)(
        lambda run: KMeans(k=run[0], seed=run[1], maxIter=100, tol=TOLERANCE).fit(vectors)
    )
    with ThreadPool(min(parallelism, len(runs))) as pool:
        return pool.map(fit, runs)


def relabel(assigned: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Number clusters by size, largest first; equal sizes by their lowest member."""
    sizes = assigned.groupBy(cluster).agg(F.count("*").alias("n"), F.min(key).alias("low"))
    order = Window.orderBy(F.col("n").desc(), "low")
    names = sizes.select(cluster, (F.row_number().over(order) - 1).cast("int").alias("_name"))
    return assigned.join(F.broadcast(names), cluster).select(key, F.col("_name").alias(cluster))


def cluster_stations(df, *, key="station_id", k=4, restarts=10, seed=42, **columns):
    vectors, _ = cached(profile_vectors(df, key, **columns))
    model = best_kmeans(vectors, k, restarts, seed)
    vectors.unpersist()
    found = model.transform(vectors).select(key, F.col("prediction").alias("cluster"))
    return relabel(found, key)


def elbow_curve(df, *, key="station_id", ks=range(2, 11), restarts=3, seed=42, **columns):
    """Cost per k and its fall against the previous k.

    Costs are those of population-scaled profiles, n / (n - 1) times Spark's.
    """
    vectors, n = cached(profile_vectors(df, key, **columns))
    factor = n / (n - 1) if n > 1 else 1.0
    runs = [(int(k), seed + i) for k in ks for i in range(restarts)]
    best: dict[int, float] = {}
    for (k, _), model in zip(runs, fits(vectors, runs)):
        cost = float(model.summary.trainingCost) * factor
        best[k] = min(cost, best.get(k, cost))
    vectors.unpersist()
    curve = df.sparkSession.createDataFrame(sorted(best.items()), "k int, inertia double")
    return with_reduction(curve)


def with_reduction(curve: DataFrame) -> DataFrame:
    before = F.lag("inertia").over(Window.orderBy("k"))
    return curve.select(
        "k", r6(F.col("inertia")).alias("inertia"), r6(100 * C.ratio(before - F.col("inertia"), before)).alias("reduction_pct")
    )


def elbow_pick(curve: DataFrame, *, fallback: int = 3) -> DataFrame:
    """The k farthest from the chord between the curve's ends; the smallest k on ties."""
    ends = curve.agg(
        F.struct(
            F.min("k").alias("x1"),
            F.min_by("inertia", "k").alias("y1"),
            F.max("k").alias("x2"),
            F.max_by("inertia", "k").alias("y2"),
        )
    ).scalar()
    dx, dy = F.col("_e.x2") - F.col("_e.x1"), F.col("_e.y2") - F.col("_e.y1")
    away = F.abs(dx * (F.col("_e.y1") - F.col("inertia")) - (F.col("_e.x1") - F.col("k")) * dy)
    distance = r6(C.ratio(away, F.sqrt(dx * dx + dy * dy)))
    best = curve.withColumn("_e", ends).withColumn("distance", distance).agg(
        F.max_by(F.struct("k", "distance"), F.struct("distance", -F.col("k"))).alias("b")
    )
    bent = F.col("b.distance") > 0
    return best.select(
        F.when(bent, F.col("b.k")).otherwise(F.lit(fallback)).cast("bigint").alias("k"),
        F.coalesce("b.distance", F.lit(0.0)).alias("distance"),
    )


def grouping_inertia(df, assignments, *, key="station_id", **columns):
    """Within-cluster squared error of the hourly profiles for each given grouping (key, k, cluster)."""
    profile = hourly_profile_long(df, key=key, **columns)
    members = assignments.groupBy("k", "cluster").agg(F.count("*").alias("size"))
    sums = (
        profile.join(assignments, key)
        .groupBy("k", "cluster", "hour")
        .agg(F.sum("occ").alias("s"), F.sum(F.col("occ") * F.col("occ")).alias("ss"))
    )
    return (
        sums.join(members, ["k", "cluster"])
        .groupBy("k")
        .agg(r6(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("size"))).alias("inertia"))
    )


def profile_packer():
    """One row for a block of stations: their profiles as a matrix, and of each grouping their clusters."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pd.DataFrame(pdf["clusters"].map(dict).tolist())
        member = [f"{k}:{c}" for k in groups.columns for c in groups[k].dropna().astype("int64").unique()]
        code = {name: n for n, name in enumerate(member)}
        own = np.full((len(pdf), len(groups.columns)), -1, dtype="<i4")
        for n, k in enumerate(groups.columns):
            known = groups[k].notna().to_numpy()
            own[known, n] = [code[f"{k}:{c}"] for c in groups[k][known].astype("int64")]
        points = np.vstack(pdf["profile"].to_numpy()).astype("<f8")
        return pd.DataFrame(
            {"_b": [pdf["_b"].iloc[0]], "stations": [pdf["station"].to_numpy()], "points": [points.tobytes()], "members": [member], "own": [own.tobytes()]}
        )

    return pack


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; those of rows close to each other by their differences."""
    lengths = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
    squares = lengths - 2 * (p @ q.T)
    i, j = np.nonzero(squares <= NEAR * lengths)
    for at in range(0, len(i), 65_536):
        some = slice(at, at + 65_536)
        diff = p[i[some]] - q[j[some]]
        squares[i[some], j[some]] = (diff * diff).sum(axis=1)
    return np.sqrt(squares)


def distance_summer():
    """The task-side sums: from each station of a block to each cluster's members in the blocks that follow it."""
    columns = ("station", "own", "k", "cluster", "dist")

    def shaped(row):
        n = len(row.stations)
        return np.frombuffer(row.points, "<f8").reshape(n, -1), np.frombuffer(row.own, "<i4").reshape(n, -1)

    def add(points, row, sums):
        others, own = shaped(row)
        member = np.zeros((len(others), len(row.members)))
        for column in own.T:
            known = np.flatnonzero(column >= 0)
            member[known, column[known]] = 1.0
        found = np.vstack([distances(points[at : at + STRIP], others) @ member for at in range(0, len(points), STRIP)])
        for name, column in zip(row.members, found.T):
            sums[name] = sums[name] + column if name in sums else column

    def emit(row, sums):
        _, own = shaped(row)
        names = [tuple(map(int, m.split(":"))) for m in row.members]
        out = []
        for column in own.T:
            known = np.flatnonzero(column >= 0)
            if not len(known):
                continue
            k = names[column[known[0]]][0]
            mine, stations = np.array([c for _, c in names])[column[known]], np.asarray(row.stations)[known]
            for name, dist in sums.items():
                of, cluster = map(int, name.split(":"))
                if of == k:
                    out.append(pd.DataFrame({"station": stations, "own": mine, "k": k, "cluster": cluster, "dist": dist[known]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    def run(frames):
        now, left, points, sums = None, None, None, None
        for pdf in frames:
            for row in pdf.itertuples(index=False, name="Block"):
                if (row.bi, row.g) != now:
                    if left is not None:
                        yield emit(left, sums)
                    now, left, points, sums = (row.bi, row.g), row, shaped(row)[0], {}
                else:
                    add(points, row, sums)
        if left is not None:
            yield emit(left, sums)

    return run


def silhouette_pick(df, assignments, *, key="station_id", block=BLOCK, **columns):
    """Mean Euclidean silhouette per k of given groupings (key, k, cluster), and the best k.

    Distances are products of a block of stations with one block after the other; per
    station only one sum per cluster leaves a task. Where there are fewer blocks than
    tasks, the other blocks are dealt to several. Work grows with the square of the stations.
    """
    profile = hourly_profile(df, key=key, **columns).select(
        F.col(key).alias("station"), F.array(*HOURS).alias("profile")
    )
    given = assignments.groupBy(F.col(key).alias("station")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), F.col("cluster").cast("int")))).alias("clusters")
    )
    kind = dict(profile.dtypes)["station"]
    points = materialise(profile.join(given, "station"), "profiles")
    blocks = block_count(points.agg(F.approx_count_distinct("station")).first()[0], block)
    groups = min(blocks, math.ceil(4 * df.sparkSession.sparkContext.defaultParallelism / blocks))
    packed = points.withColumn("_b", spread_of(F.col("station"), blocks)).groupBy("_b")
    packed = packed.applyInPandas(profile_packer(), f"_b int, stations array<{kind}>, points binary, members array<string>, own binary")
    packed = materialise(packed, "profile-blocks").withColumnRenamed("_b", "b")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lefts = packed.select(F.col("b").alias("bi"), every(groups).alias("g"), F.lit(-1).alias("bj"), "stations", "points", "members", "own")
    rights = packed.select(every(blocks).alias("bi"), F.pmod("b", F.lit(groups)).alias("g"), F.col("b").alias("bj"), "stations", "points", "members", "own")
    # an empty block, of which there is no row, meets nothing
    rights = rights.join(F.broadcast(packed.select(F.col("b").alias("bi"))), "bi", "left_semi").select(*lefts.columns)
    dealt = lefts.unionByName(rights).repartition("bi", "g").sortWithinPartitions("bi", "g", "bj")
    parts = dealt.mapInPandas(distance_summer(), f"station {kind}, own int, k int, cluster int, dist double")
    sizes = assignments.groupBy(F.col("k").cast("int").alias("k"), F.col("cluster").cast("int").alias("cluster")).agg(
        F.count("*").alias("size")
    )
    same = F.col("own") == F.col("cluster")
    per_station = (
        parts.groupBy("station", "own", "k", "cluster")
        .agg(F.sum("dist").alias("dist"))
        .join(sizes, ["k", "cluster"])
        .groupBy("station", "k")
        .agg(
            F.max(F.when(same, C.ratio(F.col("dist"), F.col("size") - 1))).alias("a"),
            F.min(F.when(~same, F.col("dist") / F.col("size"))).alias("b"),
        )
    )
    # A station alone in its cluster scores 0.
    score = F.coalesce(C.ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    per_k = per_station.groupBy("k").agg(r6(F.avg(score)).alias("silhouette"))
    best = per_k.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).scalar()
    return per_k.withColumn("_best", best).select(
        "k", "silhouette", C.flag(F.col("k") == F.col("_best")).alias("is_best")
    )


def _filled_cluster_profile(df, assignment, key, **columns) -> tuple[DataFrame, DataFrame]:
    """Per cluster and hour the summed station means, and the cluster sizes (missing cells count as 0)."""
    profile = hourly_profile_long(df, key=key, **columns)
    sums = profile.join(assignment, key).groupBy("cluster", "hour").agg(F.sum("occ").alias("s"))
    known = profile.select(key).distinct().join(assignment, key)
    return sums, known.groupBy("cluster").agg(F.count("*").alias("n"))


def cluster_archetypes(df, assignment, *, key="station_id", **columns):
    """What each cluster's day looks like, from its morning, midday and evening level."""
    sums, sizes = _filled_cluster_profile(df, assignment, key, **columns)

    def peak(lo, hi):
        hours = F.col("hour").between(lo, hi)
        return F.coalesce(F.sum(F.when(hours, F.col("s"))), F.lit(0.0)) / (hi - lo + 1)

    peaks = sums.groupBy("cluster").agg(
        peak(7, 9).alias("m"), peak(13, 15).alias("d"), peak(17, 19).alias("e")
    )
    total = sizes.agg(F.sum("n")).scalar()
    level = {name: F.round(F.col(col) / F.col("n"), 6) for name, col in (("morning", "m"), ("midday", "d"), ("evening", "e"))}
    morning, midday, evening = F.col("morning"), F.col("midday"), F.col("evening")
    label = (
        F.when((morning < evening) & (morning < midday), D.ARCHETYPE_HOME)
        .when(morning > evening, D.ARCHETYPE_WORK)
        .when((midday > morning) & (midday > evening), D.ARCHETYPE_LEISURE)
        .otherwise(D.ARCHETYPE_MIXED)
    )
    return (
        sizes.join(peaks, "cluster")
        .withColumns(level)
        .withColumn("_total", total)
        .select(
            "cluster",
            "morning",
            "midday",
            "evening",
            label.alias("label"),
            F.col("n").cast("bigint").alias("n"),
            r6(100 * C.ratio(F.col("n"), F.col("_total"))).alias("pct"),
        )
    )


def cluster_profiles(df, assignment, *, key="station_id", **columns):
    """Mean occupancy % per cluster for each of the 24 hours."""
    sums, sizes = _filled_cluster_profile(df, assignment, key, **columns)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    return (
        sizes.select("cluster", "n", hours)
        .join(sums, ["cluster", "hour"], "left")
        .select(
            "cluster", "hour", r6(100 * F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("occupancy_pct")
        )
    )


def mean_profiles(df, assignment, *, key="station_id", **columns) -> DataFrame:
    """Centroids in long form (cluster, hour, c)."""
    return cluster_profiles(df, assignment, key=key, **columns).select(
        "cluster", "hour", (F.col("occupancy_pct") / 100).alias("c")
    )


def assign_nearest_centroid(df, centroids, *, key="station_id", **columns):
    """Nearest centroid of each station's profile by squared distance; ties to the lowest cluster.

    The centroid table (clusters x 24) is folded into one array per cluster, so
    a station meets each centroid once and no hour is shuffled.
    """
    profile = hourly_profile(df, key=key, **columns).select(key, F.array(*HOURS).alias("p"))
    folded = centroids.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("hour", "c"))), lambda x: x["c"]).alias("c")
    )
    table = folded.agg(F.sort_array(F.collect_list(F.struct("cluster", "c")))).scalar()
    squares = lambda p, c: F.aggregate(
        F.zip_with(p, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )
    measured = F.transform(
        F.col("_t"), lambda t: F.struct(F.round(squares(F.col("p"), t["c"]), 6).alias("dist2"), t["cluster"].alias("cluster"))
    )
    return profile.withColumn("_t", table).withColumn("_m", F.array_min(measured)).select(
        key, F.col("_m.cluster").alias("cluster"), F.col("_m.dist2").alias("dist2")
    )
