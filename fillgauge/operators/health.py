"""Service state: overview, availability, shortage and saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators import distinct, snapshots


def top_k(df: DataFrame, metric: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The ``k`` first rows with a ``rank``; only those k rows are ever numbered."""
    order = [F.col(metric).desc() if descending else F.col(metric).asc(), F.col(tie)]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def pct(condition: Column) -> Column:
    return 100 * F.avg(C.flag(condition).cast("double"))


def system_overview(df, *, key="station_id", time="ts", capacity="capacity", approx=False):
    """Span, stations and volume.

    With ``approx``, stations are counted by merged daily sketches, without a row
    for each station; their capacity is then not known.
    """
    if approx:
        whole = distinct.merged(distinct.daily_sketches(df, key=key, time=time)).select(
            "first_ts", "last_ts", F.hll_sketch_estimate("keys").cast("bigint").alias("n_stations"),
            F.lit(None).cast("bigint").alias("capacity_total"), F.col("n_obs").cast("bigint").alias("n_obs"),
        )
    else:
        per_station = df.groupBy(key).agg(
            F.min(time).alias("first_ts"),
            F.max(time).alias("last_ts"),
            F.min_by(capacity, time).alias("cap"),
            F.count("*").alias("n"),
        )
        whole = per_station.agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.count("*").cast("bigint").alias("n_stations"),
            F.sum("cap").cast("bigint").alias("capacity_total"),
            F.sum("n").cast("bigint").alias("n_obs"),
        )
    span = C.micros("last_ts") - C.micros("first_ts")
    days = ((span - F.pmod(span, F.lit(86_400_000_000))) / 86_400_000_000 + 1).cast("bigint")
    return whole.withColumn("days", days).select(
        "first_ts",
        "last_ts",
        "days",
        "n_stations",
        "capacity_total",
        "n_obs",
        r6(C.ratio(F.col("n_obs"), F.col("days"))).alias("obs_per_day"),
    )


def system_health(df, *, level="bikes", docks="docks", capacity="capacity", empty=D.EMPTY_BELOW, full=D.FULL_BELOW):
    whole = df.agg(
        pct(F.col(level) < empty).alias("e"),
        pct(F.col(docks) < full).alias("f"),
        (100 * F.avg(C.occupancy(level, capacity))).alias("o"),
    )
    return whole.select(
        r6(F.col("e")).alias("pct_empty"),
        r6(F.col("f")).alias("pct_full"),
        r6(100 - F.col("e") - F.col("f")).alias("pct_ok"),
        r6(F.col("o")).alias("occupancy_pct"),
    )


def health_score(empty, full, total, weight: float = 1.5):
    """100 less the weighted shares of empty and full stations, not below 0."""
    lost = F.lit(float(weight)) * 100
    return F.greatest(
        F.lit(0.0),
        F.lit(100.0) - C.ratio(lost * empty, total) - C.ratio(lost * full, total),
    )


def snapshot_aggregates(level="bikes", docks="docks", capacity="capacity", empty=D.EMPTY_BELOW, full=D.FULL_BELOW):
    return [
        F.count("*").cast("bigint").alias("total_stations"),
        F.sum(level).cast("bigint").alias("total_bikes"),
        F.sum(capacity).cast("bigint").alias("total_capacity"),
        F.sum(C.is_empty(level, empty)).cast("bigint").alias("empty_stations"),
        F.sum(C.is_full(docks, full)).cast("bigint").alias("full_stations"),
    ]


def with_health_score(df: DataFrame, weight: float = 1.5) -> DataFrame:
    return df.withColumn(
        "health_score",
        r6(health_score(F.col("empty_stations"), F.col("full_stations"), F.col("total_stations"), weight)),
    )


def snapshot_health(df, *, time="ts", weight=1.5, **columns):
    return with_health_score(df.groupBy(time).agg(*snapshot_aggregates(**columns)), weight)


def health_states(spans, *, time="ts", level="bikes", docks="docks", capacity="capacity", empty=D.EMPTY_BELOW, full=D.FULL_BELOW, weight=1.5):
    """``snapshot_health`` of spans of readings: a row for each frame in which the network changes.

    A frame in which no station is present has no score.
    """
    sums = {
        "total_bikes": F.col(level), "total_capacity": F.col(capacity),
        "empty_stations": C.is_empty(level, empty), "full_stations": C.is_full(docks, full),
    }
    rows = snapshots.states(spans, sums, time=time).withColumnRenamed("present", "total_stations")
    scored = with_health_score(rows, weight)
    return scored.withColumn("health_score", F.when(F.col("total_stations") > 0, F.col("health_score")))


def station_means(
    df, *, key="station_id", level="bikes", docks="docks", capacity="capacity", empty=D.EMPTY_BELOW, full=D.FULL_BELOW
):
    return df.groupBy(key).agg(
        F.avg(level).alias("bikes"),
        F.avg(capacity).alias("capacity"),
        (100 * F.avg(C.occupancy(level, capacity))).alias("occupancy_pct"),
        pct(F.col(level) < empty).alias("pct_empty"),
        pct(F.col(docks) < full).alias("pct_full"),
    )


def station_stats(df, *, key="station_id", **kwargs):
    return station_means(df, key=key, **kwargs).select(
        key, *[r6(F.col(c)).alias(c) for c in ("bikes", "capacity", "occupancy_pct", "pct_empty", "pct_full")]
    )


def over_under_utilised(df, *, key="station_id", hi=70, lo=30, n=5, **kwargs):
    stats = station_stats(df, key=key, **kwargs).select(key, "occupancy_pct")
    over = top_k(stats.where(F.col("occupancy_pct") > hi), "occupancy_pct", n, key)
    under = top_k(stats.where(F.col("occupancy_pct") < lo), "occupancy_pct", n, key, descending=False)
    return (
        over.withColumn("kind", F.lit("over"))
        .unionByName(under.withColumn("kind", F.lit("under")))
        .select("kind", "rank", key, "occupancy_pct")
    )


def ghost_stations(df, *, key="station_id", level="bikes", max_std=1):
    return (
        df.groupBy(key)
        .agg(r6(F.stddev_samp(level)).alias("bikes_std"))
        .where(F.col("bikes_std") < max_std)
    )


def activity_ranking(df, *, key="station_id", time="ts", level="bikes", capacity="capacity", n=10):
    stats = df.groupBy(key).agg(
        r6(F.stddev_samp(level)).alias("std"),
        r6(F.avg(level)).alias("mean"),
        F.min_by(capacity, time).alias("_cap"),
    ).where("std is not null")
    out = [key, "std", "mean", r6(C.ratio(F.col("std"), F.col("_cap")) * 100).alias("rel_use")]
    most = top_k(stats, "std", n, key).withColumn("kind", F.lit("most"))
    least = top_k(stats, "std", n, key, descending=False).withColumn("kind", F.lit("least"))
    return most.unionByName(least).select("kind", "rank", *out)


def downtime_top(df, *, key="station_id", level="bikes", below=D.STOCKOUT_BELOW, n=5, expand_pct=15):
    stats = df.groupBy(key).agg(
        F.count("*").cast("bigint").alias("total_pings"),
        F.sum(C.is_empty(level, below)).cast("bigint").alias("stockout_pings"),
    ).withColumn("downtime_pct", r6(100 * C.ratio(F.col("stockout_pings"), F.col("total_pings"))))
    action = F.when(F.col("downtime_pct") > expand_pct, D.ACTION_EXPAND).otherwise(D.ACTION_REBALANCE)
    return (
        stats.orderBy(F.col("downtime_pct").desc(), key).limit(n).withColumn("action", action)
    )


def empty_time_risk(df, *, key="station_id", level="bikes", ping_min=D.PING_MINUTES):
    counts = df.groupBy(key).agg(
        F.count("*").cast("bigint").alias("total_obs"),
        F.sum(C.flag(F.col(level) == 0)).cast("bigint").alias("empty_obs"),
    )
    return counts.select(
        key,
        "total_obs",
        "empty_obs",
        r6(100 * C.ratio(F.col("empty_obs"), F.col("total_obs"))).alias("empty_pct"),
        r6(F.col("empty_obs") * ping_min / F.lit(60.0)).alias("hours_lost"),
    )


def network_risk(df, *, key="station_id", high_pct=10, **kwargs):
    """Mean empty share of the network, stations above ``high_pct`` and the worst one."""
    risk = empty_time_risk(df, key=key, **kwargs)
    return risk.agg(
        r6(F.avg("empty_pct")).alias("mean_empty_pct"),
        F.sum(C.flag(F.col("empty_pct") > high_pct)).cast("bigint").alias("n_high"),
        F.min_by(key, F.struct(-F.col("empty_pct"), key)).alias("worst_station"),
        r6(F.max("empty_pct")).alias("worst_pct"),
    )


def service_level(df, *, key="station_id", worst=5, **kwargs):
    """Availability, and the share of all empty time in the worst stations."""
    risk = empty_time_risk(df, key=key, **kwargs)
    whole = risk.agg(F.avg("empty_pct").alias("mean_pct"), F.sum("empty_obs").alias("all_obs"))
    top = risk.orderBy(F.col("empty_obs").desc(), key).limit(worst).agg(F.sum("empty_obs")).scalar()
    return whole.withColumn("top_obs", top).select(
        r6(100 - F.col("mean_pct")).alias("availability_pct"),
        r6(100 * C.ratio(F.col("top_obs"), F.col("all_obs"))).alias("worst_share_pct"),
    )


def station_mode(df, *, key="station_id", level="bikes", capacity="capacity", tol=0):
    """Most frequent level per station; ties go to the smallest level."""
    counted = df.groupBy(key, level).agg(F.count("*").alias("n"), F.max(capacity).alias("cap"))
    mode = counted.groupBy(key).agg(
        F.max_by(F.struct(F.col(level).alias("m"), "n"), F.struct("n", -F.col(level))).alias("best"),
        F.max("cap").alias("cap"),
    )
    value = F.col("best.m")
    state = (
        F.when(value <= tol, "shortage").when(value >= F.col("cap") - tol, "saturation").otherwise("normal")
    )
    return mode.select(
        key,
        value.cast("bigint").alias("mode_bikes"),
        F.col("best.n").cast("bigint").alias("n"),
        state.alias("state"),
    )


def capacity_frequency(df, *, key="station_id", time="ts", capacity="capacity"):
    """How many stations have each capacity."""
    return (
        df.groupBy(key)
        .agg(F.min_by(capacity, time).alias("capacity"))
        .groupBy("capacity")
        .agg(F.count("*").cast("bigint").alias("n_stations"))
    )


def cluster_scorecard(df, assignment, *, key="station_id", cluster="cluster", level="bikes", below=D.STOCKOUT_BELOW):
    """Spread of the level and stockout share per cluster.

    Station moments are taken first, so the join moves stations, not readings.
    """
    x = F.col(level).cast("bigint")
    moments = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("s"),
        F.sum(x * x).alias("ss"),
        F.sum(C.is_empty(level, below)).alias("b"),
    )
    total = moments.join(assignment, key).groupBy(cluster).agg(
        *[F.sum(c).cast("double").alias(c) for c in ("n", "s", "ss", "b")]
    )
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    variance = C.ratio(n * ss - s * s, n * (n - 1))
    return total.select(
        F.col(cluster).alias("cluster"),
        r6(F.sqrt(variance)).alias("bikes_std"),
        r6(F.coalesce(100 * C.ratio(F.col("b"), n), F.lit(0.0))).alias("stockout_pct"),
    )


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """One long (section, metric, value) table of one-row results, as text."""
    parts = []
    for name, frame in sections.items():
        text = frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns])
        parts.append(
            text.select(F.lit(name).alias("section"), *text.columns).unpivot(
                "section", text.columns, "metric", "value"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
