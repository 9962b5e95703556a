"""Rhythm of demand, weather effects, movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.features import bike_delta

# Day bands as [first hour, end hour).
DAY_BANDS = (
    ("night", 0, 6),
    ("morning", 6, 12),
    ("midday", 12, 15),
    ("afternoon", 15, 20),
    ("evening", 20, 24),
)

def over_all(col):
    """An aggregate over all rows; for aggregated tables only: bands, weekdays, days."""
    return col.over(Window.partitionBy())


def activity_by_band(df, *, time="ts", bands=DAY_BANDS, **kwargs):
    """Mean absolute change per hour, averaged over bands of the day.

    ``share_pct`` relates a band to morning + afternoon + evening.
    """
    hourly = (
        bike_delta(df, time=time, **kwargs)
        .groupBy(C.hour_of(time).alias("hour"))
        .agg(F.avg("abs_delta").alias("activity"))
    )
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, start, end in bands:
        label = label.when((F.col("hour") >= start) & (F.col("hour") < end), F.lit(name))
    banded = hourly.groupBy(label.alias("band")).agg(F.avg("activity").alias("activity"))
    in_use = F.col("band").isin("morning", "afternoon", "evening")
    used = over_all(F.sum(F.when(in_use, F.col("activity"))))
    return banded.select(
        "band",
        r6(F.col("activity")).alias("activity"),
        r6(F.coalesce(100 * C.ratio(F.col("activity"), used), F.lit(0.0))).alias("share_pct"),
        C.flag(F.col("activity") == over_all(F.max("activity"))).alias("is_peak"),
    )


def peak_hours(df, *, time="ts", level="bikes", capacity="capacity"):
    """Hours of highest and lowest mean occupancy; ties go to the earliest hour."""
    hourly = df.groupBy(C.hour_of(time).alias("hour")).agg(
        r6(F.avg(C.occupancy(level, capacity))).alias("occ")
    )
    return hourly.agg(
        F.max_by("hour", F.struct("occ", -F.col("hour"))).alias("hour_max"),
        F.max("occ").alias("occ_max"),
        F.min_by("hour", F.struct("occ", "hour")).alias("hour_min"),
        F.min("occ").alias("occ_min"),
    )


def weekday_pattern(df, *, time="ts", level="bikes", capacity="capacity"):
    occ = 100 * C.occupancy(level, capacity)
    daily = df.groupBy(C.weekday_of(time).alias("day_of_week")).agg(
        F.sum(occ).alias("s"), F.count("*").alias("n")
    )

    def mean(condition):
        total = over_all(F.sum(F.when(condition, F.col("s"))))
        return C.ratio(total, over_all(F.sum(F.when(condition, F.col("n")))))

    weekday, weekend = mean(F.col("day_of_week") < 5), mean(F.col("day_of_week") >= 5)
    return daily.select(
        "day_of_week",
        r6(C.ratio(F.col("s"), F.col("n"))).alias("occupancy_pct"),
        r6(weekday).alias("weekday_pct"),
        r6(weekend).alias("weekend_pct"),
        r6(weekday - weekend).alias("diff"),
    )


def rain_occupancy_impact(df, *, level="bikes", capacity="capacity", rain="rain", temp="temp"):
    """No row when the feed has no temperature at all."""
    occ = 100 * C.occupancy(level, capacity)
    wet = F.col(rain) > 0
    return (
        df.agg(
            F.avg(F.when(~wet, occ)).alias("dry"),
            F.avg(F.when(wet, occ)).alias("wet"),
            F.avg(temp).alias("t_mean"),
            F.min(temp).alias("t_min"),
            F.max(temp).alias("t_max"),
        )
        .where("t_mean is not null")
        .select(
            r6(F.col("dry")).alias("occ_dry"),
            r6(F.col("wet")).alias("occ_wet"),
            r6(F.col("wet") - F.col("dry")).alias("diff"),
            r6(F.col("t_mean")).alias("temp_mean"),
            r6(F.col("t_min")).alias("temp_min"),
            r6(F.col("t_max")).alias("temp_max"),
        )
    )


def hourly_activity(df, *, time="ts", rain="rain", wind="wind", temp="temp", **kwargs) -> DataFrame:
    """Movements and mean weather per clock hour; hours lacking a reading of either are left out."""
    return (
        bike_delta(df, time=time, **kwargs)
        .groupBy(C.floor_time(time, 3600).alias("hour_ts"))
        .agg(
            F.coalesce(F.sum("abs_delta"), F.lit(0)).cast("bigint").alias("activity"),
            F.avg(rain).alias("rain"),
            F.avg(wind).alias("wind"),
            F.avg(temp).alias("temp"),
        )
        .dropna()
    )


def weather_activity_impact(df, *, rain_mm=0.1, wind_kmh=20, **kwargs):
    """Mean hourly movements below and above a rain and a wind limit."""
    hourly = hourly_activity(df, **kwargs)
    act = F.col("activity").cast("double")
    factors = {"rain": F.round("rain", 9) > rain_mm, "wind": F.round("wind", 9) > wind_kmh}
    sums = hourly.agg(
        *[
            agg
            for name, high in factors.items()
            for agg in (
                F.sum(C.flag(~high)).alias(f"{name}_n_low"),
                F.sum(C.flag(high)).alias(f"{name}_n_high"),
                F.avg(F.when(~high, act)).alias(f"{name}_low"),
                F.avg(F.when(high, act)).alias(f"{name}_high"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("factor"),
                F.col(f"{name}_n_low").cast("bigint").alias("hours_low"),
                F.col(f"{name}_n_high").cast("bigint").alias("hours_high"),
                r6(F.col(f"{name}_low")).alias("act_low"),
                r6(F.col(f"{name}_high")).alias("act_high"),
                r6(
                    100 * C.ratio(F.col(f"{name}_high") - F.col(f"{name}_low"), F.col(f"{name}_low"))
                ).alias("impact_pct"),
            )
            for name in factors
        ]
    )
    return sums.select(F.inline(rows))


def weather_correlation(df, **kwargs):
    """Pearson correlation of hourly movements with rain, wind and temperature."""
    hourly = hourly_activity(df, **kwargs)
    y = F.col("activity").cast("double")
    n = F.count("*").cast("double")
    factors = ("rain", "wind", "temp")
    r = {
        name: C.pearson(
            n, F.sum(name), F.sum(y), F.sum(F.col(name) * F.col(name)), F.sum(y * y), F.sum(F.col(name) * y)
        )
        for name in factors
    }
    whole = hourly.agg(*[r6(col).alias(name) for name, col in r.items()])
    return whole.unpivot([], list(factors), "factor", "r")


def trips_and_co2(df, *, time="ts", km=2.5, kg_per_km=0.12, kg_per_tree=21, **kwargs):
    """Departures seen as trips, and the emissions they replace."""
    moves = bike_delta(df, time=time, **kwargs)
    whole = moves.agg(
        F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("abs_delta"))), F.lit(0)).cast("bigint").alias("rentals"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )
    span = C.micros("last_ts") - C.micros("first_ts")
    days = (span - F.pmod(span, F.lit(86_400_000_000))) / F.lit(86_400_000_000) + 1
    rentals = F.col("rentals").cast("double")
    co2 = rentals * km * kg_per_km
    return whole.select(
        "rentals",
        r6(rentals / days).alias("per_day"),
        r6(rentals * km).alias("km"),
        r6(co2).alias("co2_kg"),
        r6(co2 / days).alias("co2_day"),
        r6(co2 / days * 365).alias("co2_year"),
        r6(co2 / days * 365 / kg_per_tree).alias("trees"),
    )


def atypical_days(df, *, time="ts", z=1.5, **kwargs):
    daily = (
        bike_delta(df, time=time, **kwargs)
        .groupBy(F.to_date(time).alias("date"))
        .agg(F.coalesce(F.sum("abs_delta"), F.lit(0)).cast("bigint").alias("activity"))
    )
    away = F.col("activity") - F.col("_mean")
    return (
        daily.withColumn("_mean", over_all(F.avg("activity")))
        .withColumn("_std", over_all(F.stddev_samp("activity")))
        .where(F.abs(away) > z * F.col("_std"))
        .select(
            "date",
            "activity",
            r6(F.col("_mean")).alias("mean"),
            r6(F.col("_std")).alias("std"),
            F.when(away > 0, D.DAY_BUSY).otherwise(D.DAY_QUIET).alias("kind"),
        )
    )


def stockout_heatmap(df, *, time="ts", level="bikes", below=D.STOCKOUT_BELOW):
    """Stockouts per weekday and hour, all 168 cells present."""
    seen = df.where(F.col(level) < below).groupBy(
        C.weekday_of(time).alias("day_of_week"), C.hour_of(time).alias("hour")
    ).agg(F.count("*").alias("events"))
    spark = df.sparkSession
    grid = spark.range(168).select(
        (F.col("id") / 24).cast("int").alias("day_of_week"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return grid.join(seen, ["day_of_week", "hour"], "left").select(
        "day_of_week", "hour", F.coalesce("events", F.lit(0)).cast("bigint").alias("events")
    )


def occupancy_heatmap(df, *, time="ts", level="bikes", capacity="capacity"):
    return df.groupBy(C.weekday_of(time).alias("day_of_week"), C.hour_of(time).alias("hour")).agg(
        r6(100 * F.avg(C.occupancy(level, capacity))).alias("occupancy_pct")
    )


def stockout_roi(
    df, *, level="bikes", below=D.STOCKOUT_BELOW, ping_min=D.PING_MINUTES, demand=3.4, fee=40, churn=0.02, weeks=52
):
    """What the lost service hours cost in trips, fees and members."""
    events = df.agg(F.sum(C.is_empty(level, below)).cast("bigint").alias("events"))
    hours = F.col("events") * ping_min / F.lit(60.0)
    # Settle the binary representation before the floors.
    trips = F.floor(F.round(hours * demand, 6))
    return events.withColumn("trips", trips.cast("bigint")).select(
        r6(hours).alias("hours_lost"),
        F.col("trips").alias("trips_lost"),
        r6(F.col("trips") * fee * churn).alias("value"),
        F.floor(F.round(F.col("trips") * churn, 6)).cast("bigint").alias("churners"),
        r6(F.col("trips") * fee * churn * weeks / 1000).alias("value_year_k"),
    )


def depletion_sla(df, *, time="ts", hours=(7, 10), ping_min=D.PING_MINUTES, buffer=5, **kwargs):
    """How fast stations empty in the rush, and how long a buffer lasts; no row without departures."""
    drops = bike_delta(df, time=time, **kwargs).where(
        C.hour_of(time).between(*hours) & (F.col("delta") < 0)
    )
    per_min = F.col("drop") / ping_min
    return (
        drops.agg(F.avg(-F.col("delta")).alias("drop"))
        .where("drop is not null")
        .select(
            r6(per_min * 60).alias("bikes_per_hour"), r6(F.lit(float(buffer)) / per_min).alias("minutes_to_empty")
        )
    )


def hourly_profile_long(df, *, key="station_id", time="ts", level="bikes", capacity="capacity") -> DataFrame:
    """Mean occupancy per station and hour; hours without readings are absent."""
    return df.groupBy(key, C.hour_of(time).alias("hour")).agg(
        F.avg(C.occupancy(level, capacity)).alias("occ")
    )


def hourly_profile(df, *, key="station_id", time="ts", level="bikes", capacity="capacity", value="occupancy"):
    """One row per station with columns h0 .. h23; missing cells are 0."""
    measure = C.occupancy(level, capacity) if value == "occupancy" else F.col(value)
    hour = C.hour_of(time)
    return df.groupBy(key).agg(
        *[r6(F.coalesce(F.avg(F.when(hour == h, measure)), F.lit(0.0))).alias(f"h{h}") for h in range(24)]
    )


def city_summary(df, *, city="city"):
    return df.groupBy(city).agg(
        r6(F.avg("occupancy")).alias("occ_mean"),
        r6(F.stddev_samp("occupancy")).alias("occ_std"),
        F.count("occupancy").cast("bigint").alias("n"),
        r6(F.avg("is_rush_hour")).alias("rush_mean"),
        r6(F.avg("is_weekend")).alias("weekend_mean"),
    )
