"""Row-level features and look-ahead targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.slices import asof, ranked, shift, shift_by
from fillgauge.session import lookup, materialise

ROW_ID = "event_id"


def occupancy_ratio(df, *, key="station_id", time="ts", level="bikes", docks="docks", capacity="capacity", clip=False):
    """Share in use; a station without a known capacity has room for its bikes and free docks."""
    room = df.select(key, time, level, C.capacity_or_sum(capacity, level, docks).alias("_room"))
    return room.select(key, time, F.col("_room").alias(capacity), r6(C.occupancy(level, "_room", clip)).alias("occupancy"))


def calendar_features(df: DataFrame, *, key="station_id", time="ts") -> DataFrame:
    day_of_week = C.weekday_of(time)
    return df.select(
        key,
        time,
        F.to_date(time).alias("date"),
        C.hour_of(time).alias("hour"),
        day_of_week.alias("day_of_week"),
        F.month(time).cast("int").alias("month"),
        F.date_format(time, "EEEE").alias("day_name"),
        C.weekend(day_of_week).alias("is_weekend"),
    )


def rush_hour_flag(df, *, key="station_id", time="ts", ranges=D.RUSH_THREE_PEAKS):
    return df.select(key, time, C.in_ranges(C.hour_of(time), ranges).alias("is_rush_hour"))


def holiday_flag(df, *, key="station_id", time="ts", holidays: Sequence[str] = D.HOLIDAYS_2026):
    """The holiday list is a parameter, so membership is a literal ``IN``, not a join."""
    days = [F.lit(day).cast("date") for day in holidays]
    return df.select(key, time, C.flag(F.to_date(time).isin(*days)).alias("is_holiday"))


def season_and_service_filter(df, *, key="station_id", time="ts", months=(6, 9), open_h=7, close_h=1):
    return df.where(C.in_service(C.hour_of(time), open_h, close_h)).select(
        key, time, C.flag(F.month(time).between(*months)).alias("is_tourist_season")
    )


def weather_label(df, *, key="station_id", time="ts", code="code"):
    return df.select(key, time, C.weather_type(F.col(code)).alias("weather_type"))


def cyclic_encode(df, *, key="station_id", time="ts", periods={"hour": 24, "day_of_week": 7}):
    values = {"hour": C.hour_of(time), "day_of_week": C.weekday_of(time)}
    out = []
    for name, period in periods.items():
        sine, cosine = C.cyclic(values.get(name, F.col(name)), period)
        out += [r6(sine).alias(f"{name}_sin"), r6(cosine).alias(f"{name}_cos")]
    return df.select(key, time, *out)


def status_flags(
    df,
    *,
    key="station_id",
    time="ts",
    level="bikes",
    docks="docks",
    capacity="capacity",
    empty=D.EMPTY_BELOW,
    full=D.FULL_BELOW,
    stockout=D.STOCKOUT_BELOW,
    pct=0.2,
):
    return df.select(
        key,
        time,
        C.is_empty(level, empty).alias("is_empty"),
        C.is_full(docks, full).alias("is_full"),
        C.is_empty(level, stockout).alias("is_stockout"),
        C.flag(F.col(level) == 0).alias("is_zero"),
        C.flag(F.col(level).cast("double") < F.lit(float(pct)) * F.col(capacity)).alias("is_low_pct"),
    )


def minmax_scale(df, *, key="station_id", time="ts", minmax=("temp",), maxonly=("wind",), rain="rain", eps=0.001):
    """Global extremes come as one scalar subquery; rows are not shuffled."""
    extremes = df.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in minmax],
            *[F.max(c).alias(f"hi_{c}") for c in [*minmax, *maxonly]],
        )
    ).scalar()
    scaled = [
        r6((F.col(c) - F.col(f"_e.lo_{c}")) / (F.col(f"_e.hi_{c}") - F.col(f"_e.lo_{c}") + eps)).alias(f"{c}_norm")
        for c in minmax
    ] + [r6(F.col(c) / (F.col(f"_e.hi_{c}") + eps)).alias(f"{c}_norm") for c in maxonly]
    return df.withColumn("_e", extremes).select(key, time, *scaled, C.flag(F.col(rain) > 0).alias("is_raining"))


def with_zscore(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    stats = materialise(df.groupBy(group).agg(F.avg(col).alias("_mean"), F.stddev_samp(col).alias("_std")), "group-stats")
    spread = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    return (
        df.join(lookup(stats, [group]), group, "left")
        .withColumn(out, (F.col(col) - F.col("_mean")) / spread)
        .drop("_mean", "_std")
    )


def zscore_by_group(df, *, group="city", col="temperature", key="station_id", time="ts"):
    return with_zscore(df, group, col, "zscore").select(group, key, time, r6(F.col("zscore")).alias("zscore"))


def band_label(df, value: Column, edges, labels, *, key="station_id", time="ts", open_ended=False):
    return df.select(
        key, time, r6(value).alias("value"), C.band(value, edges, labels, open_ended).alias("band")
    )


def occupancy_band(df, *, key="station_id", level="bikes", capacity="capacity"):
    """Colour band of the mean occupancy, risk band of the empty share, marker sizes of both maps."""
    empty_pct = F.round(100 * F.col("empty"), 6)
    return df.groupBy(key).agg(
        F.avg(C.occupancy(level, capacity)).alias("occ"),
        F.avg(C.flag(F.col(level) == 0)).alias("empty"),
        F.avg(level).alias("mean"),
    ).select(
        key,
        C.occupancy_level(F.round("occ", 6)).alias("occupancy_band"),
        C.risk_level(empty_pct).alias("risk_band"),
        r6(C.clamp(4 + empty_pct / 2.5, 4, 12)).alias("radius"),
        r6(C.clamp(F.col("mean") * 1.2, 5, 16)).alias("level_radius"),
    )


def coverage_of(df: DataFrame, col: str) -> Column:
    """Share of rows where ``col`` is present, as a scalar subquery."""
    return df.agg(F.avg(C.flag(F.col(col).isNotNull()))).scalar()


def complete_cases(
    df: DataFrame, required: Sequence[str], optional: str, *, key="station_id", time="ts", min_coverage=0.9
) -> DataFrame:
    """Rows complete in ``required``, and in ``optional`` where that column is covered well enough.

    A poorly covered optional column is blanked instead of costing rows.
    """
    kept = df.dropna(subset=list(required)).withColumn("coverage", coverage_of(df, optional))
    used = F.col("coverage") > min_coverage
    return kept.where(~used | F.col(optional).isNotNull()).select(
        ROW_ID,
        key,
        time,
        F.when(used, F.col(optional)).alias(optional),
        r6(F.col("coverage")).alias("coverage"),
    )


def bike_delta(
    df, *, key="station_id", time="ts", level="bikes", tie=ROW_ID, first=None, zero_is_missing=False, max_rows=D.MAX_SLICE_ROWS
):
    """Change since the previous reading of the station.

    ``first`` fills the first reading's change; ``zero_is_missing`` treats a
    previous count of 0 as unknown, as the live collector does.
    """
    rows = shift(df, key, [time, tie], {"_prev": (level, -1)}, max_rows)
    prev = F.col("_prev")
    if zero_is_missing:
        prev = F.when(prev == 0, F.col(level)).otherwise(prev)
    delta = F.col(level) - prev
    if first is not None:
        delta = F.coalesce(delta, F.lit(first))
    return (
        rows.withColumn("delta", delta.cast("bigint"))
        .withColumn("abs_delta", F.abs("delta"))
        .drop("_prev")
    )


def trend_features(df, *, key="station_id", time="ts", level="bikes", capacity="capacity", tie=ROW_ID, eps=0.001):
    """Speed, change of speed, and the change over three readings relative to capacity."""
    rows = shift(
        df,
        key,
        [time, tie],
        {"_b1": (level, -1), "_b2": (level, -2), "_b3": (level, -3)},
    )
    now, room = F.col(level), F.col(capacity) + F.lit(eps)
    trend = F.coalesce((now - F.col("_b3")) / room, F.lit(0.0))
    velocity = F.coalesce(now - F.col("_b1"), F.lit(0))
    # The previous reading's velocity: null before it exists, 0 for the first reading.
    before = F.when(F.col("_b1").isNotNull(), F.coalesce(F.col("_b1") - F.col("_b2"), F.lit(0)))
    acceleration = F.coalesce(velocity - before, F.lit(0))
    return rows.select(
        tie,
        r6(trend).alias("trend_15min"),
        velocity.cast("bigint").alias("velocity"),
        acceleration.cast("bigint").alias("acceleration"),
    )


def with_future(df, *, key="station_id", time="ts", level="bikes", docks="docks", tie=ROW_ID, horizon=D.HORIZON_ROWS):
    """Rows that have a reading ``horizon`` rows ahead, with its level and docks."""
    return shift(
        df, key, [time, tie], {"future_bikes": (level, horizon), "future_docks": (docks, horizon)}
    ).where("future_bikes is not null")


def future_status_target(df, *, empty=D.EMPTY_BELOW, full=D.FULL_BELOW, tie=ROW_ID, **kwargs):
    will_empty, will_full = F.col("future_bikes") < empty, F.col("future_docks") < full
    return with_future(df, tie=tie, **kwargs).select(
        tie,
        F.col("future_bikes").cast("bigint").alias("future_bikes"),
        C.flag(will_empty).alias("will_be_empty"),
        C.flag(will_full).alias("will_be_full"),
        C.flag(will_empty | will_full).alias("will_have_problem"),
    )


def with_delta_target(
    df, *, key="station_id", time="ts", value="occupancy", tie=ROW_ID, horizon=D.HORIZON_ROWS, jump=0.10, sized_by=None
):
    """Change of ``value`` over the horizon; without a future the flags stay 0.

    ``horizon`` is a number of rows, or a column that says it row by row.
    """
    if isinstance(horizon, Column):
        rows = shift_by(df, key, [time, tie], value, horizon, "_next", sized_by=sized_by)
    else:
        rows = shift(df, key, [time, tie], {"_next": (value, horizon)}, sized_by=sized_by)
    delta = F.round(F.col("_next") - F.col(value), 6)
    return (
        rows.withColumn("delta_next", delta)
        .withColumn("will_increase", F.coalesce(C.flag(F.col("delta_next") > jump), F.lit(0)))
        .withColumn("will_decrease", F.coalesce(C.flag(F.col("delta_next") < -jump), F.lit(0)))
        .drop("_next")
    )


def delta_target(
    df, *, level="bikes", capacity="capacity", tie=ROW_ID, drop_no_future=False, **kwargs
):
    rows = df.withColumn("occupancy", C.occupancy(level, capacity, clip=True))
    out = with_delta_target(rows, tie=tie, **kwargs)
    if drop_no_future:
        out = out.where("delta_next is not null")
    return out.select(tie, "delta_next", "will_increase", "will_decrease")


def time_part(rank: Column, n: Column, train_fraction: float) -> Column:
    """``train`` for the first part of ``n`` rows, but not for all where there are two or more."""
    wanted = F.floor(n * F.lit(float(train_fraction))).cast("bigint")
    cut = F.when(n < 2, n).otherwise(F.greatest(F.lit(1), F.least(wanted, n - 1)))
    return F.when(rank <= cut, "train").otherwise("test")


def with_time_split(
    df, *, key="station_id", time="ts", tie=ROW_ID, train_fraction=D.TRAIN_FRACTION, sized_by=None
):
    """First part of each station's readings is train, the rest test."""
    rows = ranked(df, key, [time, tie], sized_by=sized_by)
    return rows.withColumn("split", time_part(F.col("_rank"), F.col("_total"), train_fraction)).drop("_rank", "_total")


def time_split(df, *, key="station_id", tie=ROW_ID, **kwargs):
    return with_time_split(df, key=key, tie=tie, **kwargs).select(tie, key, "split")


def random_split(df: DataFrame, *, key=ROW_ID, one_in=5) -> DataFrame:
    """A fixed fifth for validation; stable under any repartitioning and blind to the order of ids."""
    return df.select(key, F.when(C.fold(key, one_in) == 0, "val").otherwise("train").alias("split"))


def time_horizon_target(
    df, *, key="station_id", time="ts", level="bikes", tie=ROW_ID, minutes=D.HORIZON_MINUTES, tol_min=15, empty=D.EMPTY_BELOW
):
    """Level of the first reading at least ``minutes`` later, at most ``tol_min`` beyond that."""
    # Readings name their time differently to keep the two roles apart.
    readings = df.select(key, F.col(time).alias("_then"), F.col(tie).alias("_id"), F.col(level).alias("future_bikes"))
    probes = df.select(key, tie, (micros_plus(time, minutes)).alias("_target"))
    found = asof(
        probes, readings, "_target", "_then", ["_then", "future_bikes"], [key], "_id", forward=True
    )
    late = C.micros("_found._then") - C.micros("_target") > tol_min * 60_000_000
    future = F.when(~late, F.col("_found.future_bikes"))
    return found.select(
        tie,
        future.cast("bigint").alias("future_bikes"),
        C.flag(future < empty).alias("will_be_empty"),
    )


def micros_plus(time: str, minutes: int) -> Column:
    return C.naive(F.timestamp_micros(C.micros(time) + minutes * 60_000_000))


def transfer_features(
    df: DataFrame,
    *,
    city="city",
    key="station_id",
    time="ts",
    tie=ROW_ID,
    horizon=D.HORIZON_ROWS,
    hourly=D.HOURLY_HORIZON_ROWS,
    jump=0.10,
) -> DataFrame:
    """The unified feature frame of all cities, with targets.

    Expects ``occupancy`` and ``temperature``; flags a city does not report
    default to 0. A city without stations is one hourly series, with a horizon of
    its own; its change is not one of thirty minutes.
    """
    ahead = F.when(F.col(key).isNull(), F.lit(hourly)).otherwise(F.lit(horizon))
    hour, dow = C.hour_of(time), C.weekday_of(time)
    (hour_sin, hour_cos), (dow_sin, dow_cos) = C.cyclic(hour, 24), C.cyclic(dow, 7)
    flags = {
        "is_weekend": C.weekend(dow),
        "is_rush_hour": C.in_ranges(hour, D.RUSH_THREE_PEAKS),
        "is_holiday": F.lit(0),
        "is_raining": F.lit(0),
    }
    base = df.withColumns(
        {
            name: F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else default
            for name, default in flags.items()
        }
    ).withColumn("occupancy", C.clamp(F.coalesce("occupancy", F.lit(0.0)), 0, 1))
    # Station ids repeat between cities, so a series is a city's station.
    scored = with_delta_target(
        with_zscore(base, city, "temperature", "temp_zscore"),
        key=[city, key],
        time=time,
        tie=tie,
        horizon=ahead,
        jump=jump,
        sized_by=df,
    )
    return scored.select(
        city,
        key,
        tie,
        F.col(time).alias("timestamp"),
        hour.alias("hour"),
        r6(hour_sin).alias("hour_sin"),
        r6(hour_cos).alias("hour_cos"),
        dow.alias("day_of_week"),
        r6(dow_sin).alias("dow_sin"),
        r6(dow_cos).alias("dow_cos"),
        *flags,
        r6(F.col("occupancy")).alias("occupancy"),
        r6(F.col("temp_zscore")).alias("temp_zscore"),
        F.when(F.col(key).isNotNull(), F.col("delta_next")).alias("delta_30min"),
        "delta_next",
        "will_increase",
        "will_decrease",
    )
