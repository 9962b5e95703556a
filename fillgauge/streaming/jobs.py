"""Structured Streaming forms of the snapshot jobs.

The jobs take a streaming frame and return one, with event time as TIMESTAMP.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.operators.health import snapshot_aggregates, with_health_score

WATERMARK = "10 minutes"
#: Groups of stations whose last readings are one state.
STATE_GROUPS = 1_024
#: Before every time.
NO_TIME = -(1 << 63)


def read_snapshots(spark: SparkSession, path: str, schema, *, time="ts", files: int = 1_000) -> DataFrame:
    """A folder of parquet files as a stream of ``files`` files at a time; event time becomes TIMESTAMP, which watermarks need."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return read.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def stream_enrich(
    stream: DataFrame,
    dimension: DataFrame,
    *,
    key="station_id",
    time="ts",
    level="bikes",
    docks="docks",
    capacity="capacity",
    holidays=D.HOLIDAYS_2026,
    season=(6, 9),
) -> DataFrame:
    """Snapshots of known stations with the dimension, calendar columns, weather and status flags.

    Weather comes along where the snapshots carry it.
    """
    day_of_week = C.weekday_of(time)
    attributes = [c for c in dimension.columns if c != key]
    joined = stream.drop(*attributes).join(dimension, key)
    weather = [F.col(c) for c in ("temp", "rain", "wind") if c in stream.columns]
    if "code" in stream.columns:
        weather.append(C.weather_type(F.col("code")).alias("weather_type"))
    return joined.select(
        key,
        *attributes,
        level,
        docks,
        C.r6(C.occupancy(level, capacity)).alias("occupancy"),
        time,
        C.hour_of(time).alias("hour"),
        C.flag(F.to_date(time).isin(*[F.lit(day).cast("date") for day in holidays])).alias("is_holiday"),
        C.flag(F.month(time).between(*season)).alias("is_tourist_season"),
        day_of_week.alias("day_of_week"),
        C.weekend(day_of_week).alias("is_weekend"),
        C.in_ranges(C.hour_of(time), D.RUSH_THREE_PEAKS).alias("is_rush_hour"),
        C.is_empty(level).alias("is_empty"),
        C.is_full(docks).alias("is_full"),
        *weather,
    )


def stream_dedup(stream: DataFrame, *, key="station_id", time="ts", watermark=WATERMARK) -> DataFrame:
    """A replayed poll counts once."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key, time])


def stream_system_health(
    stream: DataFrame, *, time="ts", width="5 minutes", watermark=WATERMARK, weight=1.5, **columns
) -> DataFrame:
    """Totals and health score per snapshot window, emitted when the watermark passes its end."""
    windows = (
        stream.withWatermark(time, watermark).groupBy(F.window(time, width)).agg(*snapshot_aggregates(**columns))
    )
    return with_health_score(windows, weight).select(F.col("window.start").alias(time), "*").drop("window")


def window_partials(stream: DataFrame, out: str, checkpoint: str, *, time="ts", seconds=D.FRAME_SECONDS, **columns) -> DataStreamWriter:
    """What each micro-batch adds to the totals of each snapshot window, however late its rows are.

    A batch writes a few rows per window it touches, under its number, so repeating
    it replaces them. ``window_totals`` adds them up: late readings correct windows
    that were reported before.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        window = C.floor_time(time, seconds).alias(time)
        sums = batch.where(F.col(time).isNotNull()).groupBy(window).agg(*snapshot_aggregates(**columns))
        sums.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def window_totals(partials: DataFrame, *, time="ts", weight=1.5) -> DataFrame:
    """``stream_system_health`` as it stands after all batches so far."""
    sums = [c for c in partials.columns if c not in (time, "batch")]
    return with_health_score(partials.groupBy(time).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums]), weight)


def stream_hourly_activity(deltas: DataFrame, *, time="ts", watermark=WATERMARK) -> DataFrame:
    """Movements per clock hour from a stream of deltas; rows later than the watermark are dropped."""
    return (
        deltas.withWatermark(time, watermark)
        .groupBy(F.window(time, "1 hour"))
        .agg(F.coalesce(F.sum("abs_delta"), F.lit(0)).cast("bigint").alias("activity"))
        .select(F.col("window.start").alias("hour_ts"), "activity")
    )


def changes_since(
    last: pd.DataFrame | None, rows: pd.DataFrame, key: str, time: str, tie: str, level: str, zero_is_missing: bool
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of some stations with their change and whether they are late, and each station's last reading now.

    ``last`` has a row per station: its key, and time in microseconds (``at``), tie-breaker
    and level (whether it is ``known``, and what it is) of its last reading so far.
    """
    names = rows[key] if last is None else pd.concat([pd.Series(last["key"], dtype=rows[key].dtype), rows[key]])
    codes = pd.factorize(names, use_na_sentinel=False)[0]  # stations with state come first
    held = 0 if last is None else len(last)
    station = codes[held:]
    size = max(held, int(codes.max()) + 1)
    at_last, tie_last = np.full(size, NO_TIME), np.zeros(size, "int64")
    level_last, known_last = np.zeros(size, "int64"), np.zeros(size, bool)
    if held:
        at_last[:held], tie_last[:held] = last["at"], last["tie"]
        level_last[:held], known_last[:held] = last["level"], last["known"]

    at = rows[time].astype("datetime64[us]")
    at = at.astype("int64").where(at.notna(), NO_TIME).to_numpy()
    ties = rows[tie].to_numpy()
    order = np.lexsort((ties, at, station))
    rows, station, at, ties = rows.iloc[order], station[order], at[order], ties[order]
    newer = (at > at_last[station]) | ((at == at_last[station]) & (at > NO_TIME) & (ties > tie_last[station]))

    of, now, known = station[newer], rows[level].to_numpy()[newer].astype("int64"), ~rows["_no_level"].to_numpy()[newer]
    first = np.r_[True, of[1:] != of[:-1]][: len(of)]
    before = np.where(first, level_last[of], np.r_[0, now[:-1]][: len(of)])
    known_before = np.where(first, known_last[of], np.r_[False, known[:-1]][: len(of)])
    if zero_is_missing:
        missing = known_before & (before == 0)
        before, known_before = np.where(missing, now, before), np.where(missing, known, known_before)
    delta = pd.array(np.zeros(len(rows), "int64"), "Int64")
    delta[:] = pd.NA
    delta[np.flatnonzero(newer)[known & known_before]] = (now - before)[known & known_before]
    out = rows.assign(delta=delta, late=~newer)

    ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True][: len(of)])
    at_last[of[ends]], tie_last[of[ends]] = at[newer][ends], ties[newer][ends]
    level_last[of[ends]], known_last[of[ends]] = now[ends], known[ends]
    _, shown = np.unique(codes, return_index=True)
    state = pd.DataFrame({"key": names.iloc[shown].to_numpy(), "at": at_last, "tie": tie_last, "level": level_last, "known": known_last})
    return out, state[state["at"] > NO_TIME].copy()


def stream_delta(
    stream: DataFrame, *, key="station_id", time="ts", level="bikes", tie="event_id", zero_is_missing=False, groups=STATE_GROUPS
) -> DataFrame:
    """Change against the station's last reading, across micro-batches.

    The last reading of each station is keyed state, which Spark keeps with the
    query's checkpoint and restores after a failure. Stations share ``groups`` keys by
    their hash, as a call for each station costs far more than its rows do; the number
    stays as it is for the life of a checkpoint. ``late`` marks rows without a
    time and those not later than the station's last reading: they change nothing
    and have no change. A task holds the readings that one group of stations sent in one
    micro-batch, which ``files`` of ``read_snapshots`` bounds.
    """
    rows = stream.select(tie, key, time, level)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # beside nulls pandas would hold whole numbers as floats: null keys stay apart, others are marked
    marked = {"_no_tie": F.col(tie).isNull(), "_no_level": F.col(level).isNull()}
    filled = {tie: F.coalesce(F.col(tie).cast("bigint"), F.lit(NO_TIME)), level: F.coalesce(F.col(level).cast("bigint"), F.lit(0))}
    schema = f"{tie} bigint, {key} {kinds[key]}, {time} {kinds[time]}, {level} bigint, "
    schema += "_no_tie boolean, _no_level boolean, delta bigint, late boolean"
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    fields = {"key": kinds[key], "at": "bigint", "tie": "bigint", "level": "bigint", "known": "boolean"}

    def step(_, frames, state):
        last = pd.DataFrame(dict(zip(fields, state.get))) if state.exists else None
        out, now = changes_since(last, pd.concat(list(frames)).drop(columns="_group"), key, time, tie, level, zero_is_missing)
        if len(now):
            now["key"] = now["key"].astype(object).where(now["key"].notna(), None)
            state.update(tuple(now[f].tolist() for f in fields))
        yield out

    held = ", ".join(f"{f} array<{t}>" for f, t in fields.items())
    grouped = rows.withColumns(marked).withColumns(filled).withColumn("_group", group).groupBy("_group")
    found = grouped.applyInPandasWithState(step, schema, held, "append", "NoTimeout").withColumns(
        {c: F.when(~F.col(no), F.col(c)).cast(kinds[c]) for c, no in ((tie, "_no_tie"), (level, "_no_level"))}
    )
    return found.select(tie, key, time, level, "delta", F.abs("delta").alias("abs_delta"), C.flag(F.col("late")).alias("late"))


def batch_sink(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Publish each micro-batch as one partition of a table; repeating a batch replaces it."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


DELTA_SCHEMA = "event_id bigint, station_id bigint, ts timestamp, bikes int, delta bigint, abs_delta bigint, late int"
