"""Fleet size, shortage against a buffer, complete snapshots, frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.session import lookup, materialise


def per_snapshot(df, *, time="ts", level="bikes", capacity="capacity", buffer=2):
    """Snapshots polled all at once as states: one row each, standing for one frame."""
    return df.groupBy(time).agg(
        F.count("*").alias("present"),
        F.sum(level).alias("bikes"),
        F.sum(capacity).alias("capacity"),
        F.sum(F.greatest(F.lit(0), F.lit(buffer) - F.col(level))).alias("short"),
        F.lit(1).cast("bigint").alias("frames"),
    )


def fleet_utilisation(df, *, time="ts", level="bikes", capacity="capacity", **limits):
    return utilisation_of(per_snapshot(df, time=time, level=level, capacity=capacity), time=time, **limits)


def utilisation_of(states, *, time="ts", ideal=0.5, tol=50):
    """Bikes over all frames, against a share of the capacity of the first."""
    whole = states.agg(
        F.min_by("capacity", time).cast("bigint").alias("capacity"),
        C.ratio(F.sum(F.col("bikes") * F.col("frames")), F.sum("frames")).alias("mean"),
        F.min("bikes").cast("bigint").alias("bikes_min"),
        F.max("bikes").cast("bigint").alias("bikes_max"),
    )
    diff = F.col("mean") - F.col("capacity") * ideal
    return whole.select(
        "capacity",
        r6(F.col("mean")).alias("bikes_mean"),
        "bikes_min",
        "bikes_max",
        r6(100 * C.ratio(F.col("mean"), F.col("capacity"))).alias("occupancy_pct"),
        r6(diff).alias("diff"),
        F.when(diff > tol, "excess").when(diff < -tol, "shortage").otherwise("balanced").alias("verdict"),
    )


def station_capacities(df, *, key="station_id", capacity="capacity"):
    """How many stations there are, and their docks, as the fields of a scalar."""
    return df.groupBy(key).agg(F.max(capacity).alias("cap")).agg(
        F.struct(F.count("*").alias("n"), F.sum("cap").alias("docks"))
    ).scalar()


def fleet_deficit(df, *, key="station_id", time="ts", level="bikes", capacity="capacity", buffer=2):
    """Peak shortage, when it happened, and the fleet that would cover it."""
    snaps = per_snapshot(df, time=time, level=level, capacity=capacity, buffer=buffer)
    return deficit_of(snaps, station_capacities(df, key=key, capacity=capacity), time=time, buffer=buffer)


def deficit_of(states, stations, *, time="ts", buffer=2):
    """``fleet_deficit`` of states; an absent station lacks the whole buffer."""
    snaps = states.withColumn("_s", stations).withColumn("deficit", F.col("short") + buffer * (F.col("_s.n") - F.col("present")))
    whole = snaps.agg(
        F.max("bikes").cast("bigint").alias("fleet"),
        F.max("_s.docks").cast("bigint").alias("docks"),
        F.max("deficit").cast("bigint").alias("peak_deficit"),
        F.max_by(time, F.struct("deficit", -C.micros(time))).alias("worst_ts"),
    )
    return whole.withColumn("optimal_fleet", F.col("fleet") + F.col("peak_deficit")).withColumn(
        "growth_pct", r6(100 * C.ratio(F.col("peak_deficit"), F.col("fleet")))
    )


def complete_snapshots(df, *, time="ts", min_stations=75):
    """Rows of snapshots with enough stations. ``min_stations`` may be a column of ``df``'s scalars."""
    need = min_stations if not isinstance(min_stations, int) else F.lit(min_stations)
    complete = materialise(df.groupBy(time).agg(F.count("*").alias("_n")).where(F.col("_n") >= need).select(time), "complete")
    return of_complete(df, complete, time=time)


def of_complete(df, complete, *, time="ts"):
    """The rows whose snapshot is among the ``complete`` ones, a written table of them."""
    return df.join(lookup(complete.select(time), [time]), time, "left_semi")


def frame_stats(df, *, key="station_id", time="ts", level="bikes", capacity="capacity", seconds=300, empty=D.EMPTY_BELOW):
    """Per frame: mean occupancy, stations below the threshold, bikes. Stations are averaged first."""
    frame = C.floor_time(time, seconds).alias("frame_ts")
    per_station = df.groupBy(frame, key).agg(
        F.avg(level).alias("bikes"), F.avg(C.occupancy(level, capacity)).alias("occ")
    )
    return per_station.groupBy("frame_ts").agg(
        r6(100 * F.avg("occ")).alias("occupancy_pct"),
        F.sum(C.flag(F.col("bikes") < empty)).cast("bigint").alias("empty_stations"),
        r6(F.sum("bikes")).alias("total_bikes"),
    )
