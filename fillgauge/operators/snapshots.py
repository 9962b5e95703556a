"""Snapshots of the whole network from readings that arrive one station at a time.

Every reading falls into a frame of a few minutes; of a station's readings in a
frame the last one stands. It holds from its frame until the station's next one, or
for as long as a silent station counts as present: a span ``[ts, until)``. The state
of the network is then a sweep over the ends of the spans. What stations bring when
a span begins they take along when it ends, so sums over the ends up to a frame are
the totals of that frame, and no table of stations by frames is ever laid out. A
frame in which nothing begins or ends has the totals of the one before; ``frames``
says how many frames a row stands for.

Readings are combined before the shuffle, spans come from ``shift``, which does not
gather a hot station in a task, and ends are added up per frame before their running
totals are taken.

A reading without a time is in no frame; a null station is a station; two readings
of one time and tie-breaker leave the larger one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.defaults import FRAME_SECONDS, HOLD_FRAMES, MAX_SLICE_ROWS
from fillgauge.functions import columns as C
from fillgauge.operators.slices import running_sums, shift
from fillgauge.session import materialise


def aligned(df, *, key="station_id", time="ts", values: Sequence[str] = ("bikes", "capacity"), tie=None, seconds=FRAME_SECONDS):
    """One row per station and frame, ``time`` the start of the frame: the last reading in it."""
    order = F.struct(F.col(time), F.col(tie) if tie else F.lit(0), F.struct(*values))
    return (
        df.where(F.col(time).isNotNull())
        .groupBy(key, C.floor_time(time, seconds).alias("_frame"))
        .agg(F.max_by(F.struct(*values), order).alias("_v"))
        .select(key, F.col("_frame").alias(time), "_v.*")
    )


def spans(df, *, key="station_id", time="ts", seconds=FRAME_SECONDS, hold: int | None = HOLD_FRAMES, max_rows=MAX_SLICE_ROWS):
    """Aligned readings with ``until``, the first frame in which they do not hold any more.

    A reading ends with the station's next one, or after ``hold`` frames without
    any; with ``hold`` None the last one has no end.
    """
    ahead = shift(df, key, [time], {"_next": (time, 1)}, max_rows=max_rows)
    if hold is None:
        return ahead.withColumnRenamed("_next", "until")
    end = C.naive(F.timestamp_micros(C.micros(time) + F.lit(hold * seconds * 1_000_000)))
    return ahead.withColumn("until", F.least(F.col("_next"), end)).drop("_next")


def states(df, sums: Mapping[str, Column], *, time="ts", until="until", seconds=FRAME_SECONDS, max_rows=MAX_SLICE_ROWS) -> DataFrame:
    """Totals of the spans that hold, for each frame in which one begins or ends.

    ``sums`` are whole-number columns of a span; ``present`` counts the spans. The
    last frame is the last in which a span begins. ``frames`` is the number of
    frames up to the next row.
    """
    named = {"present": F.lit(1), **sums}
    ends = F.array(
        F.struct(F.col(time).alias("at"), F.lit(1).alias("sign")), F.struct(F.col(until).alias("at"), F.lit(-1).alias("sign"))
    )
    moves = (
        df.select(*[c.cast("bigint").alias(n) for n, c in named.items()], F.explode(ends).alias("_e"))
        .where("_e.at IS NOT NULL")
        .groupBy(F.col("_e.at").alias(time))
        .agg(*[F.sum(F.col("_e.sign") * F.col(n)).alias(f"_d_{n}") for n in named], F.max("_e.sign").alias("_begins"))
    )
    totals = materialise(running_sums(moves, time, {n: f"_d_{n}" for n in named}, max_rows=max_rows), "states")
    last = totals.where("_begins > 0").agg(F.max(time)).scalar()
    kept = totals.withColumn("_all", F.lit(0)).withColumn("_last", last).where(F.col(time) <= F.col("_last"))
    ahead = shift(kept, "_all", [time], {"_next": (time, 1)}, max_rows=max_rows)
    step = F.lit(seconds * 1_000_000)
    frames = (C.micros(F.coalesce(F.col("_next"), F.col("_last"))) - C.micros(time)) / step + F.when(F.col("_next").isNull(), 1).otherwise(0)
    return ahead.select(time, *[F.col(n).cast("bigint").alias(n) for n in named], frames.cast("bigint").alias("frames"))


def complete(states_: DataFrame, need: Column) -> DataFrame:
    """The states in which at least ``need`` stations are present."""
    return states_.where(F.col("present") >= need)
