"""Column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from fillgauge import defaults as D


def r6(value: Column) -> Column:
    """Results carry six decimals."""
    return F.round(value.cast("double"), 6)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null, never an error, on a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def naive(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def micros(time: str | Column) -> Column:
    col = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(col.cast("timestamp"))


def hour_of(time: str) -> Column:
    return F.hour(time).cast("int")


def weekday_of(time: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.to_date(F.col(time))).cast("int")


def weekend(day_of_week: Column) -> Column:
    return flag(day_of_week >= 5)


def floor_time(time: str, seconds: int) -> Column:
    us = micros(time)
    return naive(F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000))))


def occupancy(level: str = "bikes", capacity: str = "capacity", clip: bool = False) -> Column:
    """Share of the capacity in use; no capacity counts as 0."""
    share = F.coalesce(ratio(F.col(level), F.col(capacity)), F.lit(0.0))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) if clip else share


def capacity_or_sum(capacity: str, level: str, docks: str) -> Column:
    """Capacity, or level + docks where it is missing or zero."""
    return F.coalesce(F.nullif(F.col(capacity), F.lit(0)), F.col(level) + F.col(docks))


def in_ranges(hour: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    return flag(reduce(lambda a, b: a | b, [hour.between(lo, hi) for lo, hi in ranges]))


def in_service(hour: Column, open_h: int = 7, close_h: int = 1) -> Column:
    return (hour >= open_h) | (hour < close_h)


def weather_type(code: Column) -> Column:
    """WMO code to label; the first match wins."""
    return (
        F.when(code == 0, "clear")
        .when(code <= 3, "cloudy")
        .when(code.between(51, 67), "rain")
        .when(code.between(71, 77), "snow")
        .when(code.between(80, 82), "showers")
        .when(code >= 95, "storm")
        .otherwise("other")
    )


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def band(value: Column, edges: Sequence[float], labels: Sequence[str], open_ended: bool = False) -> Column:
    """Right-closed bins; outside the edges is null.

    With ``open_ended`` the outer bins reach to infinity and there is one
    more label than edges.
    """
    if open_ended:
        tops, names, last = list(edges), list(labels[:-1]), labels[-1]
        out = F.when(value.isNull(), F.lit(None).cast("string"))
    else:
        tops, names, last = list(edges[1:]), list(labels), None
        out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for top, name in zip(tops, names):
        out = out.when(value <= top, F.lit(name))
    return out.otherwise(F.lit(last)) if last is not None else out


def occupancy_level(occ: Column) -> Column:
    return F.when(occ < 0.3, "low").when(occ < 0.6, "mid").otherwise("high")


def risk_level(pct: Column) -> Column:
    return F.when(pct <= 2, "low").when(pct <= 5, "medium").when(pct <= 10, "high").otherwise("critical")


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi)))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from moment sums; null when a side does not vary."""
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return (n * sxy - sx * sy) / F.sqrt(F.when(spread > 0, spread))


def is_empty(level: str = "bikes", below: int = D.EMPTY_BELOW) -> Column:
    return flag(F.col(level) < below)


def is_full(docks: str = "docks", below: int = D.FULL_BELOW) -> Column:
    return flag(F.col(docks) < below)


def fold(key: str, folds: int) -> Column:
    """One of ``folds`` numbers by a hash of the key, so that neighbouring keys spread; the same in any engine with MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(folds))
