"""User growth: rates, curve fits of every series and regime at once, projection.

A curve is fitted to the points of one series in one regime, with time counted from
the regime's start. The parameters that enter linearly follow from the others by least
squares, so only those others are searched: from the best straight line in logarithms
or logits, over grids around the best point so far that narrow step by step. The best
point stays in the next grid, so the squared error of the counts themselves never
rises above that of the start. A series has as many points as there are months, which
is what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6

MONTH_DAYS = 30.44
YEAR_DAYS = 365.25


def months_between(start: Column, end: Column) -> Column:
    return F.bround(F.datediff(end, start) / F.lit(MONTH_DAYS), 0).cast("bigint")


def growth_metrics(df, *, series="series", time="month", users="users", uses: str | None = None):
    """Monthly growth and months since the series began; with ``uses``, how many there were per user."""
    more = [uses_per_user(F.col(uses), F.col(users)).alias("uses_per_user")] if uses else []
    w = Window.partitionBy(series).orderBy(time)
    before = F.lag(users).over(w)
    first = F.min(time).over(Window.partitionBy(series))
    return df.select(
        series,
        time,
        F.col(users).cast("bigint").alias("users"),
        r6(100 * C.ratio(F.col(users) - before, before)).alias("growth_pct"),
        months_between(first, F.col(time)).alias("months"),
        *more,
    )


def uses_per_user(uses: Column, users: Column) -> Column:
    """To one decimal, half to even."""
    return F.bround(C.ratio(uses, users), 1)


def regime_of(time: str, split_date: str | None) -> Column:
    """``pre`` before the date, ``post`` from it on; without a date, ``all``."""
    if split_date is None:
        return F.lit("all")
    return F.when(F.col(time) < F.lit(split_date).cast("timestamp_ntz"), "pre").otherwise("post")


def cagr(df, *, series="series", time="month", users="users", split_date="2022-06-01"):
    """Compound yearly growth before and from the regime date."""
    regime = regime_of(time, split_date)
    ends = df.groupBy(series, regime.alias("regime")).agg(
        F.min_by(users, time).cast("bigint").alias("first"),
        F.max_by(users, time).cast("bigint").alias("last"),
        F.datediff(F.max(time), F.min(time)).alias("days"),
    )
    years = F.col("days") / F.lit(YEAR_DAYS)
    growth = F.pow(C.ratio(F.col("last"), F.col("first")), C.ratio(F.lit(1.0), years)) - 1
    return ends.select(
        series, "regime", "first", "last", r6(years).alias("years"), r6(100 * growth).alias("cagr_pct")
    )


def _with_months(df, series: str, time: str, users: str, split_date: str | None) -> DataFrame:
    """Points ``x, y`` of each series and regime; ``x`` counts months from the regime's first."""
    rows = df.select(F.col(series).alias("series"), regime_of(time, split_date).alias("regime"), F.col(time).alias("month"), F.col(users).cast("double").alias("y"))
    first = F.min("month").over(Window.partitionBy("series", "regime"))
    return rows.withColumn("x", months_between(first, F.col("month")).cast("double"))


def _line(x: np.ndarray, z: np.ndarray) -> tuple[float, float] | None:
    """Slope and intercept of least squares."""
    n = float(len(x))
    spread = n * (x * x).sum() - x.sum() ** 2
    if not spread:
        return None
    slope = (n * (x * z).sum() - x.sum() * z.sum()) / spread
    return slope, (z.sum() - slope * x.sum()) / n


def _errors(y: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Squared error of each candidate; what is no number is out."""
    error = ((y - fitted) ** 2).sum(axis=-1)
    return np.where(np.isfinite(error), np.round(error, 6), np.inf)


def _nearest_best(errors: np.ndarray, off: np.ndarray) -> int | None:
    """The least error, of equal ones the one nearest the grid's centre, then the first."""
    k = int(np.lexsort((np.arange(len(errors)), off, errors))[0])
    return k if np.isfinite(errors[k]) else None


def _quality(y: np.ndarray, fitted: np.ndarray) -> tuple[float | None, float | None]:
    """R2 and mean relative error."""
    total = (y * y).sum() - y.sum() ** 2 / len(y)
    known = y != 0
    share = (np.abs(y - fitted)[known] / np.abs(y)[known]).mean() if known.any() else None
    return (1 - ((y - fitted) ** 2).sum() / total if total else None), share


#: Points of a grid on either side of its centre, and how much each grid is narrower than the one before.
RATE_SIDE, RATE_SHRINK, RATE_GRIDS = 8, 4.0, 6
CURVE_SIDE, CURVE_SHRINK, CURVE_GRIDS = 4, 2.0, 10


def exponential_curve(x: np.ndarray, y: np.ndarray, steps: int = 20) -> dict | None:
    """``a, b, c`` of y = a e^(b x) + c.

    For a rate b the rest is linear. The first rate is the best of lines in
    logarithms, for offsets c on a grid below the least count.
    """
    start = []
    for cand in range(steps):
        c = y.min() * cand / float(steps)
        if y.min() > c and (line := _line(x, np.log(y - c))):
            start.append((np.round(((y - (np.exp(line[1]) * np.exp(line[0] * x) + c)) ** 2).sum(), 6), cand, line[0]))
    if not start or len(x) < 3:
        return None
    rate = min(start)[2]
    width = 0.5 * abs(rate) + 0.005
    side = np.arange(-RATE_SIDE, RATE_SIDE + 1)
    with np.errstate(all="ignore"):
        for _ in range(RATE_GRIDS):
            b = rate + width * side / RATE_SIDE
            e = np.exp(b[:, None] * x)
            mean = e.mean(axis=1, keepdims=True)
            a = ((e - mean) * (y - y.mean())).sum(axis=1) / ((e - mean) ** 2).sum(axis=1)
            c = y.mean() - a * mean[:, 0]
            k = _nearest_best(_errors(y, a[:, None] * e + c[:, None]), np.abs(side))
            if k is None:
                return None
            rate, found = float(b[k]), (float(a[k]), float(b[k]), float(c[k]))
            width /= RATE_SHRINK
    a, b, c = found
    r2, mape = _quality(y, a * np.exp(b * x) + c)
    return {"a": a, "b": b, "c": c, "r2": r2, "mape": mape}


def logistic_curve(
    x: np.ndarray, y: np.ndarray, ceiling: float = 4.0, step: float = 0.01, bounds=((0.01, 0.5), (5, 50))
) -> dict | None:
    """``l, k, x0`` of y = l / (1 + e^(-k (x - x0))) with k and x0 within their bounds.

    For a pace k and a middle x0 the ceiling l is linear. The first pace and middle are
    those of the best line in logits, for ceilings in steps above the last count.
    """
    (k_lo, k_hi), (x_lo, x_hi) = bounds
    per_unit = round(1 / step)
    start = []
    with np.errstate(all="ignore"):
        for cand in range(1, round((ceiling - 1) * per_unit) + 1):
            top = y[-1] * (per_unit + cand) / float(per_unit)
            below = (y > 0) & (y < top)
            line = _line(x[below], np.log(y[below] / (top - y[below]))) if below.any() else None
            if line and line[0] and k_lo <= line[0] <= k_hi and x_lo <= -line[1] / line[0] <= x_hi:
                k, x0 = line[0], -line[1] / line[0]
                start.append((np.round(((y - top / (1 + np.exp(-k * (x - x0)))) ** 2).sum(), 6), cand, k, x0))
        if not start or len(x) < 3:
            return None
        k, x0 = min(start)[2:]
        k_width, x_width = 0.5 * k, 2.0 / k
        side = np.arange(-CURVE_SIDE, CURVE_SIDE + 1)
        i, j = (g.ravel() for g in np.meshgrid(side, side, indexing="ij"))
        for _ in range(CURVE_GRIDS):
            ks, xs = k + k_width * i / CURVE_SIDE, x0 + x_width * j / CURVE_SIDE
            g = 1 / (1 + np.exp(-ks[:, None] * (x - xs[:, None])))
            top = (y * g).sum(axis=1) / (g * g).sum(axis=1)
            errors = _errors(y, top[:, None] * g)
            inside = (ks >= k_lo) & (ks <= k_hi) & (xs >= x_lo) & (xs <= x_hi)
            best = _nearest_best(np.where(inside, errors, np.inf), np.abs(i) + np.abs(j))
            if best is None:
                return None
            k, x0, l = float(ks[best]), float(xs[best]), float(top[best])
            k_width, x_width = k_width / CURVE_SHRINK, x_width / CURVE_SHRINK
    r2, mape = _quality(y, l / (1 + np.exp(-k * (x - x0))))
    return {"l": l, "k": k, "x0": x0, "r2": r2, "mape": mape}


def _fits(points: DataFrame, names: tuple[str, ...], curve: Callable[[np.ndarray, np.ndarray], dict | None]) -> DataFrame:
    """The curve of each series and regime; nulls where none fits."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        known = rows.dropna(subset=["x", "y"]).sort_values(["month", "y"])
        found = (curve(known["x"].to_numpy(), known["y"].to_numpy()) if len(known) else None) or {}
        kept = {n: found.get(n) for n in names}
        ends = {"last_month": rows["month"].max(), "last_x": known["x"].max() if len(known) else None}
        return pd.DataFrame([{"series": first["series"], "regime": first["regime"], **kept, **ends}])

    kind = dict(points.dtypes)
    schema = f"series {kind['series']}, regime string, " + ", ".join(f"{n} double" for n in names) + f", last_month {kind['month']}, last_x double"
    return points.groupBy("series", "regime").applyInPandas(fit, schema)


def fit_exponential(df, *, series="series", time="month", users="users", steps=20, split_date=None):
    """y = a e^(b x) + c per series and regime."""
    fits = _fits(_with_months(df, series, time, users, split_date), ("a", "b", "c", "r2", "mape"), lambda x, y: exponential_curve(x, y, steps))
    return fits.select("series", "regime", *[r6(F.col(c)).alias(c) for c in ("a", "b", "c", "r2")], r6(100 * F.col("mape")).alias("mape"))


def logistic_value(x: Column, l: Column, k: Column, x0: Column) -> Column:
    return l / (1 + F.exp(-k * (x - x0)))


def logistic_params(df, *, series="series", time="month", users="users", split_date=None, **limits) -> DataFrame:
    """``l, k, x0`` per series and regime, unrounded, with the regime's last month; null where no curve is within the bounds."""
    points = _with_months(df, series, time, users, split_date)
    return _fits(points, ("l", "k", "x0", "r2", "mape"), lambda x, y: logistic_curve(x, y, **limits))


def fit_logistic(df, **kwargs):
    fits = logistic_params(df, **kwargs)
    return fits.select("series", "regime", *[r6(F.col(c)).alias(c) for c in ("l", "k", "x0", "r2")], r6(100 * F.col("mape")).alias("mape"))


def project_growth(df, *, months=24, **kwargs):
    """Each series' latest regime over the next months: whole users and saturation in % of the ceiling."""
    fits = logistic_params(df, **kwargs)
    latest = Window.partitionBy("series").orderBy(F.desc("last_month"))
    fits = fits.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    ahead = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i")
    value = logistic_value(F.col("last_x") + F.col("i"), F.col("l"), F.col("k"), F.col("x0"))
    users_then = F.floor(F.round(value, 6)).cast("bigint")
    return (
        fits.select("*", ahead)
        .select(
            "series",
            "regime",
            C.naive(F.add_months(F.to_date("last_month"), F.col("i"))).alias("month"),
            users_then.alias("users"),
            F.col("l"),
        )
        .withColumn("saturation_pct", r6(100 * C.ratio(F.col("users"), F.col("l"))))
        .drop("l")
    )
