"""Ordered work per key that does not put a hot key into one task.

``lag``, ``lead``, ranks and as-of lookups need the rows of a key in time
order, and one key may own a large share of the table. A count over the key
column alone tells first whether any key has more than ``max_rows`` rows. If
none has, a plain window is the best plan: one shuffle, one sort.

Otherwise the keys that have more are told apart. The rows of the others still
take the plain window. Those of the hot ones are sorted into ranges of the key and
the whole order, ties included, and written once; a row's range is its slice.
Ranges are cut by sampled rows, so a slice has about as many rows as any other,
whether a key's rows spread over years or share an instant, and null keys and
times are rows like any other. There are as many slices as the rows ask for, but no
more than a few for each core, so that their number follows the cluster and not the
table; a slice beyond the wanted size is sorted with spilling. Each slice is then
ordered on its own and only a bounded part crosses slice borders: the first and last
rows of a slice for ``shift``, one summary row per key and slice for ``ranked`` and
``asof``. Results equal those of a plain window over the key.

The input is read once for the count; if no key is hot, once for the work; if some
are, once for the hot rows, once for the others, unless all are hot. Everything after
the written table reads that. A slice number stands in the table, so retried tasks
agree on it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.defaults import MAX_BROADCAST_ROWS, MAX_SLICE_ROWS
from fillgauge.functions.columns import micros
from fillgauge.session import lookup, materialise

SLICE = "_slice"
#: Sampled cuts are uneven, so slices are aimed lower than they may be.
SLICES_PER_MAX = 1.5
SLICES_PER_CORE = 4


@dataclass(frozen=True)
class Hot:
    """The keys with more than so many rows, a written table with null keys among them, and their rows."""

    keys: Sequence[str]
    table: DataFrame
    rows: int
    all: bool

    def parts(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of hot keys, and the others if there are any."""
        if self.all:
            return df, None
        known = lookup(self.table, list(self.keys))
        same = _same(df, known, self.keys)
        return df.join(known, same, "left_semi"), df.join(known, same, "left_anti")


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> Hot | None:
    """The keys with more than ``max_rows`` rows; None where there are none."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    many = F.col("_n") > max_rows
    all_rows, hot_rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0))).first()
    if not hot_rows:
        return None
    return Hot(list(keys), materialise(counts.where(many).select(*keys), "hot-keys"), hot_rows, hot_rows == all_rows)


def slice_count(rows: int, max_rows: int, cores: int) -> int:
    """Slices for ``rows`` rows: of the wanted size, but not more than a few for each core."""
    return max(1, min(math.ceil(SLICES_PER_MAX * rows / max_rows), SLICES_PER_CORE * cores))


def with_slice(df: DataFrame, order: Sequence[str | Column], rows: int, max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """The rows written in slices, ``_slice``, that follow ``order``.

    ``rows`` is the number of rows. Equal ones share a slice, so ``order`` ends with a tie-breaker.
    """
    slices = slice_count(rows, max_rows, df.sparkSession.sparkContext.defaultParallelism)
    return materialise(df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def shift(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    shifts: Mapping[str, tuple[str, int]],
    max_rows: int = MAX_SLICE_ROWS,
    rank: bool = False,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add columns holding another row's value: ``{out: (column, offset)}``.

    Negative offsets look back, positive ones ahead, in rows of the same key
    ordered by ``order`` (time first, then tie-breakers). Null past the ends.
    With ``rank``, ``_rank`` and ``_total`` of ``ranked`` come in the same pass.
    ``sized_by`` may name a frame with as many rows per key, or more, that is
    cheaper to count than ``df``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    across = Window.partitionBy(*keys).orderBy(*order)

    def neighbour(window):
        return {
            out: F.lag(col, -offset).over(window) if offset < 0 else F.lead(col, offset).over(window)
            for out, (col, offset) in shifts.items()
        }

    def plain(some: DataFrame) -> DataFrame:
        shifted = some.withColumns(neighbour(across))
        return _plain_rank(shifted, keys, order) if rank else shifted

    hot = hot_keys(df if sized_by is None else sized_by, keys, max_rows)
    if hot is None:
        return plain(df)
    dense, others = hot.parts(df)
    sliced = with_slice(dense, [*keys, *order], hot.rows, max_rows)
    reach = max(abs(offset) for _, offset in shifts.values())
    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = sliced.withColumns(
        neighbour(within)
        | {
            "_head": F.lag(F.lit(True), reach).over(within).isNull(),
            "_tail": F.lead(F.lit(True), reach).over(within).isNull(),
        }
    )
    if rank:
        local = _sliced_rank(local, sliced, keys, order)
    # Between two border rows of adjacent slices no other row is closer than
    # ``reach``, so neighbours of border rows are themselves border rows.
    local = materialise(local, "shifted")
    border = local.where("_head or _tail").withColumns(
        {f"_x_{out}": col for out, col in neighbour(across).items()}
    )
    for out, (_, offset) in shifts.items():
        side = "_head" if offset < 0 else "_tail"
        border = border.withColumn(out, F.when(F.col(side), F.col(f"_x_{out}")).otherwise(F.col(out)))
    border = border.drop(*[f"_x_{out}" for out in shifts])
    return _with(local.where("not (_head or _tail)").unionByName(border).drop("_head", "_tail", SLICE), others, plain)


def _with(found: DataFrame, others: DataFrame | None, plain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of hot keys, and after them the others by a plain window."""
    return found if others is None else found.unionByName(plain(others))


def _plain_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    return df.withColumn("_rank", rank).withColumn("_total", F.count("*").over(Window.partitionBy(*keys)))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in all of ``names``, where null equals null."""
    same = F.lit(True)
    for n in names:
        same = same & left[n].eqNullSafe(right[n])
    return same


def _sliced_rank(df: DataFrame, sliced: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_rank`` and ``_total``: the place within the slice plus the sizes of the key's earlier slices."""
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    sizes = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            SLICE,
            F.coalesce(
                F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    placed = df.withColumn("_place", F.row_number().over(within))
    joined = placed.join(sizes, _same(placed, sizes, [*keys, SLICE]))
    return joined.select(
        *[placed[c] for c in df.columns],
        (F.col("_before") + F.col("_place")).cast("bigint").alias("_rank"),
        "_total",
    )


def ranked(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_SLICE_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add ``_rank`` (1-based) and ``_total`` of the row within its key; ``sized_by`` as in ``shift``."""
    keys = [key] if isinstance(key, str) else list(key)
    hot = hot_keys(df if sized_by is None else sized_by, keys, max_rows)
    if hot is None:
        return _plain_rank(df, keys, order)
    dense, others = hot.parts(df)
    sliced = with_slice(dense, [*keys, *order], hot.rows, max_rows)
    found = _sliced_rank(sliced, sliced, keys, order).drop(SLICE)
    return _with(found, others, lambda some: _plain_rank(some, keys, order))


def shift_by(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    value: str,
    offset: Column,
    out: str,
    max_rows: int = MAX_SLICE_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: ``value`` of the row of the same key that is ``offset`` places ahead, an expression of the row.

    Rows are numbered once and written; a row then joins the one of its number plus
    its offset. The join is on key and number, so a key's rows spread over all tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    placed = materialise(ranked(df, keys, order, max_rows, sized_by).drop("_total").withColumn("_goal", F.col("_rank") + offset), "numbered")
    there = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_rank").alias("_there"), F.col(value).alias(out))
    same = F.col("_goal") == F.col("_there")
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(F.col(f"_k{i}"))
    return placed.join(there, same, "left").select(*[placed[c] for c in df.columns], out)


def asof(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    tie: str | None = None,
    forward: bool = False,
    max_rows: int = MAX_SLICE_ROWS,
) -> DataFrame:
    """Left rows with the ``values`` of the last right row at or before their time.

    With ``forward`` it is the first right row at or after it. ``tie`` names a
    right column that orders equal times. Adds ``_found`` (null when there is
    none) holding a struct of ``values``.
    """
    keys = list(keys)
    by = keys or ["_all"]
    key_cols = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    sign = F.lit(-1 if forward else 1)
    value = F.struct(*values)
    row = F.struct(*left.columns)
    probes = left.select(
        *key_cols,
        F.col(left_time).cast("timestamp").alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(0).cast("bigint").alias("_tie"),
        row.alias("_row"),
        F.xxhash64(row).alias("_spread"),
    )
    readings = right.select(
        *key_cols,
        F.col(right_time).cast("timestamp").alias("_at"),
        F.lit(0).alias("_side"),
        (sign * F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_tie"),
        value.alias("_value"),
    )
    both = probes.unionByName(readings, allowMissingColumns=True).withColumn("_pos", sign * micros("_at"))
    is_reading = F.col("_side") == 0
    # Probes of one instant find the same, so any order of them will do to spread them.
    order = ["_pos", "_side", "_tie"]

    def latest(*partition):
        window = Window.partitionBy(*partition).orderBy(*order)
        return F.last("_value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))

    def plain(some: DataFrame) -> DataFrame:
        return some.withColumn("_found", latest(*by)).where(~is_reading).select("_row.*", "_found")

    hot = hot_keys(both, by, max_rows)
    if hot is None:
        return plain(both)
    both, others = hot.parts(both)
    both = with_slice(both, [*by, *order, "_spread"], hot.rows, max_rows)
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct("_pos", "_side", "_tie")
    carried = (
        both.groupBy(*by, SLICE)
        .agg(F.max_by(F.when(is_reading, F.col("_value")), F.when(is_reading, last)).alias("_last"))
        .select(*by, SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    )
    local = both.withColumn("_local", latest(*by, SLICE)).where(~is_reading)
    joined = local.join(carried, _same(local, carried, [*by, SLICE]))
    return _with(joined.withColumn("_found", F.coalesce("_local", "_carry")).select("_row.*", "_found"), others, plain)


def asof_small(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tie: str,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame | None:
    """``asof`` without keys for a right side small enough to broadcast, else None.

    A reading holds from its time to the next one's. The span is cut into as
    many buckets as there are readings, so the readings spread over at most
    2 n + 1 (bucket, reading) rows; a left row looks only into its own bucket
    and is never shuffled.
    """
    at = micros(right_time)
    n, lo, hi = right.agg(F.count("*"), F.min(at), F.max(at)).first()
    if not 0 < n <= max_rows:
        return None
    width = (hi - lo) // n + 1
    last = (hi - lo) // width

    def bucket(col: str) -> Column:
        offset = F.col(col) - F.lit(lo)
        return ((offset - F.pmod(offset, F.lit(width))) / F.lit(width)).cast("bigint")

    held = (
        right.select(at.alias("_from"), F.col(tie).alias("_tie"), F.struct(*values).alias("_found"))
        .withColumn("_to", F.lead("_from").over(Window.orderBy("_from", "_tie")))
        .where("_to is null or _to > _from")
        .withColumn("_end", F.coalesce(F.col("_to") - 1, F.lit(hi)))
        .withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_end"))))
        .drop("_tie", "_end")
    )
    probes = left.withColumn("_at", micros(left_time)).withColumn(
        "_bucket", F.least(bucket("_at"), F.lit(last).cast("bigint"))
    )
    holds = (
        (probes["_bucket"] == held["_bucket"])
        & (F.col("_from") <= F.col("_at"))
        & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    )
    return probes.join(F.broadcast(held), holds, "left").select(*[probes[c] for c in left.columns], "_found")


def running_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    descending: bool = False,
    max_rows: int = MAX_SLICE_ROWS,
) -> DataFrame:
    """Running totals over a global order, for a table with one row per ``order`` value.

    The table is written once. Up to ``max_rows`` rows are one window; a larger
    table is written in slices of its order, the totals of the slices are
    accumulated first, then each slice on its own.
    """
    ordering = F.col(order).desc() if descending else F.col(order)

    def running(*partition):
        window = Window.partitionBy(*partition).orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
        return {out: F.sum(col).over(window) for out, col in sums.items()}

    df = materialise(df, "running-sums")
    rows = df.count()
    if rows <= max_rows:
        return df.withColumns(running())
    sliced = with_slice(df, [ordering], rows, max_rows)
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sliced.groupBy(SLICE)
        .agg(*[F.sum(col).alias(f"_t_{out}") for out, col in sums.items()])
        .select(
            SLICE,
            *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums],
        )
    )
    return (
        sliced.join(lookup(bases, [SLICE]), SLICE)
        .withColumns({out: F.col(f"_b_{out}") + total for out, total in running(SLICE).items()})
        .drop(SLICE, *[f"_b_{out}" for out in sums])
    )
