"""Work over all pairs of stations, done block against block.

Pair sums over a shared time axis are a matrix product. Stations are hashed
into blocks of about a thousand, the time axis into stretches of a few thousand
instants; the readings of a block and stretch are packed into one row, and a task
multiplies two blocks over one stretch after the other. It holds at most two blocks
times one stretch, and the blocks' sums. Where there are many blocks, a task holds two
groups of them instead and multiplies block by block, so packed readings are copied once
per group: as often as memory and cores ask for, not as there are blocks. Only qualifying
pairs leave a task: where the best few of all are asked for, the best few of each two
blocks. The products themselves grow with the square of the stations.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.features import bike_delta
from fillgauge.session import materialise

BLOCK = 1024
# Products of millionths summed over one stretch stay below 2**53, so they are exact.
STRETCH = 4096
# Bike changes are small numbers, far from that limit; memory sets their stretch.
CHANGE_STRETCH = 8192
# Tasks that share the stretches of one block pair: each emits all pairs of its blocks.
MAX_SPREAD = 64
# Packed readings of a group of blocks, of which a task holds two, and pairs of groups for each core.
GROUP_BYTES = 32 << 20
PAIRS_PER_CORE = 8
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def spread_of(col: Column, parts: int) -> Column:
    """The part of a value, by its hash."""
    return F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")


def in_block_pairs(packed: DataFrame, blocks: int) -> DataFrame:
    """Copy every row of a block ``_b`` to each (bi, bj) block pair it takes part in."""
    block = F.col("_b")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        packed.withColumn("_o", other)
        .withColumn("bi", F.least(block, F.col("_o")))
        .withColumn("bj", F.greatest(block, F.col("_o")))
        .drop("_o")
    )


def packer():
    """One row for the readings of a block and stretch: its stations, its instants, and by their places the values."""

    def narrow(x, kinds):
        """The bytes of whole numbers, in the first kind that holds them all."""
        fitting = (k for k in kinds if not len(x) or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
        return x.astype(next(fitting)).tobytes()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        station, s = np.unique(pdf["s"].to_numpy(), return_inverse=True)
        real = pdf["t"].notna().to_numpy()
        instant, t = np.unique(pdf["t"].to_numpy()[real].astype("int64"), return_inverse=True)
        cell = {c: [pdf[c].iloc[0]] for c in ("_b", "tb", "tg")}
        value = pdf["v"].to_numpy()[real].astype("int64")
        places = {"s": narrow(s[real], ("<u2", "<u4")), "t": narrow(t, ("<u2", "<u4"))}
        lists = {"instants": instant.astype("<i8").tobytes(), **places, "v": narrow(value, ("<i2", "<i4", "<i8"))}
        return pd.DataFrame({**cell, "names": [station], "k": [len(value)], **{c: [x] for c, x in lists.items()}})

    return pack


def block_count(stations: int, block: int = BLOCK) -> int:
    return max(1, math.ceil(stations / block))


def block_sums(present_only: bool, keep, best=None):
    """The task-side sums of block pairs: moments of all their station pairs a < b.

    Rows come sorted by block pair and stretch. A stretch is multiplied at a time
    and added to the block pair's matrices, so a task holds one stretch of two
    blocks and six matrices of a block, however long the time axis. A closure over
    numpy and pandas only, so workers need nothing else. Of the pairs that ``keep``
    keeps, ``best`` may choose again, by their names and sums.
    """
    columns = ("a", "b", *MOMENTS)

    def read(c, name):
        """One of the lists of a cell, of the kind that its length tells."""
        held, letter = getattr(c, name), "i" if name == "v" else "u"
        return np.frombuffer(held, f"<{letter}{len(held) // c.k}").astype("int64") if c.k else np.zeros(0, dtype="int64")

    def multiply(cells, bi, bj, places):
        """Sums of one stretch, rows and columns by place of the station in its block."""
        times = np.unique(np.concatenate([np.frombuffer(c.instants, "<i8") for c in cells]))

        def side(block, held):
            """Places of the block's stations, and its values and where there are any."""
            mine = [c for c in cells if c.own == block]
            at = np.array([held.setdefault(name, len(held)) for c in mine for name in c.names], dtype="int64")
            x, m = (np.zeros((len(at), max(1, len(times)))) for _ in range(2))
            first = 0
            for c in mine:
                s, t = read(c, "s") + first, read(c, "t")
                column = np.searchsorted(times, np.frombuffer(c.instants, "<i8"))[t]
                x[s, column], m[s, column] = read(c, "v"), 1.0
                first += len(c.names)
            return at, x, m

        (ai, xi, mi), (aj, xj, mj) = side(bi, places[0]), side(bj, places[1])
        if present_only:
            sums = (mi @ mj.T, xi @ mj.T, mi @ xj.T, (xi * xi) @ mj.T, mi @ (xj * xj).T, xi @ xj.T)
        else:  # a missing value is 0, so these are the stations' own, added up once
            sums = (*(z.sum(1)[:, None] for z in (xi, xj, xi * xi, xj * xj)), xi @ xj.T)
        return (ai, aj), [np.rint(z).astype("int64") for z in sums]

    def grown(matrix, shape):
        """The matrix with room for more stations."""
        if matrix.shape[0] >= shape[0] and matrix.shape[1] >= shape[1]:
            return matrix
        wide = np.zeros([max(2 * h, n) if n > h else h for h, n in zip(matrix.shape, shape)], dtype="int64")
        wide[: matrix.shape[0], : matrix.shape[1]] = matrix
        return wide

    def emit(bi, bj, places, totals):
        names = [np.array(list(p)) for p in places]
        ni, nj = len(names[0]), len(names[1])
        if present_only:
            n, sx, sy, sxx, syy, sxy = (z[:ni, :nj] for z in totals)
        else:
            n = np.zeros((ni, nj), dtype="int64")
            sx, sxx = (np.broadcast_to(totals[k][:ni, :1], (ni, nj)) for k in (0, 2))
            sy, syy = (np.broadcast_to(totals[k][:nj, :1].T, (ni, nj)) for k in (1, 3))
            sxy = totals[4][:ni, :nj]
        wanted = np.ones((ni, nj), dtype=bool)
        if bi == bj:
            wanted = names[0][:, None] < names[1][None, :]
        if keep is not None:
            wanted &= keep(*(z.astype("float64") for z in (n, sx, sy, sxx, syy, sxy)))
        i, j = np.nonzero(wanted)
        a, b = names[0][i], names[1][j]
        swap = a > b
        n_, sx_, sy_, sxx_, syy_, sxy_ = (z[i, j] for z in (n, sx, sy, sxx, syy, sxy))
        rows = (
            np.where(swap, b, a), np.where(swap, a, b), n_, np.where(swap, sy_, sx_), np.where(swap, sx_, sy_),
            np.where(swap, syy_, sxx_), np.where(swap, sxx_, syy_), sxy_,
        )
        if best is not None and len(i):
            chosen = best(*rows)
            rows = tuple(z[chosen] for z in rows)
        return pd.DataFrame({c: z.astype(object) if z.dtype.kind == "U" else z for c, z in zip(columns, rows)})

    def add(cells, bi, bj, places, totals):
        at, sums = multiply(cells, bi, bj, places)
        for k, z in enumerate(sums):
            rows = at[1] if not present_only and k in (1, 3) else at[0]
            cols = at[1] if present_only or k == 4 else np.zeros(1, dtype="int64")
            if not len(rows) or not len(cols):
                continue
            totals[k] = grown(totals[k], (rows.max() + 1, cols.max() + 1))
            totals[k][np.ix_(rows, cols)] += z

    def shaped(places, totals):
        for k in range(len(totals)):
            rows = len(places[1]) if not present_only and k in (1, 3) else len(places[0])
            cols = len(places[1]) if present_only or k == 4 else 1
            totals[k] = grown(totals[k], (rows, cols))

    def run(frames):
        held, now, places, totals = [], None, None, None

        def stretch_done():
            if held:
                add(held, now[0], now[1], places, totals)
                held.clear()

        for pdf in frames:
            for part in pdf.itertuples(index=False, name="Cell"):
                cell = (part.bi, part.bj, part.tb)
                if cell != now:
                    stretch_done()
                    if now is not None and cell[:2] != now[:2]:
                        shaped(places, totals)
                        yield emit(now[0], now[1], places, totals)
                        now = None
                    if now is None:
                        places = ({}, {})
                        totals = [np.zeros((0, 0), dtype="int64") for _ in range(6 if present_only else 5)]
                    now = cell
                held.append(part)
        if now is not None:
            stretch_done()
            shaped(places, totals)
            yield emit(now[0], now[1], places, totals)

    return run


def float_filter(accept, instants: int | None = None):
    """An early filter on the float correlation; ``instants`` replaces the shared count."""

    def keep(n, sx, sy, sxx, syy, sxy):
        count = n if instants is None else float(instants)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (count * sxy - sx * sy) / np.sqrt((count * sxx - sx * sx) * (count * syy - sy * sy))
        return accept(n, r)

    return keep


def best_few(n: int, lowest: float | None, highest: float | None = None, min_n: int = 0, instants: int | None = None):
    """Of pairs the ``n`` of least correlation below ``lowest`` and of greatest above ``highest``, ties to the first names.

    Where 64 bits hold the whole numbers of ``exact_pearson``, the correlations here
    are its own, so no other pair is among the best of all. Pairs whose sixth decimal
    rounding may turn either way stay, and where 64 bits do not suffice all do.
    """

    def choose(a, b, n_, sx, sy, sxx, syy, sxy):
        count = n_ if instants is None else np.full(len(n_), instants, dtype="int64")
        if float(count.max()) * float(max(sxx.max(), syy.max())) >= 2.0**62:
            return np.ones(len(a), dtype=bool)
        cov, vx, vy = count * sxy - sx * sy, count * sxx - sx * sx, count * syy - sy * sy
        with np.errstate(divide="ignore", invalid="ignore"):
            millionths = cov / (np.sqrt(vx.astype("float64")) * np.sqrt(vy.astype("float64"))) * 1e6
        real, whole = (vx > 0) & (vy > 0) & (n_ >= min_n), np.rint(millionths)
        unsure = np.abs(np.abs(millionths - whole) - 0.5) < 1e-3
        chosen = np.zeros(len(a), dtype=bool)
        for bound, sign in ((lowest, 1), (highest, -1)):
            if bound is None:
                continue
            there = np.flatnonzero(real & (sign * (whole - bound * 1e6) < 2))
            rank = sign * whole[there]
            if len(there) > n:
                near = rank <= np.partition(rank, n - 1)[n - 1] + 1
                there, rank = there[near], rank[near]
            chosen[there[unsure[there]]] = True
            there, rank = there[~unsure[there]], rank[~unsure[there]]
            chosen[there[np.lexsort((b[there], a[there], rank))[: n]]] = True
        return chosen

    return choose


def pair_moments(
    df: DataFrame,
    stations: int,
    instants: int,
    *,
    present_only: bool,
    keep=None,
    best=None,
    block: int = BLOCK,
    stretch: int = STRETCH,
) -> DataFrame:
    """Moment sums per station pair of a frame (s, t bigint, v bigint), one row per (s, t).

    ``stations`` and ``instants`` are about how many of each there are.
    ``present_only`` sums over instants where both stations have a value (and
    counts them in ``n``); otherwise a missing value is 0. ``keep`` may discard
    pairs by their sums and must keep every pair the caller wants: only these
    leave a task, and of these only what ``best`` chooses of each two blocks. Where there are fewer block pairs than tasks, the stretches of
    one are dealt to several tasks, and their sums, then bounded by the tasks and
    not by the data, are added before ``keep`` looks at them; ``best`` is left out there.
    """
    blocks, stretches = block_count(stations, block), block_count(instants, stretch)
    spread = min(stretches, MAX_SPREAD, max(1, df.sparkSession.sparkContext.defaultParallelism // (blocks * (blocks + 1) // 2)))
    cells = df.select(spread_of(F.col("s"), blocks).alias("_b"), "s", "t", "v", spread_of(F.col("t"), stretches).alias("tb"))
    cells = cells.withColumn("tg", F.pmod("tb", F.lit(spread)))
    if not present_only and spread > 1:
        # A station silent in a group of stretches still pairs with the others there.
        silent = (
            cells.select("_b", "s")
            .distinct()
            .select("_b", "s", F.lit(None).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("v"), F.lit(-1).alias("tb"))
            .withColumn("tg", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        )
        cells = cells.unionByName(silent)
    kind = dict(df.dtypes)["s"]
    schema = f"a {kind}, b {kind}, " + ", ".join(f"{c} bigint" for c in MOMENTS)
    lists = "k int, instants binary, s binary, t binary, v binary"
    packed = cells.groupBy("_b", "tb", "tg").applyInPandas(packer(), f"_b int, tb int, tg int, names array<{kind}>, {lists}")
    packed = materialise(packed, "packed")
    together = group_blocks(packed, blocks) if spread == 1 else 1
    if together > 1:
        groups = math.ceil(blocks / together)
        grouped = packed.withColumnRenamed("_b", "own").withColumn("_b", F.floor(F.col("own") / together).cast("int"))
        copies = in_block_pairs(grouped, groups).withColumnsRenamed({"_b": "own_group", "bi": "gi", "bj": "gj"})
        dealt = copies.repartition(groups * (groups + 1) // 2, "gi", "gj").sortWithinPartitions("gi", "gj", "own", "tb")
        return dealt.mapInPandas(by_block_pair(block_sums(present_only, keep, best)), schema)
    packed = in_block_pairs(packed, blocks).withColumnRenamed("_b", "own")
    dealt = packed.repartition("bi", "bj", "tg").sortWithinPartitions("bi", "bj", "tg", "tb")
    if spread == 1:
        return dealt.mapInPandas(block_sums(present_only, keep, best), schema)
    parts = dealt.mapInPandas(by_group(block_sums(present_only, None)), schema)
    return _kept(parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in MOMENTS]), keep, schema)


def group_blocks(packed: DataFrame, blocks: int) -> int:
    """Blocks whose packed readings a group may hold, as long as there are pairs of groups enough for the cores."""
    size = sum((F.length(c) for c in ("instants", "s", "t", "v")), 8 * F.size("names"))
    largest = packed.groupBy("_b").agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0] or 1
    apart = math.ceil(math.sqrt(2 * PAIRS_PER_CORE * packed.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(GROUP_BYTES // largest, blocks // apart))


def by_block_pair(run):
    """``run`` for each two blocks of the pairs of groups of a task, one pair of groups held at a time."""

    def blocks_of(held, both):
        """Each two blocks that this pair of groups has to join: those of one group with each other, or one of each."""
        mine = {own: rows for own, rows in pd.concat(held).groupby("own", sort=True)}
        side = {own: int(rows["own_group"].iloc[0]) for own, rows in mine.items()}
        for bi, bj in itertools.combinations_with_replacement(sorted(mine), 2):
            if (side[bi], side[bj]) == both:
                rows = mine[bi] if bi == bj else pd.concat([mine[bi], mine[bj]])
                yield rows.sort_values("tb", kind="stable").assign(bi=bi, bj=bj)

    def each(frames):
        held, now = [], None
        for pdf in frames:
            for both, part in pdf.groupby(["gi", "gj"], sort=False):
                if both != now and held:
                    yield from run(blocks_of(held, now))
                    held = []
                now = both
                held.append(part)
        if held:
            yield from run(blocks_of(held, now))

    return each


def by_group(run):
    """``run`` for each group of stretches of a task in turn."""

    def each(frames):
        def pieces():
            for pdf in frames:
                yield from ((group, part) for group, part in pdf.groupby(["bi", "bj", "tg"], sort=False))

        for _, some in itertools.groupby(pieces(), key=lambda p: p[0]):
            yield from run(part for _, part in some)

    return each


def _kept(pairs: DataFrame, keep, schema: str) -> DataFrame:
    """The pairs that ``keep`` keeps."""
    if keep is None:
        return pairs

    def kept(frames):
        for pdf in frames:
            yield pdf[keep(*(pdf[c].to_numpy(dtype="float64") for c in MOMENTS))]

    return pairs.select("a", "b", *MOMENTS).mapInPandas(kept, schema)


def exact_pearson(n: Column) -> Column:
    """Correlation from whole-number sums; the products are taken in decimals, so exactly."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in MOMENTS[1:]}
    n = n.cast("decimal(12,0)")
    cov = (n * wide["sxy"] - wide["sx"] * wide["sy"]).cast("double")
    vx = (n * wide["sxx"] - wide["sx"] * wide["sx"]).cast("double")
    vy = (n * wide["syy"] - wide["sy"] * wide["sy"]).cast("double")
    spread = F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))
    return cov / spread


def infer_flows(df, *, key="station_id", time="ts", level="bikes", max_r=-0.15, n=60, tie=None, block=BLOCK, stretch=CHANGE_STRETCH):
    """Station pairs whose changes oppose each other, strongest first.

    A station without a change at an instant counts as change 0; instants where
    no station has a known change do not count.
    """
    rows = df.select(key, time, level, (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    moves = materialise(
        bike_delta(rows, key=key, time=time, level=level, tie="_tie")
        .where("delta is not null")
        .groupBy(F.col(key).alias("s"), C.micros(time).alias("t"))
        .agg(F.min_by("delta", "_tie").alias("v")),
        "moves",
    )
    stations, instants = moves.agg(F.approx_count_distinct("s"), F.count_distinct("t")).first()
    changes = moves.where("v <> 0")

    keep = float_filter(lambda n_, r: ~(r > max_r + 1e-6), instants)
    best = best_few(n, max_r, instants=instants)
    sums = pair_moments(changes, stations, instants, present_only=False, keep=keep, best=best, block=block, stretch=stretch)
    sums = sums.withColumn("_n", F.lit(instants))
    return (
        sums.withColumn("r", r6(exact_pearson(F.col("_n"))))
        .where(F.col("r") < max_r)
        .select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.abs("r").alias("strength"))
        .orderBy(F.col("strength").desc(), "from_id", "to_id")
        .limit(n)
    )


def twin_stations(
    df, *, key="station_id", time="ts", level="bikes", capacity="capacity", opp=-0.6, twin=0.95, n=10, min_overlap=2, **sizes
):
    """Pairs of stations that fill together, or against each other, hour by hour.

    Correlation uses the hours both stations report. Hourly occupancy enters in
    millionths, so all sums are whole numbers and a constant series is seen as such.
    """
    us = C.micros(time)
    hourly = materialise(
        df.groupBy(F.col(key).alias("s"), (us - F.pmod(us, F.lit(3_600_000_000))).alias("t"))
        .agg(F.round(F.avg(C.occupancy(level, capacity)) * 1_000_000).cast("bigint").alias("v")),
        "hourly",
    )

    size = hourly.agg(F.approx_count_distinct("s"), F.approx_count_distinct("t")).first()
    keep = float_filter(lambda n_, r: (n_ >= min_overlap) & ~((r > opp + 1e-3) & (r < twin - 1e-3)))
    pairs = (
        pair_moments(hourly, *size, present_only=True, keep=keep, best=best_few(n, opp, twin, min_overlap), **sizes)
        .where(F.col("n") >= min_overlap)
        .withColumn("r", r6(exact_pearson(F.col("n"))))
        .where((F.col("r") < opp) | (F.col("r") > twin))
        .select("a", "b", "r", F.col("n").alias("n_hours"))
    )
    pairs = materialise(pairs, "pairs")
    return _ranked_pairs(pairs, F.col("r") < opp, "opposite", n, False).unionByName(
        _ranked_pairs(pairs, F.col("r") > twin, "twin", n, True)
    )


def _ranked_pairs(pairs: DataFrame, condition: Column, kind: str, n: int, descending: bool) -> DataFrame:
    order = [F.col("r").desc() if descending else F.col("r"), F.col("a"), F.col("b")]
    best = pairs.where(condition).orderBy(*order).limit(n)
    return best.select(
        F.lit(kind).alias("kind"),
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "a",
        "b",
        "r",
        "n_hours",
    )
