"""Mixture-controlled packing of documents into sequences by deficit round-robin.

Every source is a queue of token ids. A window of several sequences visits the
queues in the order of their names and takes from each its share of the window,
plus or minus what the earlier windows owe it, so every window has the target
proportions to within a few ids and no deficit grows. Documents are cut freely;
nothing is padded but a last sequence.

The round-robin is a tournament of two-queue rounds: of ``n`` ids served so far,
the left half of the queues gets ``n * left // (left + right)``. The remainder
is the deficit counter between the halves; it is carried from id to id, and so
over windows. As it has this closed form, the deficits with which any window
starts follow from its number alone. Every task, whichever documents it holds,
finds the windows of its documents without passing through earlier ones, so
deficits also carry over partitions.

A document's place in its queue is a prefix sum: over the partitions' counts of
each source, then within the partition. Queues keep the order of the written
ids, and no key brings documents together, so a hot source costs nothing more.

Target proportions default to those of the data: then all queues end together.
With others, the mixture holds until a queue ends, and is then scaled to the
rest; sources without a target come last. Per source, the driver and the tasks
hold one count, so more than ``MAX_SOURCES`` are refused.

Results in special cases: a null text is empty; an empty one is its end id
alone; a null source is the empty source; null or repeated document ids stay as
they are, each row being a document; other columns are not carried; an empty
table gives no sequences. The ids past the last full sequence form sequences of
falling powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common, tokens

SEQUENCE = 1024
#: Sequences in a window of the mixture.
WINDOW = 64
#: Sources at most: the driver and every task hold a count of each.
MAX_SOURCES = 100_000

ENCODED = pa.schema([
    ("part", pa.int64()), ("source", pa.string()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()),
    ("local", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
])
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


@dataclass(frozen=True)
class Phase:
    """A stretch of the output in which the proportions are constant."""

    base: int
    counts: tuple[int, ...]  # ids of each queue in it
    used: tuple[int, ...]  # ids of each queue before it

    @property
    def size(self) -> int:
        return sum(self.counts)


def phases(totals: list[int], targets: list[Fraction]) -> list[Phase]:
    """Until the first queue ends the mixture is ``targets``, then it is scaled to the others."""
    left, used, base, out = list(totals), [0] * len(totals), 0, []
    while any(left):
        live = [p if n else Fraction(0) for p, n in zip(targets, left)]
        if any(live):
            scale = min(Fraction(n) / p for n, p in zip(left, live) if p)
            counts = [min(n, int(scale * p)) for n, p in zip(left, live)]
        else:
            counts = list(left)
        if not any(counts):  # less than an id of each: the rest in its own proportions
            counts = [n if p else 0 for n, p in zip(left, live)]
        out.append(Phase(base, tuple(counts), tuple(used)))
        base += sum(counts)
        left = [n - c for n, c in zip(left, counts)]
        used = [u + c for u, c in zip(used, counts)]
    return out


class Tournament:
    """How many of the first ``n`` ids of a phase each queue gives."""

    def __init__(self, counts: tuple[int, ...]):
        self.sums = [0]
        for c in counts:
            self.sums.append(self.sums[-1] + c)

    def served(self, queue: int, n: int) -> tuple[int, int]:
        """Ids of the queues before ``queue``, and of ``queue``, among the first ``n``."""
        low, high, before = 0, len(self.sums) - 1, 0
        while high - low > 1:
            middle = (low + high) // 2
            both = self.sums[high] - self.sums[low]
            left = n * (self.sums[middle] - self.sums[low]) // both if both else 0
            if queue < middle:
                high, n = middle, left
            else:
                low, before, n = middle, before + left, n - left
        return before, n

    def window(self, queue: int, place: int, size: int) -> int:
        """The window of ``size`` ids in which the queue gives its id number ``place``."""
        low, high = 0, (self.sums[-1] - 1) // size
        while low < high:
            middle = (low + high) // 2
            if self.served(queue, min((middle + 1) * size, self.sums[-1]))[1] > place:
                high = middle
            else:
                low = middle + 1
        return low


class Plan:
    """Where the ids of every queue go."""

    def __init__(self, totals: Mapping[str, int], targets: Mapping[str, float] | None, sequence: int, window: int):
        self.queues = {s: k for k, s in enumerate(sorted(totals))}
        counts = [totals[s] for s in self.queues]
        shares = [Fraction(n) for n in counts] if targets is None else [Fraction(targets.get(s, 0)) for s in self.queues]
        self.phases = phases(counts, shares)
        self.rounds = [Tournament(p.counts) for p in self.phases]
        self.window = sequence * window
        self.sequence = sequence
        self.total = sum(counts)
        # past the last full sequence: falling powers of two
        self.full = self.total // sequence
        self.tail = [self.full * sequence]
        while rest := self.total - self.tail[-1]:
            self.tail.append(self.tail[-1] + (1 << (rest.bit_length() - 1)))

    def spans(self, source: str, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """``(place in the queue, place in the output, length)`` of each run of ids without a break."""
        queue, end = self.queues[source], start + length
        for phase, turns in zip(self.phases, self.rounds):
            first, last = phase.used[queue], phase.used[queue] + phase.counts[queue]
            at, stop = max(start, first), min(end, last)
            if at >= stop:
                continue
            w = turns.window(queue, at - first, self.window)
            while at < stop:
                opens, closes = w * self.window, min((w + 1) * self.window, phase.size)
                before, given = turns.served(queue, opens)
                before_then, given_then = turns.served(queue, closes)
                here = min(stop, first + given_then)
                if here > at:
                    yield at, phase.base + opens + (before_then - before) + (at - first - given), here - at
                    at, w = here, w + 1
                else:  # a rare source: on to the window that has its next id
                    w = turns.window(queue, at - first, self.window)

    def cuts(self, place: int, length: int) -> Iterator[tuple[int, int, int]]:
        """``(sequence, offset, length)`` of a run of the output, cut at the sequences' ends."""
        end = place + length
        while place < end:
            if place < self.tail[0]:
                number, opens = place // self.sequence, place // self.sequence * self.sequence
                closes = opens + self.sequence
            else:
                k = bisect_right(self.tail, place) - 1
                number, opens, closes = self.full + k, self.tail[k], self.tail[k + 1]
            stop = min(end, closes)
            yield number, place - opens, stop - place
            place = stop


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document and its place among those of its source in this partition."""
    part = TaskContext.get().partitionId()
    coder = tokens.loaded(tokenizer)
    end = np.array([end_id], coder.kind).tobytes()
    given: dict[str, int] = {}
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source"))))
        for some in common.sliced(rows, lambda r: len(r[1])):
            out = []
            for (doc, _, source), ids in zip(some, coder.encode([t for _, t, _ in some])):
                n = len(ids) // coder.width + 1
                out.append((part, source, doc, n, given.get(source, 0), coder.width, ids + end))
                given[source] = given.get(source, 0) + n
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), ENCODED)], schema=ENCODED)


def _cut(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    names = ("source", "doc_id", "doc_tokens", "place", "width", "ids")
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
        for some in common.sliced(rows, lambda r: 4 * r[2]):
            out = []
            for source, doc, n, place, width, data in some:
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                for at, to, length in plan.spans(source, place, n):
                    for number, offset, size in plan.cuts(to, length):
                        a = at - place
                        out.append((doc, source, a, size, n, number, offset, ids[a : a + size].tobytes()))
                        at += size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)


def pack(
    docs: DataFrame, tokenizer: str, targets: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", end_id: int = 0, sequence: int = SEQUENCE, window: int = WINDOW,
) -> DataFrame:
    """The pieces of the packed sequences.

    ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids``: the
    ids of a piece as little-endian unsigned 32-bit integers, its place in its
    document and in its sequence. ``targets`` are weights by source.
    """
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(
        common.column(id_col).cast("long").alias("doc_id"), F.coalesce(common.column(text_col), F.lit("")).alias("text"),
        F.coalesce(common.column(source_col).cast("string"), F.lit("")).alias("source"),
    )
    path = session.shared_dir(spark, "packing")
    kind = "part long, source string, doc_id long, doc_tokens long, local long, width int, ids binary"
    rows.mapInArrow(lambda b: _encode(b, tokenizer, end_id), kind).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(kind).parquet(path)

    counts = session.materialise(encoded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("given")), "packing-counts")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source", "part", F.coalesce(F.sum("given").over(earlier), F.lit(0)).alias("base"))
    by_source = counts.groupBy("source").agg(F.sum("given").alias("given"))
    totals = {r["source"]: r["given"] for r in by_source.limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name a coarser column than {source_col}")
    plan = Plan(totals, targets, sequence, window)
    placed = encoded.join(session.lookup(bases, ["source", "part"]), ["source", "part"]).withColumn("place", F.col("base") + F.col("local"))
    placed = placed.select("source", "doc_id", "doc_tokens", "place", "width", "ids")
    return placed.mapInArrow(
        lambda b: _cut(b, plan),
        "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
