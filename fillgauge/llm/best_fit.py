"""Best-fit packing of documents into sequences under several capacities at once.

A sequence holds so many tokens, so many documents, and so much attention cost,
which for a piece of ``n`` tokens is ``n * n`` (its pairs, when documents do not
see each other). A piece is the vector of its three demands, a sequence the vector
of what is left of its three capacities. Pieces go in order of falling size, each
to the sequence that fits it best among those with room in every one of the three:

* ``norm``: the weighted norm of what would be left is the least;
* ``dot``: the weighted product of the demands with what is left is the greatest.

A dimension weighs what pieces demand of it on average. A new sequence is opened
only when no open one has room.

A piece's demands follow from its length, and two sequences with the same left are
the same to all that comes. So the choices are made once for all pieces of a length
and all sequences of a kind, on a histogram of lengths: as many rows as a sequence
has tokens, whatever the corpus. The outcome, for each length, is a list of runs:
the pieces from this rank on go to sequences from this number on, so many to each,
at this offset. A piece finds its place from its rank among the pieces of its
length, a prefix sum over the partitions. No group of documents ever comes
together, so no length can be hot, and the result is that of one best-fit over
everything.

Results in special cases: a null text is empty; an empty one is its end id alone;
null or repeated document ids stay as they are, each row being a document; other
columns are not carried; an empty table gives no sequences. A document longer than
a sequence is cut into whole sequences after a first piece with the rest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common, tokens


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The cost must admit a piece of all its tokens."""

    tokens: int = 2_048
    documents: int = 512
    cost: int = 2_048**2

    def __post_init__(self):
        if min(self.tokens, self.documents) < 1 or self.cost < self.tokens**2:
            raise ValueError(f"{self} has no room for a piece of {self.tokens} tokens")


def demand(length: int) -> tuple[int, int, int]:
    """Tokens, documents and attention cost of a piece."""
    return length, 1, length * length


def weights(counts: Mapping[int, int], capacity: Capacity) -> tuple[float, float, float]:
    """The average demand of a piece in each dimension, as a share of the capacity."""
    pieces = max(1, sum(counts.values()))
    totals = [sum(demand(n)[d] * c for n, c in counts.items()) for d in range(3)]
    return tuple(t / pieces / c for t, c in zip(totals, (capacity.tokens, capacity.documents, capacity.cost)))


def unfit(left, length: int, capacity: Capacity, weight: tuple[float, float, float], fit: str):
    """How badly a piece fits sequences with ``left`` (a number, or an array of them, for each dimension)."""
    rates = (capacity.tokens, capacity.documents, capacity.cost)
    have = [x / c for x, c in zip(left, rates)]
    want = [x / c for x, c in zip(demand(length), rates)]
    if fit == "dot":
        return -(weight[0] * want[0] * have[0] + weight[1] * want[1] * have[1] + weight[2] * want[2] * have[2])
    rest = [h - w for h, w in zip(have, want)]
    return weight[0] * rest[0] * rest[0] + weight[1] * rest[1] * rest[1] + weight[2] * rest[2] * rest[2]


class Kinds:
    """The open sequences, by what is left of them."""

    def __init__(self):
        self.left = np.empty((3, 64), np.int64)
        self.size = 0
        self.runs: list[list[tuple[int, int]]] = []  # first number and how many, for each kind
        self.at: dict[tuple[int, int, int], int] = {}

    def add(self, left: tuple[int, int, int], runs: list[tuple[int, int]]) -> None:
        if left in self.at:
            self.runs[self.at[left]] += runs
            return
        if self.size == self.left.shape[1]:
            self.left = np.concatenate((self.left, np.empty_like(self.left)), axis=1)
        self.left[:, self.size] = left
        self.at[left] = self.size
        self.runs.append(list(runs))
        self.size += 1

    def sweep(self) -> None:
        """Forget kinds that no sequence has any more, and those without room for anything."""
        keep = [k for k in range(self.size) if self.runs[k] and self.left[0, k] and self.left[1, k]]
        self.left[:, : len(keep)] = self.left[:, keep]
        self.runs = [self.runs[k] for k in keep]
        self.size = len(keep)
        self.at = {tuple(x): k for k, x in enumerate(self.left[:, : self.size].T.tolist())}


@dataclass(frozen=True)
class Plan:
    """For each length its runs: first rank, pieces to a sequence, first sequence, offset."""

    runs: dict[int, np.ndarray]
    sequences: int

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """The sequence and offset of a piece."""
        table = self.runs[length]
        first, each, sequence, offset = table[:, np.searchsorted(table[0], rank, "right") - 1].tolist()
        return sequence + (rank - first) // each, offset + (rank - first) % each * length


def plan(counts: Mapping[int, int], capacity: Capacity = Capacity(), fit: str = "norm") -> Plan:
    """Places for ``counts[n]`` pieces of each length ``n``, by falling length."""
    if fit not in ("norm", "dot"):
        raise ValueError(f"fit is norm or dot, not {fit}")
    weight = weights(counts, capacity)
    kinds, opened, found = Kinds(), 0, {}
    whole = (capacity.tokens, capacity.documents, capacity.cost)
    for length in sorted(counts, reverse=True):
        want = demand(length)
        remain, rank, runs = counts[length], 0, []

        def fill(left: tuple[int, int, int], some: list[tuple[int, int]], each: int) -> None:
            """Put ``each`` pieces into all of ``some`` sequences."""
            nonlocal remain, rank
            for first, n in some:
                runs.append((rank, each, first, capacity.tokens - left[0]))
                rank += n * each
                remain -= n * each
            kinds.add(tuple(x - each * d for x, d in zip(left, want)), some)

        kinds.sweep()
        while remain:
            held = kinds.left[:, : kinds.size]
            room = np.flatnonzero((held[0] >= want[0]) & (held[1] >= want[1]) & (held[2] >= want[2]) & np.array([bool(r) for r in kinds.runs], bool))
            if len(room):
                some = held[:, room]
                key = unfit(some, length, capacity, weight, fit)
                k = int(room[np.lexsort((some[2], some[1], some[0], key))[0]])
                left = tuple(held[:, k].tolist())
                # a sequence that got a piece and now fits the next one better goes on
                each, now, after = 1, unfit(left, length, capacity, weight, fit), left
                while all(x >= 2 * d for x, d in zip(after, want)):
                    after = tuple(x - d for x, d in zip(after, want))
                    if unfit(after, length, capacity, weight, fit) >= now:
                        break
                    each += 1
                runs_of, kinds.runs[k] = kinds.runs[k], []
            else:
                left, each = whole, min(x // d for x, d in zip(whole, want))
                runs_of = [(opened, max(1, remain // each))]
                opened += runs_of[0][1]
            # of the sequences of this kind, those that the pieces fill; the last pieces may not fill one
            taken, rest = [], []
            many = remain // each
            for first, n in runs_of:
                use = min(n, many)
                many -= use
                taken += [(first, use)] if use else []
                rest += [(first + use, n - use)] if n > use else []
            if taken:
                fill(left, taken, each)
            if rest and 0 < remain < each:
                fill(left, [(rest[0][0], 1)], remain)
                rest = [(rest[0][0] + 1, rest[0][1] - 1), *rest[1:]] if rest[0][1] > 1 else rest[1:]
            if rest:
                kinds.add(left, rest)
        found[length] = np.array(runs, np.int64).T
    return Plan(found, opened)


ENCODED = pa.schema([
    ("part", pa.int64()), ("doc_id", pa.int64()), ("head", pa.int64()), ("wholes", pa.int64()),
    ("head_rank", pa.int64()), ("whole_rank", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
])
KIND = "part long, doc_id long, head long, wholes long, head_rank long, whole_rank long, width int, ids binary"
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document, its pieces' lengths, and their ranks among those of this partition."""
    part = TaskContext.get().partitionId()
    coder = tokens.loaded(tokenizer)
    end = np.array([end_id], coder.kind).tobytes()
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
        for some in common.sliced(rows, lambda r: len(r[1])):
            out = []
            for (doc, _), ids in zip(some, coder.encode([t for _, t in some])):
                n = len(ids) // coder.width + 1
                head = (n - 1) % most + 1
                wholes = (n - head) // most
                head_rank = seen[head]
                seen[head] += 1
                out.append((part, doc, head, wholes, head_rank, seen[most], coder.width, ids + end))
                seen[most] += wholes
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), ENCODED)], schema=ENCODED)


def _cut(batches: Iterator[pa.RecordBatch], found: Plan, most: int) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "head", "wholes", "head_rank", "whole_rank", "width", "ids")
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
        for some in common.sliced(rows, lambda r: 4 * len(r[6]) // r[5]):
            out = []
            for doc, head, wholes, head_rank, whole_rank, width, data in some:
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                at = 0
                for k in range(wholes + 1):
                    size = most if k else head
                    sequence, offset = found.place(size, whole_rank + k - 1 if k else head_rank)
                    out.append((doc, k, at, size, sequence, offset, ids[at : at + size].tobytes()))
                    at += size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)


def pack(
    docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), fit: str = "norm", id_col: str = "doc_id",
    text_col: str = "text", end_id: int = 0,
) -> DataFrame:
    """The pieces of the packed sequences.

    ``doc_id, piece, start, length, sequence_id, offset, ids``: the ids of a piece
    as little-endian unsigned 32-bit integers, its place in its document and in its
    sequence. Sequences are numbered from 0 without gaps.
    """
    spark = common.prepare(docs.sparkSession)
    most = capacity.tokens
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    path = session.shared_dir(spark, "best-fit")
    rows.mapInArrow(lambda b: _encode(b, tokenizer, end_id, most), KIND).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(KIND).parquet(path)

    # how many pieces of each length a partition has: no more rows than it has documents, nor than lengths
    pieces = F.explode(F.array(
        F.struct(F.col("head").alias("length"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(most).cast("long").alias("length"), F.col("wholes").alias("n")),
    ))
    counts = session.materialise(
        encoded.select("part", pieces.alias("p")).groupBy("part", F.col("p.length").alias("length")).agg(F.sum("p.n").alias("n")), "best-fit-counts"
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    whole = F.max(F.when(F.col("length") == most, F.col("base"))).over(Window.partitionBy("part"))
    bases = session.materialise(bases.select("part", F.col("length").alias("head"), "base", whole.alias("whole_base")), "best-fit-bases")
    # one row for each length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    found = plan(histogram, capacity, fit)
    placed = encoded.join(session.lookup(bases, ["part", "head"]), ["part", "head"]).select(
        "doc_id", "head", "wholes", (F.col("base") + F.col("head_rank")).alias("head_rank"),
        (F.col("whole_base") + F.col("whole_rank")).alias("whole_rank"), "width", "ids",
    )
    return placed.mapInArrow(
        lambda b: _cut(b, found, most),
        "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary",
    )
