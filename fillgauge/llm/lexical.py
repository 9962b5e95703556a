"""Ranked lexical search over an index stratified by document length.

A term's part in a document's score follows from its frequency ``tf`` there and
from the document's normaliser ``m``, which grows with its length. Documents of
equal ``m`` form a stratum. In it a term's postings are runs of equal ``tf``, the
highest first, so a part is computed once for a run, and the first run tells the
most that the term can add to any document of the stratum.

``build`` writes the index: a stratum is dealt to as many blocks of bounded size as
its postings ask for, and a block is one row with its documents, its terms, and their
runs and postings. Blocks spread over tasks by a hash, so that neither a common length
nor long texts gather in one. The index holds every term of every document and serves
any number of searches.

``search`` takes the items in blocks of bounded size. A scan over the index gives
the document frequencies of their terms. A second one bounds every block for every
item by its terms' first runs, and scores the most promising block of each batch;
the k-th best score of all that is a floor that no result lies below. The last one
visits the other blocks by falling bounds, until these drop below the floor or the
k-th score found on the way. Equal bounds are still visited, as a smaller id may tie.

A term of a third of the documents is a long list in each of many blocks and comes
together nowhere; of postings only counts leave a task, and of scores at most k per
item.

Results in special cases: a null text, and one without terms, has none and does not
count as a document; every row is a document, so a repeated id can be found several
times; a null id is found as null, after others of equal score; an item id of several
rows stands for its least text; a null item id is an id; an item without terms finds
nothing; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common

#: What a byte of a text is to its terms: part of one (capitals as small letters), or a gap.
AS_TERM = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))
#: Postings of a block as aimed at; documents and postings of a block at most, but for a single document.
AIM_POSTINGS = 1 << 18
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 20
#: Bytes of the terms of a block of items, as a mean.
ITEM_BYTES = 4 << 20
NO_ID = (1 << 63) - 1

COUNTED = "row long, doc_id long, n long, terms string, tfs binary"
BLOCK = pa.schema([
    ("m", pa.int64()), ("docs", pa.binary()), ("terms", pa.string()), ("first", pa.binary()),
    ("tf", pa.binary()), ("end", pa.binary()), ("slots", pa.binary()),
])
BLOCK_KIND = "m long, docs binary, terms string, first binary, tf binary, end binary, slots binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(AS_TERM).split()


def part(weight: int, tf: int, m: int) -> int:
    """What a term adds to a score."""
    return weight * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1_000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each document and how often it has them."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if found := terms_of(text):
                tfs = Counter(found)
                out.append((row, doc, len(found), b" ".join(tfs).decode(), np.fromiter(tfs.values(), "<u4", len(tfs)).tobytes()))
            row += 1
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["row", "doc_id", "n", "terms", "tfs"])


def _block(m: int, docs: list, terms: list, tfs: list[np.ndarray]) -> tuple:
    known = pc.split_pattern(pa.array(terms, pa.string()), " ").flatten().dictionary_encode()
    codes = known.indices.to_numpy()
    tf = np.concatenate(tfs).astype(np.int64)
    slots = np.repeat(np.arange(len(docs), dtype="<u2"), [len(t) for t in tfs])
    order = np.lexsort((-tf, codes))  # stable: documents stay in order within a run
    codes, tf, slots = codes[order], tf[order], slots[order]
    starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (tf[1:] != tf[:-1]))))
    ends = np.append(starts[1:], len(codes))
    first = np.searchsorted(codes[starts], np.arange(len(known.dictionary) + 1))
    ids = np.array([NO_ID if d is None else d for d in docs], "<i8")
    return (
        m, ids.tobytes(), " ".join(known.dictionary.to_pylist()), first.astype("<u4").tobytes(), tf[starts].astype("<u4").tobytes(),
        ends.astype("<u4").tobytes(), slots.tobytes(),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows in order of ``m``, share of the stratum and id."""
    at, docs, terms, tfs, size = (None, None), [], [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal docs, terms, tfs, size
        row = _block(at[0], docs, terms, tfs)
        docs, terms, tfs, size = [], [], [], 0
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, BLOCK)], schema=BLOCK)

    for batch in batches:
        for m, share, doc, some, tf in zip(*(batch.column(c).to_pylist() for c in ("m", "share", "doc_id", "terms", "tfs"))):
            tf = np.frombuffer(tf, "<u4")
            if docs and ((m, share) != at or len(docs) >= BLOCK_DOCS or size + len(tf) > BLOCK_POSTINGS):
                yield block()
            at = (m, share)
            docs.append(doc)
            terms.append(some)
            tfs.append(tf)
            size += len(tf)
    if docs:
        yield block()


@dataclass(frozen=True)
class Index:
    """A written index: its folder, its documents with a term, and the terms in them."""

    path: str
    documents: int
    length: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCK_KIND).parquet(self.path)


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the index of all documents to ``path``, by default a new folder in the shared one."""
    spark = common.prepare(docs.sparkSession)
    path = path or session.shared_dir(spark, "lexical-index")
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    counted = session.materialise(rows.mapInArrow(_count, COUNTED), "lexical-terms")
    total = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total["documents"], total["length"] or 0
    # decimals: the product of three counts
    wide = "CAST(75 AS DECIMAL(38,0)) * CAST(n AS DECIMAL(20,0)) * CAST({} AS DECIMAL(20,0))"
    m = F.expr(f"25 + CAST(floor({wide.format(documents)} DIV CAST({max(1, length)} AS DECIMAL(38,0))) AS BIGINT)")
    postings = (F.octet_length("tfs") / 4).cast("long")
    counted = counted.withColumn("m", m)
    shares = counted.groupBy("m").agg(F.ceil(F.sum(postings) / AIM_POSTINGS).alias("shares"))
    shares = session.lookup(session.materialise(shares, "lexical-strata"), ["m"])
    shared = counted.join(shares, "m").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares"))).drop("shares")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.repartition(tasks, "m", "share").sortWithinPartitions("m", "share", F.asc_nulls_last("doc_id"), "row")
    dealt.mapInArrow(_blocks, BLOCK_KIND).write.option("compression", "zstd").parquet(path)
    return Index(path, documents, length)


@dataclass(frozen=True)
class Items:
    """A bounded block of items: their ids, the terms they hold together, and each item's codes and counts of these."""

    ids: list
    terms: pa.Array
    starts: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        found = [(i, c) for i, text in rows if (c := Counter(terms_of(text)))]
        code = {t: k for k, t in enumerate(sorted({t for _, c in found for t in c}))}
        return cls(
            [i for i, _ in found], pa.array([t.decode() for t in code], pa.string()), np.cumsum([0, *(len(c) for _, c in found)]),
            np.array([code[t] for _, c in found for t in c], np.int64), np.array([n for _, c in found for n in c.values()], np.int64),
        )


def _here(terms: str, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the block's terms that are asked for, and their places among its terms."""
    codes = pc.index_in(pc.split_pattern(pa.array([terms], pa.string()), " ").flatten(), value_set=asked)
    places = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    return codes.drop_null().to_numpy().astype(np.int64), places


def _holding(batches: Iterator[pa.RecordBatch], asked: pa.Array) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term asked for, in a batch of blocks."""
    for batch in batches:
        sums = np.zeros(len(asked), np.int64)
        for terms, first, end in zip(*(batch.column(c).to_pylist() for c in ("terms", "first", "end"))):
            codes, places = _here(terms, asked)
            ends = np.concatenate(([0], np.frombuffer(end, "<u4").astype(np.int64)))
            first = np.frombuffer(first, "<u4")
            sums[codes] += ends[first[places + 1]] - ends[first[places]]
        there = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(there, pa.int64()), pa.array(sums[there], pa.int64())], names=["code", "n"])


class Block:
    """One block as the items see it."""

    def __init__(self, row: dict, items: Items, weights: np.ndarray):
        self.row = row
        self.items = items
        self.codes, self.places = _here(row["terms"], items.terms)
        self.weights = weights[self.codes]
        self.first = np.frombuffer(row["first"], "<u4").astype(np.int64)
        self.tf = np.frombuffer(row["tf"], "<u4").astype(np.int64)
        self.parts: np.ndarray | None = None

    def part(self, tf: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1_000 * tf + 8 * self.row["m"])

    def bounds(self) -> np.ndarray:
        """The most that any document here can score, for each item."""
        most = np.zeros(len(self.items.terms), np.int64)
        most[self.codes] = self.weights * self.part(self.tf[self.first[self.places]])
        return np.add.reduceat(self.items.counts * most[self.items.codes], self.items.starts[:-1])

    def _open(self) -> None:
        """The part of each run, computed once, laid beside the postings of the terms asked for."""
        ends = np.concatenate(([0], np.frombuffer(self.row["end"], "<u4").astype(np.int64)))
        slots = np.frombuffer(self.row["slots"], "<u2")
        self.docs = np.frombuffer(self.row["docs"], "<i8")
        runs = self.first[self.places + 1] - self.first[self.places]
        total = int(runs.sum())
        run = np.repeat(self.first[self.places] - (np.cumsum(runs) - runs), runs) + np.arange(total)
        sizes = ends[run + 1] - ends[run]
        parts = np.repeat(self.weights, runs) * self.part(self.tf[run])
        self.parts = np.repeat(parts, sizes)
        begins, stops = ends[self.first[self.places]], ends[self.first[self.places + 1]]
        length = stops - begins
        self.slots = slots[np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        span = np.concatenate(([0], np.cumsum(length)))
        self.begins = np.full(len(self.items.terms), -1)
        self.stops = np.full(len(self.items.terms), -1)
        self.begins[self.codes], self.stops[self.codes] = span[:-1], span[1:]

    def scores(self, item: int) -> np.ndarray:
        """The item's score of each document."""
        if self.parts is None:
            self._open()
        found = np.zeros(len(self.docs), np.int64)
        mine = slice(self.items.starts[item], self.items.starts[item + 1])
        codes, counts = self.items.codes[mine], self.items.counts[mine]
        here = self.begins[codes] >= 0
        spans = list(zip(self.begins[codes[here]].tolist(), self.stops[codes[here]].tolist(), counts[here].tolist()))
        if spans:
            slots = np.concatenate([self.slots[a:b] for a, b, _ in spans])
            np.add.at(found, slots, np.concatenate([self.parts[a:b] * n if n > 1 else self.parts[a:b] for a, b, n in spans]))
        return found


def _visit(best: list[tuple[int, int]], block: Block, item: int, floor: int, k: int) -> list[tuple[int, int]]:
    """The best ``(-score, id)`` with those of the block."""
    found = block.scores(item)
    there = np.flatnonzero(found >= floor)
    if len(there) > k:
        # the documents are in order of their ids, so ties go to the first
        there = there[np.argsort(-found[there], kind="stable")[:k]]
    return sorted([*best, *zip((-found[there]).tolist(), block.docs[there].tolist())])[:k]


FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _found(best: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    rows = [(item, None if doc == NO_ID else doc, -low) for item, some in enumerate(best) for low, doc in some]
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FOUND)], schema=FOUND)


def _search(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, k: int, floors: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The task's best for each item; without ``floors``, those of the most promising block of each batch alone."""
    best: list[list[tuple[int, int]]] = [[] for _ in items.ids]
    for batch in batches:
        blocks = [Block(row, items, weights) for row in batch.to_pylist()]
        if not blocks:
            continue
        bounds = np.stack([b.bounds() for b in blocks])
        for item in np.flatnonzero(bounds.max(axis=0) > 0).tolist():
            column = bounds[:, item]
            order = [int(column.argmax())] if floors is None else np.argsort(-column, kind="stable").tolist()
            for b in order:
                floor = 1 if floors is None else max(1, int(floors[item]))
                if len(best[item]) == k:
                    floor = max(floor, -best[item][-1][0])
                if column[b] < floor:
                    break
                best[item] = _visit(best[item], blocks[b], item, floor, k)
    yield _found(best)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_block(index: Index, spark: SparkSession, items: Items, k: int) -> DataFrame:
    blocks = index.blocks(spark)
    holding = blocks.select("terms", "first", "end").mapInArrow(lambda b: _holding(b, items.terms), "code long, n long")
    weights = np.zeros(len(items.terms), np.int64)
    # one row for each term of the block of items
    for r in holding.groupBy("code").agg(F.sum("n").alias("n")).collect():
        weights[r["code"]] = term_weight(index.documents, r["n"])
    kind = "item long, doc_id long, score long"
    first = _ranked(blocks.mapInArrow(lambda b: _search(b, items, weights, k, None), kind), k)
    floors = np.zeros(len(items.ids), np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    found = _ranked(blocks.mapInArrow(lambda b: _search(b, items, weights, k, floors), kind), k)
    ids = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item."""
    spark = common.prepare(items.sparkSession)
    key, text = common.column(id_col).cast("long"), F.coalesce(common.column(text_col), F.lit(""))
    asked = session.materialise(items.groupBy(key.alias("item_id")).agg(F.min(text).alias("text")), "lexical-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-size // ITEM_BYTES)
    results = []
    for number in range(many):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == number).orderBy("item_id")
        block = Items.of([(r["item_id"], r["text"]) for r in some.collect()])
        if block.ids:
            found = _of_block(index, spark, block, k)
            results.append(session.materialise(found, "lexical-found") if many > 1 else found)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)


ORACLE = r"""
WITH text AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
term AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM text),
post AS (SELECT r, doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
doc AS (SELECT r, count(*) AS n FROM term GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM doc),
norm AS (SELECT r, 25 + (75 * n * docs) // len AS m FROM doc, total),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, p.r, doc_id, CAST(sum(times * (w * ((1000000000 * tf) // (1000 * tf + 8 * m)))) AS BIGINT) AS score
  FROM asked JOIN post p USING (term) JOIN weight USING (term) JOIN norm ON norm.r = p.r GROUP BY item_id, p.r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
