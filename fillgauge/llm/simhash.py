"""SimHash near-duplicates by meeting in the middle between fingerprints.

Two fingerprints within three bits meet at a fingerprint within half of that from
both: where they differ in one or two bits, at one that differs from each in one
bit at most, and where they differ in three, one bit from one and two bits from
the other. So every fingerprint emits itself with all variants in one bit, and a
shuffle on the variants brings those within two bits together. The parity of two
fingerprints that differ in three bits is not the same, so only one parity emits
variants in two bits, and as two of any three bits lie in the same half of the
fingerprint, only variants in two bits of one half are needed: 992 of 2016.

A variant's fingerprints in one bit are within two bits of each other, and those
in two bits are within three of each of them. A star around the least one in a
bit therefore has the variant's links, exactly, without pairs: a variant gives at
most a link per row. The links are deduplicated, verified and joined into
components.

Rows are distinct fingerprints, so copies meet before anything is emitted and a
variant has at most 1 + 64 + 992 rows: no group is hot, whatever the documents.
A fingerprint that agrees with no other in either half, to within a bit, has no
link; half variants, of which there are few, find these, and they emit nothing.

Results in special cases: a null or empty text, and one without words, has the
fingerprint zero, which links like any other; texts of fewer words than a shingle
hash the words they have; repeated rows stay and share a component; a null id is
not the name of a component while another id is; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common
from fillgauge.llm.components import components
from fillgauge.llm.shingling import SEED, shingles

BITS = 64
RADIUS = 3
#: Hashes turned into bits at a time.
HASHES = 1 << 16


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


ONES = [signed(1 << i) for i in range(BITS)]
#: Pairs of bits in the same half.
TWOS = [signed(1 << i | 1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]


def fingerprint(text: str, words: int) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles."""
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)]
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES):
        rows = np.array(hashes[at : at + HASHES], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signed(fingerprint(t, words)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print``: the fingerprint of every document as a signed long."""
    common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lambda b: _prints(b, words), "doc_id long, print long")


def _odd(x: Column) -> Column:
    return F.bit_count(x) % 2 == 1


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))


def _not_alone(prints: DataFrame) -> DataFrame:
    """The fingerprints that agree with another in one of their halves to within a bit.

    Of two that differ in three bits or fewer, one half differs in one or none. Two
    halves that differ in a bit have different parity, so the odd ones emit their
    variants, and meet the even ones at these.
    """
    low = F.col("print").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("print", 32)
    variants = lambda half: F.when(
        _odd(half), F.concat(F.array(F.lit(0).cast("long")), _longs([1 << i for i in range(32)]))
    ).otherwise(F.array(F.lit(0).cast("long")))
    halves = prints.select("print", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half")))).alias("h"))
    emitted = halves.select("print", F.col("h.side").alias("side"), F.col("h.half").alias("half")).select(
        "print", "side", "half", F.explode(variants(F.col("half"))).alias("bit")
    )
    emitted = emitted.select("print", "side", F.col("half").bitwiseXOR(F.col("bit")).alias("key"))
    shared = emitted.groupBy("side", "key").agg(F.count("*").alias("n")).where("n > 1").select("side", "key")
    return emitted.join(shared.hint("merge"), ["side", "key"], "left_semi").select("print").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Verified links ``a < b`` that connect all fingerprints within the radius, as do all pairs."""
    near = session.materialise(_not_alone(prints), "simhash-near")
    # a small table with many rows to come: as many tasks as a shuffle has
    near = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    ones = F.transform(F.concat(F.array(F.lit(0).cast("long")), _longs(ONES)), lambda m: F.struct(m.alias("mask"), F.lit(True).alias("close")))
    twos = F.transform(_longs(TWOS), lambda m: F.struct(m.alias("mask"), F.lit(False).alias("close")))
    balls = near.select("print", F.explode(F.when(_odd(F.col("print")), F.concat(ones, twos)).otherwise(ones)).alias("v"))
    # the mask has few bits, so the rows compress to little more than the variant
    rows = balls.select(F.col("print").bitwiseXOR(F.col("v.mask")).alias("variant"), F.col("v.mask").alias("mask"), F.col("v.close").alias("close"))
    met = rows.groupBy("variant").agg(
        F.min(F.when(F.col("close"), F.col("variant").bitwiseXOR(F.col("mask")))).alias("centre"), F.collect_list("mask").alias("masks")
    )
    star = met.where(F.col("centre").isNotNull() & (F.size("masks") > 1)).select(
        "centre", F.explode("masks").alias("mask"), "variant"
    )
    pairs = star.select("centre", F.col("variant").bitwiseXOR(F.col("mask")).alias("other")).where("centre <> other")
    verified = pairs.where(F.bit_count(F.col("centre").bitwiseXOR(F.col("other"))) <= RADIUS)
    return verified.select(F.least("centre", "other").alias("a"), F.greatest("centre", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, component_id`` of every document: the component's smallest document id."""
    found = session.materialise(fingerprints(docs, words, id_col, text_col), "simhash")
    return grouped(found)


def grouped(found: DataFrame) -> DataFrame:
    """``doc_id, print, component_id`` of documents with fingerprints."""
    prints = session.materialise(found.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-prints")
    roots = components(links(prints.select("print")))
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # only components of several fingerprints need their root's name
    ids = session.materialise(named.select("print", "root").join(least, "root").select("print", "component_id"), "simhash-components")
    return found.join(ids, "print").select("doc_id", "print", "component_id")


def first_of_each(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each component, with all their columns.

    The first has the smallest id. Of rows that share an id, the least stays where
    that id is a component's. Rows without an id cannot stand for a component or
    be told apart, and all stay.
    """
    common.prepare(docs.sparkSession)
    key = common.column(id_col).cast("long")
    found = session.materialise(fingerprints(docs.where(key.isNotNull()), words, id_col, text_col), "simhash")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("rows"))
    chosen = session.materialise(grouped(found).select(F.col("component_id").alias("doc_id")).distinct().join(rows, "doc_id"), "simhash-first")
    row = F.struct(*(common.column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    held = docs.select(key.alias("doc_id"), row.alias("row"))
    # the ids that stay grow with the documents, so at no size are they sent to every task
    single = held.join(chosen.where("rows = 1").hint("merge"), "doc_id", "left_semi")
    several = held.join(chosen.where("rows > 1").hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row").alias("row"))
    stay = single.unionByName(several).unionByName(held.where("doc_id IS NULL"))
    return stay.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
