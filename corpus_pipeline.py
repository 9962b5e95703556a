"""From raw documents to packed training sequences, each stage over all its predecessor kept.

Every stage calls one operator of ``fillgauge.llm``. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Results in special cases: a null, empty or blank text has too few words and goes with
the first stage; of repeated rows, and of rows that share an id, one stays; rows without
an id cannot stand for a group and all stay; a null source is a source of its own, the
empty one; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import packing, quality_rules, secrets, simhash, weak_labels
from fillgauge.llm.queries import TOKENIZER

#: Words in a shingle of the near-duplicate stage; fingerprints link within ``simhash.RADIUS`` bits.
SHINGLE = 3


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go from the texts, and documents that fail or lose too much go altogether."""
    return _counted(quality_rules.clean(docs))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels rejects go."""
    return weak_labels.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays."""
    return simhash.first_of_each(docs, SHINGLE)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets give way to the name of their kind."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids with the sources mixed evenly: one row per piece."""
    return packing.pack(docs, TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", pack),
]

#: Learned scores, fingerprints and token ids are not within SQL; brute-force versions stand in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
