"""The corpus operators applied to the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import best_fit, bpe, flat_tokens, hard_negatives, lexical, packing, quality_rules, secrets, simhash, topk, url_rules, warc, weak_labels

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by segment-tree BPE, and the texts decoded from them."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and its component of fingerprints linked within three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids with the sources mixed evenly."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_flat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as flat files in document order, and read back from them."""
    root = session.shared_dir(spark, "flat-tokens")
    flat_tokens.write(table(spark, sf_dir, "documents"), root, TOKENIZER)
    return flat_tokens.read(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The site rules of the filter.
SITES = (
    url_rules.site_rule("net/", "block"),
    url_rules.site_rule("example.net/en/", "allow"),
    url_rules.site_rule("example.com/de/", "block"),
    url_rules.site_rule("org/fr/", "allow"),
)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the site rule that decides it, and the verdict."""
    return url_rules.judge(table(spark, sf_dir, "pages"), (*SITES, *url_rules.PATTERNS))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived, deduplicated by payload digest, and read back."""
    raw, lean = session.shared_dir(spark, "warc-raw"), session.shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), raw)
    warc.deduplicate(spark, raw, lean)
    return warc.resolve(spark, lean).drop("url")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: those found by themselves, and those found by their complements."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's probability that each document is good, and whether it is kept."""
    return weak_labels.score(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth, by whole-number inner product."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first rules for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 ids as best-fit finds."""
    pieces = best_fit.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its best of the same label, the best of other labels within the window."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_url_rules": op4_url_rules,
    "op5_warc": op5_warc,
    "op6_flat_tokens": op6_flat_tokens,
    "op7_secrets": op7_secrets,
    "op8_weak_labels": op8_weak_labels,
    "op9_topk": op9_topk,
    "op10_quality_rules": op10_quality_rules,
    "op11_best_fit": op11_best_fit,
    "op12_lexical": op12_lexical,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_rules": url_rules.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
