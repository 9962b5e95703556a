"""The registered corpus queries against their SQL twins or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fillgauge import session
from fillgauge.llm import queries, quality_rules, secrets, simhash, weak_labels
from tools.compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("slug", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, slug):
    assert differences(queries.QUERIES[slug](spark, SF), con, queries.ORACLE_SQL[slug]) == []


def test_flat_token_query_equals_the_library(spark):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    got = {r["doc_id"]: r for r in queries.op6_flat_tokens(spark, SF).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        found = got[r["doc_id"]]
        assert (found["start"], found["n_tokens"], found["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_stages(spark):
    """Each stage against what its operator decides on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(session.materialise(stage(spark, held[-1], SF), name))
    assert all(d.columns == columns for d in held[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in held]
    assert ids[1] == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert ids[2] == {r["doc_id"] for r in weak_labels.score(held[1]).where("kept").collect()}
    found = simhash.near_duplicates(held[2], corpus_pipeline.SHINGLE).collect()
    assert ids[3] == {r["component_id"] for r in found}
    assert ids[4] == ids[3] == ids[5]
    for r in held[4].collect():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs.where("length(text) > 200"), "doc_id")
    good = {r["doc_id"] for r in labels.collect()}
    assert len(good & ids[2]) >= 0.99 * len(good)
    assert held[5].agg(F.sum("length")).first()[0] > 0


def test_pipeline_over_odd_rows_and_an_empty_table(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids: all stages end, and what is clean goes through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.where("length(text) > 500").orderBy("doc_id").limit(40).collect()
    odd = [(None, None, None, None, None), (1, "", "en", "", 0), (2, " \n\t", None, "s", 3), (3, "w " * 200_000, "en", "s", 400_000)]
    odd += [(10_000 + i, r["text"], None, None, None) for i, r in enumerate(row)] + [(None, row[0]["text"], "en", "s", 1), (10_001, row[1]["text"], "en", "s", 1)]
    odd += [(20_000, row[2]["text"] + " ", "en", "s", 1), (20_000, row[2]["text"] + " ", "en", "s", 1)]
    for name, some in (("odd", odd), ("none", [])):
        spark.createDataFrame(some, docs.schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {p["doc_id"] for p in pieces}
    assert not ids & {1, 2, 3, 20_000} and len(ids - {None}) > 20
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
