"""Every registered query against its SQL twin on the small driver tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from fillgauge.plans.catalog import QUERIES
from fillgauge.plans.oracle import oracle_sql
from tools.compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

ROWS_ONLY = {
    "cluster_stations", "elbow_curve", "train_empty_classifier", "train_full_classifier", "train_delta_regressor",
    "transfer_learn", "transfer_regressor", "model_definition_sweep", "feature_importance", "score_and_label",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_learned_results_lack_sql():
    assert set(QUERIES) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("slug", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, con, slug):
    assert differences(QUERIES[slug](spark, SF), con, oracle_sql()[slug]) == []


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("missing", ["xxhash", "regex", "public_tokenizers", "fillgauge.llm", "corpus_pipeline"])
def test_other_queries_stand_without_the_corpus_part(missing):
    """A package that only the corpus operators need, or these themselves, may be absent."""
    code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
print(len(entry.queries()), sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()), len(entry.oracle_sql()))
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), "0", str(len(oracle_sql()))]
