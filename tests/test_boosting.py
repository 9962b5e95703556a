from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fillgauge.operators import boosting, learners

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((9000, 3))
    x[:, 2] = np.floor(x[:, 2] * 5)
    chance = 1 / (1 + np.exp(2 - 3 * x[:, 0] + 2 * np.sin(6 * x[:, 1]) - 0.3 * x[:, 2]))
    part = np.repeat(["train", "valid", "test"], 3000)
    data = [(*map(float, r), int(t), str(p)) for r, t, p in zip(x, rng.random(9000) < chance, part)]
    return spark.createDataFrame(data, "a double, b double, c double, t int, part string").repartition(6, "a").cache()


def losses(model, rows):
    assembled = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.withColumns({"label": F.col("t").cast("double"), "weight": F.lit(1.0)}))
    return model.evaluateEachIteration(assembled)


def test_trees_are_as_good_as_those_of_spark(rows):
    mine = learners.fit_classifier(rows.where("part <> 'valid'"), "t", NAMES, 15, 1, step=0.1).stages[-1]
    heavy = rows.where("part = 'train'").agg(F.sum(1 - F.col("t")) / F.sum("t")).first()[0]
    weighted = rows.where("part = 'train'").withColumns({"label": F.col("t").cast("double"), "weight": F.when(F.col("t") == 1, heavy).otherwise(1.0)})
    spark_s = GBTClassifier(maxIter=15, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", weightCol="weight", seed=1)
    spark_s = spark_s.fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(weighted))
    for part in ("train", "test"):
        got, want = (losses(m, rows.where(F.col("part") == part)) for m in (mine, spark_s))
        assert got[-1] == pytest.approx(want[-1], rel=0.03) and got[-1] < got[0]
    assert mine.numFeatures == 3 and mine.numClasses == 2 and mine.trees[0].depth <= 6
    assert mine.featureImportances.toArray() == pytest.approx(spark_s.featureImportances.toArray(), abs=0.15)


def test_no_round_is_grown_twice(rows, monkeypatch):
    """Boosting ends ``patience`` rounds after the best one, and each round before was grown once."""
    grown = []
    real = boosting.by_tasks

    def counted(chunks, begin, grow):
        return real(chunks, begin, lambda visit, advance: grow(visit, lambda step: (grown.append(1), advance(step))))

    monkeypatch.setattr(boosting, "by_tasks", counted)
    monkeypatch.setattr(boosting, "TASK_ROWS", 2000)
    model = learners.fit_classifier(rows, "t", NAMES, 60, 1, step=0.3, patience=5)
    kept = learners.tree_count(model)
    assert kept < 55 and len(grown) == kept + 5
    # what stopped it is the loss that the model itself has on these rows
    whole = learners.fit_classifier(rows.withColumn("part", F.regexp_replace("part", "valid", "test")), "t", NAMES, kept, 1, step=0.3)
    assert losses(model.stages[-1], rows.where("part = 'valid'"))[-1] == pytest.approx(losses(whole.stages[-1], rows.where("part = 'valid'"))[-1], rel=0.05)


def test_one_task_grows_the_trees_of_many_jobs(rows, monkeypatch):
    found = []
    for grower in (boosting.in_one_task, boosting.by_tasks):
        monkeypatch.setattr(boosting, "in_one_task", grower)
        model = learners.fit_classifier(rows.coalesce(1), "t", NAMES, 12, 1, patience=50)
        found.append(model.stages[-1].toDebugString.split("\n", 1)[1])
    assert found[0] == found[1]


def test_histograms_by_groups_are_those_of_the_features():
    assert boosting.grouped([32, 32, 32, 2, 7], most=1024) == [[0, 1], [2, 4, 3]]
    assert boosting.grouped([1, 1]) == [[0, 1]]
    assert [boosting.tasks_for(n, 8) for n in (0, 1_000_000, 1_000_001, 90_000_000)] == [1, 1, 2, 8]
    assert [boosting.tasks_for(n, 8, beside=5) for n in (0, 4_800_000, 5_000_001, 90_000_000)] == [1, 1, 2, 8]


def test_odd_rows(rows):
    same = rows.withColumns({"a": F.lit(1.0), "b": F.lit(1.0), "c": F.lit(1.0)})
    assert learners.fit_classifier(same, "t", NAMES, 3, 1).stages[-1].trees[0].numNodes == 1
    always = learners.fit_classifier(rows.withColumn("t", F.lit(1)), "t", NAMES, 3, 1)
    assert always.transform(rows).agg(F.min("prediction")).first()[0] == 1.0
    with pytest.raises(Exception, match="without a value"):
        learners.fit_classifier(rows.withColumn("a", F.when(F.col("a") > 0.1, F.col("a"))), "t", NAMES, 3, 1)
    with pytest.raises(ValueError, match="no rows"):
        learners.fit_classifier(rows.where("part = 'test'"), "t", NAMES, 3, 1)
