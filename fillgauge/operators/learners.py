"""Shortage and demand models with Spark ML boosted trees.

Boosting ends where its validation rows, the last fifth of each station's training
rows, have not scored better for ``PATIENCE`` rounds, and keeps the best round: every
round of a fit is scored in one pass over the validation rows, and the ensemble is cut
to its first trees, which are those of a shorter fit.
Quality is measured on other rows still, by the same jobs as any other score.

Regressions of many rows grow over cells: the rows that no split of the trees could tell
apart are one row with their mean and their number, so that rounds cost no more on more rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators import boosting
from fillgauge.operators import evaluation as E
from fillgauge.operators.features import with_delta_target
from fillgauge.operators.slices import shift
from fillgauge.session import materialise

TIME_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_rush_hour")
STATE_FEATURES = ("occupancy", "bikes", "docks", "is_empty_now", "is_full_now")
TREND_FEATURES = ("trend_15min", "velocity", "acceleration")
WEATHER_FEATURES = ("rain", "wind", "temp")
ALL_FEATURES = (*TIME_FEATURES, *STATE_FEATURES, *TREND_FEATURES, *WEATHER_FEATURES)
SHARED_FEATURES = (*TIME_FEATURES, *STATE_FEATURES, *TREND_FEATURES)
#: Rounds without a better score on the validation rows that end boosting, and rounds grown beyond it at first.
PATIENCE = 50
FIRST_ROUNDS = 30
#: Independent fits that run side by side: a round is a dozen short stages, which leave most cores idle.
FITS_AT_ONCE = 8
#: Rows that are worth a task of a round, and rows that a task takes before there are more tasks than cores.
TRAIN_PARTITION_ROWS, TASK_ROWS = 20_000, 500_000
#: Bins of a feature, as many as Spark's trees tell apart unless told otherwise, and the error of the ranks that bound them.
BINS, RANK_ERROR = 32, 0.001
#: Rows up to which a regression grows over the rows themselves: its rounds are short anyway.
FEW_ROWS = 200_000
DELTA_FEATURES = (*TIME_FEATURES, "occupancy", "rain", "temp")
SHARED_DELTA_FEATURES = (*TIME_FEATURES, "occupancy")


def label_columns() -> dict[str, Column]:
    """What is foretold, from the reading a horizon ahead."""
    return {
        "will_be_empty": C.flag(F.col("future_bikes") < D.EMPTY_BELOW),
        "will_be_full": C.flag(F.col("future_docks") < D.FULL_BELOW),
    }


def model_frame(
    df: DataFrame,
    *,
    key="station_id",
    time="ts",
    tie="event_id",
    horizon=D.HORIZON_ROWS,
    max_rows=D.MAX_SLICE_ROWS,
    labels: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Features, look-ahead ``labels`` and the train / valid / test part of each row.

    Past and future values come from one sliced pass over the station's readings.
    """
    labels = label_columns() if labels is None else labels
    rows = shift(
        df,
        key,
        [time, tie],
        {
            "_b1": ("bikes", -1),
            "_b2": ("bikes", -2),
            "_b3": ("bikes", -3),
            "future_bikes": ("bikes", horizon),
            "future_docks": ("docks", horizon),
        },
        max_rows,
        rank=True,
    ).where("future_bikes is not null")
    hour, dow = C.hour_of(time), C.weekday_of(time)
    (hs, hc), (ds, dc) = C.cyclic(hour, 24), C.cyclic(dow, 7)
    velocity = F.coalesce(F.col("bikes") - F.col("_b1"), F.lit(0))
    before = F.when(F.col("_b1").isNotNull(), F.coalesce(F.col("_b1") - F.col("_b2"), F.lit(0)))
    weather = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in WEATHER_FEATURES if c in df.columns}
    featured = rows.withColumns(
        {
            "hour_sin": hs,
            "hour_cos": hc,
            "dow_sin": ds,
            "dow_cos": dc,
            "is_weekend": C.weekend(dow),
            "is_rush_hour": C.in_ranges(hour, D.RUSH_COMMUTE_LONG),
            "occupancy": C.occupancy(clip=True),
            "is_empty_now": C.is_empty(),
            "is_full_now": C.is_full(),
            "velocity": velocity,
            "acceleration": F.coalesce(velocity - before, F.lit(0)),
            "trend_15min": F.coalesce(
                (F.col("bikes") - F.col("_b3")) / (F.col("capacity") + F.lit(0.001)), F.lit(0.0)
            ),
            **labels,
            **weather,
        }
    ).drop("_b1", "_b2", "_b3", "future_bikes", "future_docks")
    # the last readings of a station have no future and are gone
    n, rank = F.greatest(F.col("_total") - horizon, F.lit(0)), F.col("_rank")
    test_from = F.floor(n * D.TRAIN_FRACTION)
    part = (
        F.when(rank > test_from, "test").when(rank > F.floor(test_from * D.TRAIN_FRACTION), "valid").otherwise("train")
    )
    kept = [c for c in ALL_FEATURES if c in featured.columns]
    return featured.select(key, tie, *kept, *labels, part.alias("part"))


def publish_model(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    """The fitted pipeline and its metrics side by side."""
    model.write().save(f"{path}/model")
    metrics.write.parquet(f"{path}/metrics")


def best_round(losses: Sequence[float], patience: int) -> int:
    """The best round up to the first stretch of ``patience`` rounds without a better one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def ensemble(model: PipelineModel, trees: Sequence, tree_weights: Sequence[float]) -> PipelineModel:
    """The fitted pipeline with these trees in place of its own: a boosted model is the weighted sum of its trees."""
    *before, boosted = model.stages
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    held = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    share = gateway.new_array(gateway.jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, tree_weights)):
        held[k], share[k] = tree, float(weight)
    kind = getattr(jvm.org.apache.spark.ml, "classification" if isinstance(boosted, GBTClassificationModel) else "regression")
    java = getattr(kind, type(boosted).__name__)(boosted.uid, held, share)
    joined = type(boosted)(java)
    for param in boosted.params:
        if boosted.isSet(param) and joined.hasParam(param.name):
            joined.set(joined.getParam(param.name), boosted.getOrDefault(param))
    joined._transfer_params_to_java()
    return PipelineModel([*before, joined])


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model as it was after ``n`` rounds."""
    boosted = model.stages[-1]
    return ensemble(model, list(boosted._java_obj.trees())[:n], list(boosted.treeWeights)[:n])


def added(model: PipelineModel, more: PipelineModel) -> PipelineModel:
    """One additive model that predicts the sum of two regressions over the same inputs."""
    boosted = [m.stages[-1] for m in (model, more)]
    return ensemble(model, [t for b in boosted for t in b._java_obj.trees()], [w for b in boosted for w in b.treeWeights])


def stopped(
    fit: Callable[[int], PipelineModel],
    valid: DataFrame,
    score: Callable[[PipelineModel, DataFrame], Sequence[float]],
    rounds: int,
    patience: int,
    growth: int = 2,
    back: int | None = None,
) -> PipelineModel:
    """The model cut to the round that scores best on ``valid``; without validation rows all rounds stay.

    ``fit(n)`` grows ``n`` trees. A fit is repeated only while its best one lies less
    than ``patience`` rounds back: once with just the rounds that confirm it, if it lies
    ``back`` rounds back (half of them unless given), else with ``growth`` times the rounds.
    """
    if valid.isEmpty():
        return fit(rounds)
    grown, confirmed = min(rounds, patience + FIRST_ROUNDS), False
    back = patience // 2 if back is None else back
    while True:
        model = fit(grown)
        best = best_round(score(model, valid), patience)
        if grown >= rounds or best + patience <= grown:
            return model if best == tree_count(model) else first_trees(model, best)
        if grown - best >= back and not confirmed:
            grown, confirmed = min(rounds, best + patience), True
        else:
            # what would leave less than half a doubling is done at once
            grown = growth * grown if (growth + 1) * grown < rounds else rounds


def tree_count(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def fit_classifier(
    frame: DataFrame, target: str, features: Sequence[str], rounds: int, seed: int, step: float = 0.05, patience: int = PATIENCE,
    bins: Bucketizer | None = None, beside: int = 1,
) -> PipelineModel:
    """Boosted trees with positives weighted up to the negatives' total, stopped on the ``valid`` rows.

    ``bins`` are those of the features on the ``train`` rows, where the caller has them;
    ``beside`` is how many fits run side by side, this one among them.
    """
    train = frame.where("part = 'train'")
    positives, n, used = frame.where("part <> 'test'").agg(
        F.sum(F.when(F.col("part") == "train", F.col(target))), F.sum(C.flag(F.col("part") == "train")), F.count("*")
    ).first()
    if not n:
        raise ValueError("there are no rows to train on")
    bins = bins or feature_bins(train, features)
    boosted = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=6,
        maxBins=BINS,
        stepSize=step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=seed,
    )
    model = boosting.classifier(
        frame.where("part <> 'test'"),
        [splits[1:-1] for splits in bins.getSplitsArray()],
        boosted,
        features,
        target=target,
        grows=F.col("part") == "train",
        heavy=(n - positives) / positives if 0 < positives < n else 1.0,
        patience=patience,
        tasks=boosting.tasks_for(used, frame.sparkSession.sparkContext.defaultParallelism, beside),
    )
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features"), model])


def partitions_for(rows: int, cores: int) -> int:
    """Partitions of a training table, which every round passes over a dozen times: one for each core, if it has work for them."""
    return max(1, min(-(-rows // TRAIN_PARTITION_ROWS), max(cores, -(-rows // TASK_ROWS))))


def side_by_side(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """The results of independent jobs, a bounded number of them at once."""
    with ThreadPool(min(FITS_AT_ONCE, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)


def class_scores(model: PipelineModel, frame: DataFrame, target: str) -> DataFrame:
    return model.transform(frame).select(
        F.col(target).alias("label"), vector_to_array("probability")[1].alias("score")
    )


def classifier_quality(scores: DataFrame, threshold: float) -> DataFrame:
    scores = materialise(scores, "scores")
    metrics = E.classification_metrics(scores, threshold=threshold)
    auc, pr = E.roc_auc(scores).scalar(), E.average_precision(scores).scalar()
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return metrics.select(*E.QUALITY, n.alias("n_test")).withColumns({"roc_auc": auc, "pr_auc": pr}).select(
        *E.QUALITY, "roc_auc", "pr_auc", "n_test"
    )


def train_classifier(
    df: DataFrame,
    target: str = "will_be_empty",
    features: Sequence[str] = ALL_FEATURES,
    rounds: int = 500,
    threshold: float = D.DECISION_THRESHOLD,
    seed: int = 42,
    **columns,
) -> DataFrame:
    """Fit on the early readings of each station; the metrics row is from its latest ones."""
    frame = materialise(model_frame(df, **columns), "model-frame")
    model = fit_classifier(frame, target, features, rounds, seed)
    quality = classifier_quality(class_scores(model, frame.where("part = 'test'"), target), threshold)
    return quality.withColumn("n_trees", F.lit(tree_count(model)).cast("bigint"))


def delta_frame(df: DataFrame, **columns) -> DataFrame:
    """Regression rows: features and the occupancy change over the horizon."""
    rows = df.withColumn("occupancy", C.occupancy(clip=True))
    hour, dow = C.hour_of("ts"), C.weekday_of("ts")
    (hs, hc), (ds, dc) = C.cyclic(hour, 24), C.cyclic(dow, 7)
    return with_delta_target(rows, **columns).withColumns(
        {
            "hour_sin": hs,
            "hour_cos": hc,
            "dow_sin": ds,
            "dow_cos": dc,
            "is_weekend": C.weekend(dow),
            "is_rush_hour": C.in_ranges(hour, D.RUSH_COMMUTE_LONG),
            **{c: F.col(c).cast("double") for c in ("rain", "temp") if c in df.columns},
        }
    ).select("event_id", "delta_next", *[c for c in DELTA_FEATURES if c not in ("rain", "temp") or c in df.columns])


def regression_part() -> Column:
    """Three fifths train, one validates the number of rounds, one tests; by a hash of the event."""
    fifth = C.fold("event_id", 5)
    return F.when(fifth == 0, "val").when(fifth == 1, "stop").otherwise("train")


def feature_bins(rows: DataFrame, features: Sequence[str]) -> Bucketizer:
    """At most ``BINS`` bins for each feature: its values, or where it has more, the least one and equal shares of the rows above it."""
    numbers = {c: F.col(c).cast("double") for c in features}
    seen = rows.agg(*[F.approx_count_distinct(v).alias(c) for c, v in numbers.items()], *[F.min(v).alias(f"{c} least") for c, v in numbers.items()]).first()
    # the estimate is within a few per cent: what is well beyond the bins is not collected
    few = [c for c in features if seen[c] <= 2 * BINS]
    values = rows.agg(*[F.collect_set(numbers[c]).alias(c) for c in few]).first().asDict() if few else {}
    cuts = {c: sorted(v for v in found if math.isfinite(v))[1:] for c, found in values.items() if len(found) <= BINS}
    many = [c for c in features if c not in cuts]
    if many:
        above = rows.select(*[F.when(numbers[c] > seen[f"{c} least"], numbers[c]).alias(c) for c in many])
        shares = [k / (BINS - 1) for k in range(BINS - 1)]
        for c, found in zip(many, above.approxQuantile(many, shares, RANK_ERROR)):
            cuts[c] = sorted({v for v in found if math.isfinite(v)})
    # a bucketizer asks for one cut at least
    splits = [[-math.inf, *(cuts[c] or [0.0]), math.inf] for c in features]
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"{c}_bin" for c in features])


def cells(rows: DataFrame, bins: Bucketizer, target: str) -> DataFrame:
    """One row for each part and set of bins: the mean ``target`` and, as ``weight``, the number of its rows.

    To squared loss they are the rows themselves: splits, leaves and the order of losses are those of the rows.
    """
    keys = ["part", *bins.getOutputCols()]
    found = bins.transform(rows).groupBy(*keys).agg(F.avg(target).alias(target), F.count("*").cast("double").alias("weight"))
    # which cells a round draws goes by their order
    return materialise(found.sortWithinPartitions(*keys), "cells")


def fit_regressor(
    frame: DataFrame,
    features: Sequence[str] = DELTA_FEATURES,
    rounds: int = 500,
    seed: int = 42,
    patience: int = PATIENCE,
    target: str = "delta_next",
    step: float = 0.05,
    bins: Bucketizer | None = None,
) -> PipelineModel:
    """Boosted regression of ``target``; a fifth of the events stops it and another is left for testing.

    ``bins`` are those of another model that this one is to be joined to. Beyond
    ``FEW_ROWS`` rows the trees grow over cells, to which all rows belong: a round
    then draws four fifths of the cells instead of the rows.
    """
    known = frame.where(F.col(target).isNotNull()).withColumn("part", regression_part())
    bins = bins or feature_bins(known.where("part = 'train'"), features)
    grown_on = known.where("part <> 'val'")
    many = grown_on.count() > FEW_ROWS
    grown_on = cells(grown_on, bins, target) if many else bins.transform(grown_on).withColumn("weight", F.lit(1.0))
    train = grown_on.where("part = 'train'")
    train = train.coalesce(partitions_for(train.count(), frame.sparkSession.sparkContext.defaultParallelism))
    assemble = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")

    def fit(trees: int) -> PipelineModel:
        boosted = GBTRegressor(
            featuresCol="features",
            labelCol=target,
            weightCol="weight",
            maxIter=trees,
            maxDepth=6,
            maxBins=BINS,
            stepSize=step,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            seed=seed,
        )
        return PipelineModel([bins, *Pipeline(stages=[assemble, boosted]).fit(train).stages])

    def losses(model: PipelineModel, valid: DataFrame) -> list[float]:
        return model.stages[-1].evaluateEachIteration(assemble.transform(valid), "squared")

    # what neither the first rounds nor those that confirm a best one settle is grown in full, as each fit repeats all before it;
    # that is so dear that a fifth of the patience without a better round is reason enough to confirm the best one first
    return stopped(fit, grown_on.where("part = 'stop'"), losses, rounds, patience, growth=rounds, back=patience // 5)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the model's ``prediction``; of many rows, each set of bins is predicted once and joined to its rows."""
    bins = model.stages[0]
    if not isinstance(bins, Bucketizer) or rows.count() <= FEW_ROWS:
        return model.transform(rows).select(*rows.columns, "prediction")
    keys = bins.getOutputCols()
    # a letter for each bin keeps what is shuffled small
    cell = F.concat(*[F.char(F.lit(65) + F.col(c).cast("int")) for c in keys]).alias("_cell")
    binned = bins.transform(rows)
    distinct = binned.select(*keys, cell).distinct()
    for stage in model.stages[1:]:
        distinct = stage.transform(distinct)
    known = materialise(distinct.select("_cell", "prediction"), "predicted-cells")
    return binned.select(*rows.columns, cell).join(known, "_cell").select(*rows.columns, "prediction")


def train_delta_regressor(df, *, features=DELTA_FEATURES, rounds=500, seed=42, **columns):
    """Errors on the training rows and on rows that neither grew nor stopped the trees."""
    frame = materialise(delta_frame(df, **columns), "delta-frame")
    model = fit_regressor(frame, features, rounds, seed)
    scored = predicted(model, frame.where("delta_next is not null")).withColumn("part", regression_part()).where("part <> 'stop'")
    metrics = E.regression_metrics(scored, y="delta_next", pred="prediction", group=F.col("part"), min_rows=1)
    trees = F.lit(tree_count(model)).cast("bigint").alias("n_trees")
    return metrics.where("group <> 'all'").select(F.col("group").alias("split"), "rmse", "mae", "r2", "n", trees)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """One row per model input, ranked by gain."""
    names = model.stages[0].getInputCols()
    gains = model.stages[-1].featureImportances.toArray()
    ordered = sorted(zip(names, gains), key=lambda p: (-p[1], p[0]))
    rows = [(name, float(gain), i + 1) for i, (name, gain) in enumerate(ordered)]
    return spark.createDataFrame(rows, "feature string, importance double, rank bigint").withColumn(
        "importance", r6(F.col("importance"))
    )


def score_and_label(model: PipelineModel, frame: DataFrame, features=DELTA_FEATURES) -> DataFrame:
    """Predicted change and its trend band for every row complete in the features."""
    scored = predicted(model, frame.dropna(subset=list(features)))
    return scored.select(
        "event_id",
        r6(F.col("prediction")).alias("predicted_delta"),
        C.band(F.col("prediction"), D.TREND_EDGES, D.TREND_LABELS, open_ended=True).alias("trend"),
    )


def transfer_learn(
    src: DataFrame,
    dst: DataFrame,
    *,
    target="will_be_empty",
    features: Sequence[str] = SHARED_FEATURES,
    rounds=500,
    threshold=D.DECISION_THRESHOLD,
    seed=42,
) -> DataFrame:
    """A local model against one that starts from another city's model.

    Spark's boosting cannot continue a fitted model, so the source model's
    margin becomes an input of the second, slower-learning model.
    """
    source = materialise(model_frame(src), "source-frame")
    local = materialise(model_frame(dst), "model-frame")
    margin = vector_to_array("rawPrediction")[1]

    def transferred() -> tuple[PipelineModel, DataFrame, PipelineModel]:
        pretrained = fit_classifier(source, target, features, rounds, seed)
        stacked = pretrained.transform(local).select("part", target, *features, margin.alias("source_margin"))
        stacked = materialise(stacked, "stacked")
        return pretrained, stacked, fit_classifier(stacked, target, [*features, "source_margin"], rounds, seed, step=0.02)

    local_model, (pretrained, stacked, transfer) = side_by_side(
        src.sparkSession, lambda: fit_classifier(local, target, features, rounds, seed), transferred
    )
    test = "part = 'test'"
    runs = {
        "local": class_scores(local_model, local.where(test), target),
        "pretrained": class_scores(pretrained, local.where(test), target),
        "transfer": class_scores(transfer, stacked.where(test), target),
    }
    out = None
    for name, scores in runs.items():
        row = E.classification_metrics(scores, threshold=threshold).select(F.lit(name).alias("model"), *E.QUALITY)
        out = row if out is None else out.unionByName(row)
    return out


def continued(
    model: PipelineModel, frame: DataFrame, features: Sequence[str], rounds: int = 500, seed: int = 42, step: float = 0.01,
) -> PipelineModel:
    """A regression that starts from a fitted one: trees for what it leaves over, joined to its own."""
    left = F.col("delta_next") - F.col("prediction")
    rest = materialise(predicted(model, frame).select(*frame.columns, left.alias("left_over")), "left-over")
    return added(model, fit_regressor(rest, features, rounds, seed, target="left_over", step=step, bins=model.stages[0]))


def transfer_regressor(
    src: DataFrame, dst: DataFrame, *, features: Sequence[str] = SHARED_DELTA_FEATURES, rounds: int = 500, seed: int = 42, **columns
) -> DataFrame:
    """Errors on the test events of ``dst``: a local model, another city's, and that one continued on local events."""
    source, local = (materialise(delta_frame(d, **columns), "delta-frame") for d in (src, dst))

    def transferred() -> tuple[PipelineModel, PipelineModel]:
        pretrained = fit_regressor(source, features, rounds, seed)
        return pretrained, continued(pretrained, local, features, rounds, seed)

    fitted, (pretrained, transfer) = side_by_side(src.sparkSession, lambda: fit_regressor(local, features, rounds, seed), transferred)
    models = {"local": fitted, "pretrained": pretrained, "transfer": transfer}
    test = local.where("delta_next IS NOT NULL").where(regression_part() == "val")
    out = None
    for name, model in models.items():
        row = E.regression_metrics(predicted(model, test), y="delta_next", pred="prediction")
        row = row.select(F.lit(name).alias("model"), "rmse", "mae", "r2", "n", F.lit(tree_count(model)).cast("bigint").alias("n_trees"))
        out = row if out is None else out.unionByName(row)
    return out


def definition_sweep(
    df: DataFrame, definitions: Mapping[str, Column], now: Mapping[str, Column], *, features: Sequence[str] = ALL_FEATURES,
    rounds: int = 100, seed: int = 42, **columns,
) -> DataFrame:
    """How well each definition of empty can be foretold: a model's best F1 and its threshold, and persistence beside it.

    ``definitions`` say by name when a future reading (``future_bikes``,
    ``capacity``) is empty, ``now`` when the present one (``bikes``) is. All labels
    stand in one written frame; the fits run side by side, a few at a time.
    """
    names = list(definitions)
    labels = {f"label_{k}": C.flag(definitions[n]) for k, n in enumerate(names)}
    labels |= {f"now_{k}": C.flag(now[n]).cast("double") for k, n in enumerate(names)}
    frame = materialise(model_frame(df, labels=labels, **columns), "definitions-frame")

    bins = feature_bins(frame.where("part = 'train'"), features)

    def row(k: int) -> DataFrame:
        model = fit_classifier(frame, f"label_{k}", features, rounds, seed, bins=bins, beside=min(FITS_AT_ONCE, len(names)))
        test = frame.where("part = 'test'")
        scores = materialise(class_scores(model, test, f"label_{k}"), "definition-scores")
        best = E.threshold_sweep(scores).orderBy(F.desc("is_best"), F.desc("f1"), "threshold").limit(1)
        same = E.classification_metrics(test.select(F.col(f"label_{k}").alias("label"), F.col(f"now_{k}").alias("score")))
        rate = F.lit(scores.agg(100 * F.avg("label")).first()[0])
        return best.select(
            F.lit(names[k]).alias("definition"), r6(rate).alias("pct_empty"), "threshold", "precision", "recall", "f1",
            F.lit(same.first()["f1"]).alias("persistence_f1"), F.lit(tree_count(model)).cast("bigint").alias("n_trees"),
        )

    rows = side_by_side(df.sparkSession, *(lambda k=k: row(k) for k in range(len(names))))
    return reduce(DataFrame.unionByName, rows)
