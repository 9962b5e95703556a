"""Quality of predictions, from (label, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.features import time_part, with_future
from fillgauge.operators.slices import running_sums, shift

QUALITY = ("accuracy", "precision", "recall", "f1")


def confusion(label: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """The four counts as aggregate columns; ``label`` and ``predicted`` are booleans."""
    cells = {"tp": label & predicted, "fp": ~label & predicted, "fn": label & ~predicted, "tn": ~label & ~predicted}
    return [F.count_if(cell).cast("bigint").alias(prefix + name) for name, cell in cells.items()]


def quality(prefix: str = "") -> dict[str, Column]:
    """accuracy, precision, recall, F1 from the counts; 0 where undefined."""
    tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda top, bottom: F.coalesce(C.ratio(top, bottom), F.lit(0.0))
    return {
        "accuracy": r6(safe(tp + tn, tp + fp + fn + tn)),
        "precision": r6(safe(tp, tp + fp)),
        "recall": r6(safe(tp, tp + fn)),
        "f1": r6(safe(2 * tp, 2 * tp + fp + fn)),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [col.alias(name) for name, col in columns.items()]


def classification_metrics(df, *, label="label", score="score", threshold=D.DECISION_THRESHOLD):
    counts = df.agg(*confusion(F.col(label) == 1, F.col(score) > threshold))
    return counts.select("tp", "fp", "fn", "tn", *_named(quality()))


def threshold_sweep(df, *, label="label", score="score", steps=range(2, 18)):
    """Quality at the thresholds 0.10, 0.15 .. 0.85, the best by F1 marked.

    One pass: a row counts into the number of thresholds its score exceeds, and
    each threshold adds up the counts above it.
    """
    thresholds = F.array(*[F.lit(i * 5 / 100.0) for i in steps])
    exceeded = F.size(F.filter(thresholds, lambda t: t < F.col(score)))
    counted = df.groupBy(exceeded.alias("_above")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_p"), F.count("*").alias("_n")
    )
    grid = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(step * 5 / 100.0).alias("threshold")) for i, step in enumerate(steps)]
    )
    hit = F.col("_above") > F.col("i")
    p, q = F.col("_p"), F.col("_n") - F.col("_p")
    # At most 17 counted rows meet the 16 thresholds.
    swept = (
        counted.select("*", F.inline(grid))
        .groupBy("threshold")
        .agg(
            F.sum(F.when(hit, p).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, q).otherwise(0)).alias("fp"),
            F.sum(F.when(hit, 0).otherwise(p)).alias("fn"),
            F.sum(F.when(hit, 0).otherwise(q)).alias("tn"),
        )
        .select("threshold", *_named(quality()))
    )
    return with_best(swept, "threshold")


def with_best(rows: DataFrame, key: str, out: str = "is_best") -> DataFrame:
    """Mark the row of highest F1, the first by ``key`` on ties; none when all are 0."""
    # One row per threshold or definition: a handful.
    best = F.max_by(key, F.when(F.col("f1") > 0, F.struct("f1", -F.col(key)))).over(Window.partitionBy())
    return rows.withColumn(out, F.coalesce(C.flag(F.col(key) == best), F.lit(0)))


def empty_definition_sweep(df, *, level="bikes", candidates=D.EMPTY_CANDIDATES, **kwargs):
    """How the definition of empty changes its rate and how well persistence predicts it."""
    future = with_future(df, level=level, **kwargs)
    counts = future.agg(
        *[
            cell
            for k in candidates
            for cell in confusion(F.col("future_bikes") < k, F.col(level) < k, f"c{k}_")
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(int(k)).cast("bigint").alias("empty_below"),
                *[F.col(f"c{k}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")],
            )
            for k in candidates
        ]
    )
    q = quality()
    positives, everything = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    swept = counts.select(F.inline(rows)).select(
        "empty_below",
        r6(F.coalesce(100 * C.ratio(positives, everything), F.lit(0.0))).alias("pct_empty"),
        *[q[name].alias(name) for name in ("precision", "recall", "f1")],
    )
    return with_best(swept, "empty_below")


def fixed_vs_pct_threshold(df, *, level="bikes", capacity="capacity", fixed=D.EMPTY_BELOW, pct=0.2, **kwargs):
    """Empty as a fixed count against empty as a share of the capacity, by persistence."""
    future = with_future(df, level=level, **kwargs)
    share = F.lit(float(pct)) * F.col(capacity)
    counts = future.agg(
        *confusion(F.col("future_bikes") < fixed, F.col(level) < fixed, "fixed_"),
        *confusion(F.col("future_bikes") < share, F.col(level) < share, "pct_"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("method"), *[F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")]
            )
            for name in ("fixed", "pct")
        ]
    )
    q = quality()
    positives, everything = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    both = counts.select(F.inline(rows)).select(
        "method",
        r6(F.coalesce(100 * C.ratio(positives, everything), F.lit(0.0))).alias("pct_empty"),
        *[q[name].alias(name) for name in ("precision", "recall", "f1")],
    )
    winner = F.min_by("method", F.struct(-F.col("f1"), "method")).over(Window.partitionBy())
    return both.withColumn("is_winner", C.flag(F.col("method") == winner))


def persistence_rows(
    df, *, key="station_id", time="ts", level="bikes", tie="event_id", empty=D.EMPTY_BELOW, horizon=D.HORIZON_ROWS, train_fraction=D.TRAIN_FRACTION
):
    """Test rows of the time split with the label and the guess "empty now, empty later".

    Look-ahead and place come from one pass: a station's last ``horizon`` readings have no future and are not split.
    """
    rows = shift(df, key, [time, tie], {"future_bikes": (level, horizon)}, rank=True)
    n = F.col("_total") - horizon
    test = (F.col("_rank") <= n) & (time_part(F.col("_rank"), n, train_fraction) == "test") & F.col("future_bikes").isNotNull()
    return rows.where(test).select((F.col("future_bikes") < empty).alias("label"), (F.col(level) < empty).alias("guess"))


def persistence_baseline(df, **kwargs):
    counts = persistence_rows(df, **kwargs).agg(*confusion(F.col("label"), F.col("guess")))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(*_named(quality()), n.alias("n"))


def by_score(df, label: str, score: str) -> DataFrame:
    """One row per score with its positives and negatives."""
    positive = F.col(label).cast("bigint")
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def roc_auc(df, *, label="label", score="score"):
    """Exact area under the ROC curve, ties at half weight; null with one class only."""
    cumulated = running_sums(by_score(df, label, score), "score", {"neg_to": "neg"})
    # Doubled so that half ties stay whole numbers.
    won = (F.col("pos") * (2 * F.col("neg_to") - F.col("neg"))).cast("decimal(38,0)")
    whole = cumulated.agg(F.sum(won).cast("double").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return whole.select(
        r6(C.ratio(F.col("w"), 2.0 * F.col("p").cast("double") * F.col("q").cast("double"))).alias("roc_auc")
    )


def average_precision(df, *, label="label", score="score"):
    """Sum of precision times recall gained, from the highest score down."""
    grouped = by_score(df, label, score).withColumn("n", F.col("pos") + F.col("neg"))
    cumulated = running_sums(grouped, "score", {"tp": "pos", "seen": "n"}, descending=True)
    gained = F.col("pos") * C.ratio(F.col("tp"), F.col("seen"))
    return cumulated.agg(
        r6(C.ratio(F.sum(gained), F.sum("pos"))).alias("average_precision")
    )


def regression_metrics(df, *, y="label", pred="score", group: Column | None = None, min_rows=100):
    """RMSE, MAE, R2 and MAPE overall and per group with enough rows."""
    actual, err = F.col(y).cast("double"), F.col(y).cast("double") - F.col(pred)
    name = group.cast("string") if group is not None else F.lit("-")
    parts = df.groupBy(name.alias("group")).agg(
        F.count("*").alias("n"),
        F.sum(err * err).alias("sse"),
        F.sum(F.abs(err)).alias("sae"),
        F.sum(actual).alias("sy"),
        F.sum(actual * actual).alias("syy"),
        F.sum(C.ratio(F.abs(err), F.abs(actual))).alias("sape"),
        F.count_if(actual != 0).alias("n_pct"),
    )
    sums = ("n", "sse", "sae", "sy", "syy", "sape", "n_pct")
    whole = parts.agg(*[F.sum(c).alias(c) for c in sums]).withColumn("group", F.lit("all"))
    rows = whole.select("group", *sums)
    if group is not None:
        rows = rows.unionByName(parts.where(F.col("n") >= min_rows))
    n = F.col("n")
    total = F.col("syy") - C.ratio(F.col("sy") * F.col("sy"), n)
    return rows.select(
        "group",
        r6(F.sqrt(C.ratio(F.col("sse"), n))).alias("rmse"),
        r6(C.ratio(F.col("sae"), n)).alias("mae"),
        r6(1 - C.ratio(F.col("sse"), total)).alias("r2"),
        r6(100 * C.ratio(F.col("sape"), F.col("n_pct"))).alias("mape"),
        n.cast("bigint").alias("n"),
    )


def metrics_long(wide: DataFrame, model: str, names=QUALITY) -> DataFrame:
    """One (model, metric, value) row per metric of a one-row result."""
    return wide.select(F.lit(model).alias("model"), *names).unpivot("model", list(names), "metric", "value")


def model_comparison(long: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Metric by metric: both models, the difference and the winner."""
    value = lambda model: F.max(F.when(F.col("model") == model, F.col("value")))
    both = long.groupBy("metric").agg(value(model_a).alias("model_a"), value(model_b).alias("model_b"))
    diff = F.col("model_b") - F.col("model_a")
    return both.select(
        "metric",
        "model_a",
        "model_b",
        r6(diff).alias("diff"),
        F.when(diff > 0, model_b).when(diff < 0, model_a).otherwise("tie").alias("winner"),
    )
