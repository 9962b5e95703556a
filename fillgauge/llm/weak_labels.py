"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad, or nothing where they
cannot tell. Expectation-maximisation estimates how each labeller votes on good
and on bad documents, and how many of either there are, from how often each
pattern of votes occurs in the whole corpus. There are at most 3^11 patterns, so
they are counted in one reduction and fitted on the driver, whatever the size of
the corpus. A pattern's posterior is then the label of its documents.

The posteriors train a linear scorer over hashed word endings, which generalises
over what no labeller looks at. It is fitted to a sample of about
``train_rows`` documents, chosen by a hash of id and text; every document is
scored.

Results in special cases: a null text is empty; a document without words has the
score 0 and is not kept; repeated rows stay, with equal scores; null ids stay;
where all votes agree, so do all scores; other columns are not carried by
``score`` and all stay in ``keep``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common
from fillgauge.llm.quality_rules import count_of, word_list

#: Expected number of documents that the scorer is fitted to.
TRAIN_ROWS = 20_000
#: Hashed features.
FEATURES = 1 << 14
#: A good document lost costs more than a bad one kept, and the two lie far apart.
THRESHOLD = 0.2
GOOD, BAD, NONE = "+", "-", "0"


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, words`` and what the labellers look at."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    ended = F.filter(lines, lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*".!?:;\"”»)…"))
    counted = docs.select(
        "doc_id", "text", common.once(word_list(F.col("text"))).alias("words"),
        count_of(F.col("text"), "#*$%&<>").alias("symbols"), count_of(F.col("text"), "|").alias("bars"),
        count_of(F.col("text"), "!").alias("shouts"), count_of(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
        F.length(F.regexp_replace("text", r"[\p{L}\s]+", "")).alias("signs"), F.size(lines).alias("lines"), F.size(ended).alias("ended"),
    )
    plain = F.filter("words", lambda w: F.right(w, F.lit(1)).rlike(r"[\p{L}\p{N}.,]"))
    again = F.filter("words", lambda w, i: w == F.get("words", i - 1))
    return counted.select(
        "doc_id", "text", "words", "symbols", "bars", "shouts", "capitals", "signs", "lines", "ended",
        F.size("words").alias("n"), F.size(plain).alias("plain"), F.size(again).alias("again"), F.size(F.array_distinct("words")).alias("different"),
        F.length(F.array_join("words", "")).alias("chars"),
    )


def labellers() -> Mapping[str, Column]:
    """The vote of each labeller on a measured document."""
    n, chars = F.greatest(F.col("n"), F.lit(1)), F.greatest(F.col("chars"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    length = F.col("chars") / n
    return {
        "symbols": vote(per_word("symbols") > 0.25, per_word("symbols") < 0.05),
        "bars": vote(per_word("bars") > 0.08, per_word("bars") < 0.02),
        "shouting": vote(per_word("shouts") > 0.3, per_word("shouts") < 0.05),
        "capitals": vote(F.col("capitals") / chars > 0.35, F.col("capitals") / chars < 0.15),
        # these overlap with the four above, and with each other
        "signs": vote(per_word("signs") > 0.45, per_word("signs") < 0.3),
        "word_ends": vote(F.col("plain") < 0.75 * n, F.col("plain") > 0.9 * n),
        "variety": vote(F.col("different") / n < 0.2, F.col("different") / n > 0.45),
        "repeats": vote(F.col("again") > 0.3 * n, F.col("again") < 0.05 * n),
        "endings": vote(F.col("ended") < 0.25 * F.col("lines"), F.col("ended") >= 0.75 * F.col("lines")),
        "word_length": vote((length < 2) | (length > 14), (length > 3) & (length < 10)),
        "size": vote(F.col("n") < 15, F.col("n") > 60),
    }


def pattern() -> Column:
    return F.concat(*labellers().values())


def fit(counts: Mapping[str, int], rounds: int = 200, smooth: float = 1.0) -> dict[str, float]:
    """The posterior of being good, by pattern of votes.

    Each labeller has its own rates of the three votes on good and on bad
    documents; given the class, labellers vote independently.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])
    shown = np.eye(3)[votes]  # pattern, labeller, vote
    good = np.choose(np.minimum((votes == 0).sum(axis=1), 2), (0.95, 0.5, 0.05))  # one bad vote may be a mistake
    for _ in range(rounds):
        both = np.stack((1 - good, good)) * weight
        prior = (both.sum(axis=1) + smooth) / (both.sum() + 2 * smooth)
        rates = np.einsum("cp,pjv->cjv", both, shown) + smooth
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("pjv,cjv->cp", shown, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist()))


def endings(words: str) -> Column:
    """What is hashed: the end of each word, or a mark where it repeats the one before."""
    return F.transform(words, lambda w, i: F.when(w == F.get(words, i - 1), "=").otherwise(F.right(w, F.lit(3))))


def features(measures: DataFrame, *carried: str) -> DataFrame:
    parts = measures.select(*carried, F.size("words").alias("n"), common.once(endings("words")).alias("ends"))
    hashed = HashingTF(inputCol="ends", outputCol="counts", numFeatures=FEATURES).transform(parts)
    return Normalizer(inputCol="counts", outputCol="features", p=2.0).transform(hashed).drop("counts", "ends")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LogisticRegressionModel | None:
    """The scorer; None where there are no documents."""
    votes = measured(docs).select(pattern().alias("votes"))
    # as many rows as there are patterns, 3 to the number of labellers at most
    counts = {r["votes"]: r["n"] for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return None
    posterior = fit(counts)
    share = min(1.0, train_rows / total)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000))))
    # as many rows as there are patterns
    known = docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, good double")
    voted = measured(chosen).withColumn("votes", common.once(pattern()))
    rows = features(voted.join(F.broadcast(known), "votes"), "good")
    classes = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("label"), w.alias("weight")) for c, w in ((0, 1 - F.col("good")), (1, F.col("good"))))))
    rows = rows.where("n > 0").select("features", classes.alias("c")).select("features", "c.label", "c.weight").where("weight > 0.001")
    rows = session.materialise(rows, "weak-labels")
    if rows.isEmpty():
        return None
    return LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4).fit(rows)


def _scored(measures: DataFrame, model: LogisticRegressionModel | None, *carried: str) -> DataFrame:
    if model is None:
        return measures.select(*carried, F.lit(0.0).alias("score"))
    found = model.transform(features(measures, *carried))
    return found.select(*carried, common.once(F.when(F.col("n") > 0, vector_to_array("probability")[1]).otherwise(0.0)).alias("score"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, score, kept``: the scorer's probability that a document is good, and whether it reaches ``THRESHOLD``."""
    common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col)
    scored = _scored(measured(rows), train(rows, train_rows), "doc_id")
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    common.prepare(docs.sparkSession)
    model = train(common.texts(docs, id_col, text_col), train_rows)
    row = F.struct(*(common.column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    carried = docs.select(row.alias("doc_id"), F.coalesce(common.column(text_col), F.lit("")).alias("text"))
    kept = _scored(measured(carried), model, "doc_id").where(F.col("score") >= THRESHOLD)
    return kept.select(*(F.col(f"doc_id.c{k}").alias(c) for k, c in enumerate(docs.columns)))
