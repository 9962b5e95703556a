"""Where to build next: district scores, priorities, reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.functions.columns import r6
from fillgauge.operators.health import top_k

PARTS = ("population", "coverage", "income", "density", "connectivity")


def scored_districts(districts: DataFrame, weights: Mapping[str, float] = D.SITING_WEIGHTS) -> DataFrame:
    """Districts (district, population, income, density, n_stations) with five partial scores and the total."""
    measures = {"population": "population", "coverage": "n_stations", "income": "income", "density": "density"}
    extremes = districts.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"lo_{c}") for c in measures.values()],
            *[F.max(c).cast("double").alias(f"hi_{c}") for c in measures.values()],
        )
    ).scalar()

    def scaled(col):
        lo, hi = F.col(f"_e.lo_{col}"), F.col(f"_e.hi_{col}")
        return F.coalesce(C.ratio(F.col(col) - lo, hi - lo) * 100, F.lit(50.0))

    n = F.col("n_stations")
    linked = F.when(n.between(1, 2), 100.0).when(n == 0, 50.0).otherwise(30.0)
    raw = {name: scaled(col) for name, col in measures.items()}
    raw["coverage"] = 100 - raw["coverage"]
    raw["connectivity"] = linked
    out = districts.withColumn("_e", extremes)
    for name in PARTS:
        out = out.withColumn(f"score_{name}", raw[name] * F.lit(weights[name]))
    total = sum((F.col(f"score_{name}") for name in PARTS[1:]), F.col("score_population"))
    # Settle the binary representation before the half-even rounding to one decimal.
    return (
        out.drop("_e")
        .withColumn("score_total", F.bround(F.round(total, 9), 1))
        .withColumn("priority", C.band(F.col("score_total"), D.PRIORITY_EDGES, D.PRIORITY_LABELS))
    )


def siting_score(districts, *, weights=D.SITING_WEIGHTS):
    scored = scored_districts(districts, weights)
    return scored.select(
        "district", *[r6(F.col(f"score_{p}")).alias(f"score_{p}") for p in PARTS], "score_total", "priority"
    )


def siting_top_n(districts, *, n=5, weights=D.SITING_WEIGHTS):
    """The best districts with the reasons that speak for them."""
    best = top_k(scored_districts(districts, weights), "score_total", n, "district")
    stations = F.col("n_stations")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.round("score_population", 6) > 20,
                F.format_string(D.REASON_PEOPLE, F.col("population")),
            ),
            F.when(stations == 0, F.lit(D.REASON_UNSERVED)).when(
                stations < 2, F.lit(D.REASON_SPARSE)
            ),
            F.when(
                C.band(F.col("income"), D.INCOME_EDGES, D.INCOME_LABELS) == "Alta",
                F.lit(D.REASON_INCOME),
            ),
            F.when(F.col("density") > 10000, F.lit(D.REASON_DENSE)),
        )
    )
    return best.select(
        "rank", "district", "score_total", "priority", F.array_join(reasons, ", ").alias("reasons")
    )


def priority_distribution(districts, *, bins=5, weights=D.SITING_WEIGHTS):
    """Districts per priority, and their income histogram over equal bins of the whole range."""
    scored = scored_districts(districts, weights).withColumn("priority", F.coalesce("priority", F.lit("none")))
    extremes = districts.agg(F.struct(F.min("income").alias("lo"), F.max("income").alias("hi"))).scalar()
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    place = F.floor(F.round(C.ratio((F.col("income") - lo) * bins, hi - lo), 9)) + 1
    binned = scored.withColumn("_e", extremes).withColumn(
        "bin", F.coalesce(F.least(place, F.lit(bins)), F.lit(1)).cast("bigint")
    )
    cells = binned.groupBy("priority", "bin").agg(F.count("*").alias("bin_n"))
    totals = cells.groupBy("priority").agg(F.sum("bin_n").alias("n"))
    return cells.join(totals, "priority").select(
        "priority", F.col("n").cast("bigint").alias("n"), "bin", F.col("bin_n").cast("bigint").alias("bin_n")
    )


def income_fields(districts):
    """Monthly income, half to even, and the income band."""
    return districts.select(
        "district",
        F.bround(F.round(F.col("income") / 12, 9), 0).alias("income_month"),
        C.band(F.col("income"), D.INCOME_EDGES, D.INCOME_LABELS).alias("income_band"),
    )


def city_totals(districts):
    """Population of the city, its mean income, the richest and the most populated district."""
    return districts.agg(
        F.sum("population").cast("bigint").alias("population"),
        r6(F.avg("income")).alias("income_mean"),
        F.min_by("district", F.struct(-F.col("income"), "district")).alias("richest"),
        F.min_by("district", F.struct(-F.col("population"), "district")).alias("most_populated"),
    )
