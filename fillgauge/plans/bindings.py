"""The driver tables seen as the telemetry data model.

Each function reads parquet below ``sf_dir`` and returns a lazy frame; the
oracle builds the same views in SQL (see ``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge.operators import snapshots
from fillgauge.operators.slices import shift
from fillgauge.session import materialise


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey bigint, c_acctbal double",
    "supplier": "s_suppkey bigint, s_nationkey bigint",
    "nation": "n_nationkey bigint, n_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns the jobs use, under a fixed schema: no footer is read to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table: one reading of one station."""
    k, station = F.col("k"), F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("capacity", (13 + station % 17).cast("int"))
        .withColumn("bikes", (F.floor("value").cast("bigint") % (14 + station % 17)).cast("int"))
        .select(
            "event_id",
            "ts",
            station.alias("station_id"),
            F.concat(F.lit("station_"), station.cast("string")).alias("station_name"),
            "capacity",
            "bikes",
            (F.col("capacity") - F.col("bikes")).cast("int").alias("docks"),
            (F.lit(43.33) + (station % 10).cast("double") * F.lit(0.005)).alias("lat"),
            (F.lit(-8.45) + (station % 13).cast("double") * F.lit(0.005)).alias("lon"),
            F.when(k % 5 == 0, k.cast("double") / 100).otherwise(F.lit(0.0)).alias("rain"),
            (k % 40).cast("double").alias("wind"),
            (5 + k % 20).cast("double").alias("temp"),
            k.alias("code"),
            "event_type",
        )
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension; one id in ten is missing on purpose."""
    return (
        telemetry(spark, sf_dir)
        .select("station_id", "station_name", "capacity", "lat", "lon")
        .where("station_id % 10 <> 9")
        .distinct()
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading in its frame of five minutes; the last of a station's frame stands."""
    kept = ["station_name", "capacity", "bikes", "docks", "rain", "wind", "temp"]
    return snapshots.aligned(telemetry(spark, sf_dir), values=kept, tie="event_id")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned readings over the frames in which they hold."""
    return materialise(snapshots.spans(aligned(spark, sf_dir)), "spans")


def fleet_sums() -> dict[str, Column]:
    """What the states of the fleet add up of each span."""
    return {"bikes": F.col("bikes"), "capacity": F.col("capacity"), "short": F.greatest(F.lit(0), 2 - F.col("bikes"))}


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        telemetry(spark, sf_dir)
        .where("event_type = 'view'")
        .select("event_id", "ts", "temp", "rain", "wind", "code")
    )


def city_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second city's station pings."""
    price = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_custkey") % 200).cast("bigint").alias("station_id"),
        F.col("o_orderdate").alias("ts"),
        (price % 25).cast("int").alias("bikes"),
        (24 - price % 25).cast("int").alias("docks"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).cast("double")
    people = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("pop"), (F.floor(cents / F.count("*")) / F.lit(100.0)).alias("inc"))
    )
    sites = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    pop = F.coalesce("pop", F.lit(0))
    return (
        nation.join(people, nation.n_nationkey == people.c_nationkey, "left")
        .join(sites, nation.n_nationkey == sites.s_nationkey, "left")
        .select(
            F.col("n_name").alias("district"),
            pop.cast("bigint").alias("population"),
            F.coalesce("inc", F.lit(0.0)).alias("income"),
            (pop * (1 + F.col("n_nationkey") % 7)).cast("bigint").alias("density"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_stations"),
        )
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and uses so far, per series and month with new users."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_ts"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def monthly(rows: DataFrame, time: str, out: str) -> DataFrame:
        return (
            rows.join(customer, rows.o_custkey == customer.c_custkey)
            .groupBy("c_nationkey", F.date_trunc("month", time).cast("timestamp_ntz").alias("month"))
            .agg(F.count("*").alias(out))
        )

    so_far = Window.partitionBy("series").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    both = (
        monthly(first, "first_ts", "new_users")
        .join(monthly(orders, "o_orderdate", "_uses"), ["c_nationkey", "month"], "full")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("series"), "month")
        .agg(F.sum("new_users").alias("new_users"), F.sum("_uses").alias("_uses"))
    )
    return (
        both.withColumn("users", F.sum("new_users").over(so_far).cast("bigint"))
        .withColumn("uses", F.sum("_uses").over(so_far).cast("bigint"))
        .where("new_users IS NOT NULL")
        .select("series", "month", "new_users", "users", "uses")
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a score that need no learner."""
    ahead = shift(
        telemetry(spark, sf_dir).select("event_id", "station_id", "ts", "bikes", "capacity"),
        "station_id",
        ["ts", "event_id"],
        {"future_bikes": ("bikes", 6)},
    )
    return ahead.where("future_bikes is not null").select(
        "event_id",
        "station_id",
        "ts",
        "bikes",
        (F.col("future_bikes") < 5).cast("int").alias("label"),
        F.round(1 - F.col("bikes").cast("double") / F.col("capacity"), 2).alias("score"),
    )


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        telemetry(spark, sf_dir)
        .select("station_id", (F.col("station_id") % 4).cast("int").alias("cluster"))
        .distinct()
    )
