"""Every job bound to the driver tables: slug -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import defaults as D
from fillgauge.functions import columns as C
from fillgauge.operators import clusters, demand, distinct, enrich, evaluation, features, fleet, growth, health, learners, pairs, siting, snapshots
from fillgauge.plans import bindings as B
from fillgauge.plans import replay
from fillgauge.session import materialise, prepare, shared_dir
from fillgauge.sources import cities, feeds, results, tracking
from fillgauge.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The driver's events are from 2024; the holiday list is a parameter.
HOLIDAYS = ("2024-01-01", "2024-01-06")
# Their readings are hours apart, and so are the frames in which changes meet.
FLOW_SECONDS = 6 * 3600


def query(job: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(prepare(spark), sf_dir)

    run.__doc__ = job.__doc__
    QUERIES[job.__name__] = run
    return run


def on(binding: Callable, slug: str, job: Callable[[DataFrame], DataFrame]) -> None:
    """Register a job of a single bound frame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(binding(prepare(spark), sf_dir))

    QUERIES[slug] = run


def iso_date(df: DataFrame) -> DataFrame:
    """Dates as text, which every client renders alike."""
    return df.withColumn("date", F.col("date").cast("string"))


# --- sources -----------------------------------------------------------------


def spanish_csv(df: DataFrame, path: str) -> None:
    """Readings as the sheet export writes them: Spanish header, semicolons, decimal commas."""

    def comma(c):
        return F.regexp_replace(F.col(c).cast("string"), r"\.", ",")

    df.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("station_id").alias("ID"),
        F.col("station_name").alias("Nombre"),
        comma("lat").alias("Lat"),
        comma("lon").alias("Lon"),
        F.col("capacity").alias("Capacidad"),
        F.col("bikes").alias("Bicis"),
        F.col("docks").alias("Docks"),
        comma("temp").alias("Temp"),
        comma("rain").alias("Lluvia"),
        comma("wind").alias("Viento"),
    ).write.csv(path, sep=";", header=True)


@query
def scan_tracking(spark, sf_dir):
    folder = shared_dir(spark, "tracking")
    spanish_csv(B.telemetry(spark, sf_dir), f"{folder}/export.csv")
    scanned = tracking.scan_newest(spark, f"{folder}/*.csv", decimal=",")
    return scanned.withColumns({c: C.r6(F.col(c)) for c in ("lat", "lon", "temp", "rain", "wind")})


@query
def flatten_station_info(spark, sf_dir):
    """Stations encoded as feed documents, a thousand ids each; the feed omits capacities below 16."""
    station = F.struct(
        "station_id",
        F.col("station_name").alias("name"),
        "lat",
        "lon",
        F.when(F.col("capacity") >= 16, F.col("capacity")).alias("capacity"),
    )
    documents = (
        B.stations(spark, sf_dir)
        .groupBy(F.floor(F.col("station_id") / 1000))
        .agg(F.to_json(F.struct(F.struct(F.collect_list(station).alias("stations")).alias("data"))).alias("payload"))
    )
    return feeds.flatten_station_info(documents).withColumns({c: C.r6(F.col(c)) for c in ("lat", "lon")})


@query
def flatten_station_status(spark, sf_dir):
    """Every reading in the feed document of its frame; the feed omits counts of zero."""
    station = F.struct(
        "station_id",
        F.when(F.col("bikes") > 0, F.col("bikes")).alias("num_bikes_available"),
        (F.col("capacity") - F.col("bikes")).alias("num_docks_available"),
    )
    documents = (
        B.telemetry(spark, sf_dir)
        .groupBy(C.floor_time("ts", D.FRAME_SECONDS), F.floor(F.col("station_id") / 1000))
        .agg(F.to_json(F.struct(F.struct(F.collect_list(station).alias("stations")).alias("data"))).alias("payload"))
    )
    return feeds.flatten_station_status(documents)


@query
def parse_weather(spark, sf_dir):
    """Readings as weather documents; codes above 90 come without ``current``."""
    current = F.struct(
        F.col("temp").alias("temperature_2m"),
        F.when(F.col("rain") > 0, F.col("rain")).alias("precipitation"),
        F.col("wind").alias("wind_speed_10m"),
        F.col("code").alias("weather_code"),
    )
    documents = B.weather(spark, sf_dir).select(
        "event_id", F.to_json(F.struct(F.when(F.col("code") <= 90, current).alias("current"))).alias("payload")
    )
    return feeds.parse_weather(documents, keep=("event_id",))


@query
def polygon_centroids(spark, sf_dir):
    """A unit square per nation; every tenth is a point, every seventh has no name."""
    k = F.col("n_nationkey").cast("double")
    vertex = lambda dx, dy: F.array(k + F.lit(float(dx)), F.lit(float(dy)))
    ring = F.array(vertex(0, 0), vertex(1, 0), vertex(1, 1), vertex(0, 1), vertex(0, 0))
    feature = F.struct(
        F.struct(
            F.col("n_nationkey").alias("OBJECTID"),
            F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("CAPA"),
        ).alias("properties"),
        F.struct(
            F.when(F.col("n_nationkey") % 10 == 9, "Point").otherwise("Polygon").alias("type"),
            F.array(ring).alias("coordinates"),
        ).alias("geometry"),
    )
    documents = B.table(spark, sf_dir, "nation").select(
        F.to_json(F.struct(F.array(feature).alias("features"))).alias("payload")
    )
    return feeds.polygon_centroids(documents)


def hourly_city(spark, sf_dir) -> DataFrame:
    """Readings per hour as the rental count; its weather from the largest code of the hour."""
    hourly = (
        B.telemetry(spark, sf_dir)
        .groupBy(F.to_date("ts").alias("dteday"), C.hour_of("ts").alias("hr"))
        .agg(
            F.count("*").alias("cnt"),
            (F.max("code") % 5).alias("weathersit"),
            (F.max("temp") / 50).alias("temp"),
        )
        .withColumn("weekday", F.dayofweek("dteday") - 1)
    )
    return cities.load_hourly_city(hourly)


QUERIES["load_hourly_city"] = lambda spark, sf_dir: hourly_city(prepare(spark), sf_dir)


def second_city(spark, sf_dir) -> DataFrame:
    """The second city's pings under their original column names."""
    pings = B.city_b(spark, sf_dir).withColumnsRenamed(
        {"bikes": "num_bikes_available", "docks": "num_docks_available", "ts": "Timestamp"}
    )
    return cities.load_station_city(pings, city="b", keep=("event_id",))


def first_city(spark, sf_dir) -> DataFrame:
    """Telemetry in the unified schema, with weather."""
    hour, dow = C.hour_of("ts"), C.weekday_of("ts")
    return B.telemetry(spark, sf_dir).select(
        F.lit("a").alias("city"),
        "station_id",
        "event_id",
        "ts",
        "bikes",
        "docks",
        "capacity",
        C.r6(C.occupancy()).alias("occupancy"),
        hour.alias("hour"),
        dow.alias("day_of_week"),
        C.weekend(dow).alias("is_weekend"),
        C.in_ranges(hour, D.RUSH_THREE_PEAKS).alias("is_rush_hour"),
        C.flag(F.col("rain") > 0).alias("is_raining"),
        F.col("temp").alias("temperature"),
    )


def all_cities(spark, sf_dir, out: str | None = None) -> DataFrame:
    """Two cities of stations and one that is an hourly series."""
    return cities.unify_cities(first_city(spark, sf_dir), second_city(spark, sf_dir), hourly_city(spark, sf_dir), out=out)


QUERIES["load_station_city"] = lambda spark, sf_dir: second_city(prepare(spark), sf_dir)


@query
def unify_cities(spark, sf_dir):
    return all_cities(spark, sf_dir, shared_dir(spark, "cities"))


on(B.city_b, "sample_and_cap", tracking.sample_and_cap)


@query
def publish_tracking(spark, sf_dir):
    rows = B.telemetry(spark, sf_dir).withColumns({c: C.r6(F.col(c)) for c in ("lat", "lon")})
    return tracking.publish_tracking(rows, shared_dir(spark, "published"))


@query
def export_frames(spark, sf_dir):
    frames = tracking.export_frames(B.telemetry(spark, sf_dir))
    return frames.withColumn("stations", F.to_json("stations"))


# --- projections, predicates, features ----------------------------------------

on(
    B.telemetry,
    "occupancy_ratio",
    # the feed omits some capacities, and gives others as 0
    lambda df: features.occupancy_ratio(
        df.withColumn("capacity", F.when(F.col("code") % 9 == 1, F.lit(0)).when(F.col("code") % 9 != 0, F.col("capacity")))
    ),
)
on(B.telemetry, "calendar_features", lambda df: iso_date(features.calendar_features(df)))
on(B.telemetry, "rush_hour_flag", features.rush_hour_flag)
on(B.telemetry, "holiday_flag", lambda df: features.holiday_flag(df, holidays=HOLIDAYS))
on(B.telemetry, "season_and_service_filter", features.season_and_service_filter)
on(B.telemetry, "weather_label", features.weather_label)
on(B.telemetry, "cyclic_encode", features.cyclic_encode)
on(B.telemetry, "status_flags", features.status_flags)
on(B.telemetry, "minmax_scale", features.minmax_scale)
on(all_cities, "zscore_by_group", lambda df: features.zscore_by_group(df, col="bikes", key="event_id"))
on(
    B.telemetry,
    "band_label",
    lambda df: features.band_label(
        df, C.occupancy() - 0.5, D.TREND_EDGES, D.TREND_LABELS, key="event_id", open_ended=True
    ),
)
on(B.telemetry, "occupancy_band", features.occupancy_band)
on(
    B.telemetry,
    "complete_cases",
    lambda df: features.complete_cases(
        df.withColumn("wind", F.when(F.col("code") % 11 != 0, F.col("wind"))).withColumn(
            "rain", F.when(F.col("code") % 7 != 0, F.col("rain"))
        ),
        ["bikes", "wind"],
        "rain",
    ),
)
on(all_cities, "transfer_features", features.transfer_features)
on(B.telemetry, "bike_delta", lambda df: features.bike_delta(df).select("event_id", "station_id", "ts", "delta", "abs_delta"))
on(B.telemetry, "trend_features", features.trend_features)
on(B.telemetry, "future_status_target", features.future_status_target)
on(B.telemetry, "delta_target", features.delta_target)
on(B.telemetry, "time_split", features.time_split)
on(B.telemetry, "time_horizon_target", lambda df: features.time_horizon_target(df, tol_min=720))
on(B.telemetry, "random_split", features.random_split)

# --- joins ----------------------------------------------------------------------


@query
def enrich_status(spark, sf_dir):
    rows = enrich.enrich_status(B.telemetry(spark, sf_dir), B.stations(spark, sf_dir))
    return rows.withColumns({c: C.r6(F.col(c)) for c in ("lat", "lon")})


@query
def weather_asof(spark, sf_dir):
    snaps = B.telemetry(spark, sf_dir).where("event_type <> 'view'")
    return enrich.weather_asof(snaps, B.weather(spark, sf_dir))


@query
def stats_with_cluster(spark, sf_dir):
    """Only stations of the dimension have a cluster."""
    known = B.stations(spark, sf_dir).select("station_id")
    given = B.assignment(spark, sf_dir).join(known, "station_id", "left_semi")
    return enrich.stats_with_cluster(B.telemetry(spark, sf_dir), given)


@query
def merge_coverage(spark, sf_dir):
    """Coverage is known where a district has more than two stations, else the default of 1 holds."""
    districts = B.districts(spark, sf_dir)
    covered = districts.where("n_stations > 2").select("district", "n_stations")
    return enrich.merge_coverage(districts, covered)


def flows(df: DataFrame) -> DataFrame:
    """Opposed changes from one frame of readings to the next."""
    return pairs.infer_flows(snapshots.aligned(df, values=["bikes"], tie="event_id", seconds=FLOW_SECONDS))


@query
def flow_geometry(spark, sf_dir):
    edges = flows(B.telemetry(spark, sf_dir))
    return enrich.flow_geometry(edges, B.stations(spark, sf_dir))


@query
def coverage_radius(spark, sf_dir):
    """Stations of the dimension around the mean position of each group of 25 station ids."""
    points = (
        B.telemetry(spark, sf_dir)
        .groupBy(F.floor(F.col("station_id") / 25).cast("bigint").alias("point_id"))
        .agg(F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"))
    )
    return enrich.coverage_radius(points, B.stations(spark, sf_dir), radius_m=1500.0)


# --- aggregations ---------------------------------------------------------------

on(B.telemetry, "system_overview", health.system_overview)
on(B.telemetry, "system_health", health.system_health)
on(
    B.telemetry,
    "distinct_stations",
    lambda df: iso_date(distinct.distinct_by_day(materialise(distinct.daily_sketches(df), "daily-sketches"))),
)
on(B.spans, "snapshot_health", health.health_states)
on(B.telemetry, "station_stats", health.station_stats)
on(B.telemetry, "over_under_utilised", lambda df: health.over_under_utilised(df, hi=55, lo=42))
on(B.telemetry, "ghost_stations", lambda df: health.ghost_stations(df, max_std=5))
on(B.telemetry, "activity_ranking", health.activity_ranking)
on(B.telemetry, "activity_by_band", demand.activity_by_band)
on(B.telemetry, "peak_hours", demand.peak_hours)
on(B.telemetry, "weekday_pattern", demand.weekday_pattern)
on(B.telemetry, "rain_occupancy_impact", demand.rain_occupancy_impact)
on(B.telemetry, "weather_activity_impact", demand.weather_activity_impact)
on(B.telemetry, "weather_correlation", demand.weather_correlation)
on(B.telemetry, "trips_and_co2", demand.trips_and_co2)


def enough(spans: DataFrame):
    """The stations that a complete snapshot has, at least."""
    return F.lit(D.COMPLETE_SHARE) * spans.agg(F.count_distinct("station_id")).scalar()


@query
def fleet_utilisation(spark, sf_dir):
    """Over the frames in which the snapshot is complete."""
    spans = B.spans(spark, sf_dir)
    return fleet.utilisation_of(snapshots.complete(snapshots.states(spans, B.fleet_sums()), enough(spans)))


on(B.telemetry, "atypical_days", lambda df: iso_date(demand.atypical_days(df)))
on(B.telemetry, "stockout_heatmap", demand.stockout_heatmap)
on(B.telemetry, "occupancy_heatmap", demand.occupancy_heatmap)
on(B.telemetry, "stockout_roi", demand.stockout_roi)
on(B.telemetry, "downtime_top", health.downtime_top)
on(B.telemetry, "depletion_sla", demand.depletion_sla)


@query
def fleet_deficit(spark, sf_dir):
    """Over all frames; a station that is not present lacks its whole buffer."""
    spans = B.spans(spark, sf_dir)
    return fleet.deficit_of(snapshots.states(spans, B.fleet_sums()), fleet.station_capacities(spans))


on(B.telemetry, "empty_time_risk", health.empty_time_risk)
on(B.telemetry, "network_risk", health.network_risk)
on(B.telemetry, "frame_stats", fleet.frame_stats)
on(B.telemetry, "hourly_profile", demand.hourly_profile)
on(all_cities, "city_summary", demand.city_summary)
on(B.telemetry, "station_mode", health.station_mode)
on(B.telemetry, "capacity_frequency", health.capacity_frequency)
on(B.telemetry, "service_level", health.service_level)


@query
def cluster_scorecard(spark, sf_dir):
    return health.cluster_scorecard(B.telemetry(spark, sf_dir), B.assignment(spark, sf_dir))


@query
def complete_snapshots(spark, sf_dir):
    """The spans that begin in a frame in which nine tenths of all stations are present."""
    spans = B.spans(spark, sf_dir)
    whole = snapshots.complete(snapshots.states(spans, {}), enough(spans))
    rows = fleet.of_complete(spans, materialise(whole, "complete"))
    return rows.select("ts", "until", "station_id", "station_name", "capacity", "bikes", "rain", "wind", "temp")


@query
def health_report(spark, sf_dir):
    """The one-row sections of the report as one long table."""
    df = B.telemetry(spark, sf_dir)
    overview = health.system_overview(df).select("days", "n_stations", "capacity_total", "n_obs")
    costs = demand.stockout_roi(df).select("trips_lost", "churners")
    return health.report({"overview": overview, "costs": costs})


# --- pairs and clusters ---------------------------------------------------------

on(B.telemetry, "infer_flows", flows)
on(B.telemetry, "twin_stations", lambda df: pairs.twin_stations(df, min_overlap=4))


def groupings(df: DataFrame, ks) -> DataFrame:
    """Given groupings of the stations: cluster = station id modulo k."""
    return df.select("station_id").distinct().select(
        "station_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    ).withColumn("cluster", (F.col("station_id") % F.col("k")).cast("int"))


on(B.telemetry, "cluster_stations", clusters.cluster_stations)
on(B.telemetry, "elbow_curve", clusters.elbow_curve)
on(B.telemetry, "elbow_pick", lambda df: clusters.elbow_pick(clusters.grouping_inertia(df, groupings(df, range(2, 11)))))
on(B.telemetry, "silhouette_pick", lambda df: clusters.silhouette_pick(df, groupings(df, range(2, 7))))


@query
def cluster_archetypes(spark, sf_dir):
    return clusters.cluster_archetypes(B.telemetry(spark, sf_dir), B.assignment(spark, sf_dir))


@query
def cluster_profiles(spark, sf_dir):
    return clusters.cluster_profiles(B.telemetry(spark, sf_dir), B.assignment(spark, sf_dir))


@query
def assign_nearest_centroid(spark, sf_dir):
    df = B.telemetry(spark, sf_dir)
    return clusters.assign_nearest_centroid(df, clusters.mean_profiles(df, B.assignment(spark, sf_dir)))


# --- prediction -----------------------------------------------------------------

on(B.telemetry, "train_empty_classifier", lambda df: learners.train_classifier(df, "will_be_empty"))
on(B.telemetry, "train_full_classifier", lambda df: learners.train_classifier(df, "will_be_full"))
on(B.telemetry, "train_delta_regressor", lambda df: learners.train_delta_regressor(df))


@query
def transfer_learn(spark, sf_dir):
    source = B.city_b(spark, sf_dir).withColumn("capacity", F.col("bikes") + F.col("docks"))
    return learners.transfer_learn(source, B.telemetry(spark, sf_dir))


@query
def transfer_regressor(spark, sf_dir):
    source = B.city_b(spark, sf_dir).withColumn("capacity", F.col("bikes") + F.col("docks"))
    return learners.transfer_regressor(source, B.telemetry(spark, sf_dir))


@query
def model_definition_sweep(spark, sf_dir):
    """Empty as fewer than so many bikes, or as a share of the capacity."""
    future, share = F.col("future_bikes"), F.lit(0.2) * F.col("capacity")
    definitions = {f"below {k}": future < k for k in D.EMPTY_CANDIDATES} | {"below 20 %": future < share}
    now = {f"below {k}": F.col("bikes") < k for k in D.EMPTY_CANDIDATES} | {"below 20 %": F.col("bikes") < share}
    return learners.definition_sweep(B.telemetry(spark, sf_dir), definitions, now)


@query
def feature_importance(spark, sf_dir):
    frame = materialise(learners.model_frame(B.telemetry(spark, sf_dir)), "model-frame")
    model = learners.fit_classifier(frame, "will_be_empty", learners.ALL_FEATURES, 500, 42)
    return learners.feature_importance(model, spark)


@query
def score_and_label(spark, sf_dir):
    frame = materialise(learners.delta_frame(B.telemetry(spark, sf_dir)), "delta-frame")
    model = learners.fit_regressor(frame)
    return learners.score_and_label(model, frame)


on(B.scored, "classification_metrics", evaluation.classification_metrics)
on(B.scored, "threshold_sweep", evaluation.threshold_sweep)
on(B.telemetry, "empty_definition_sweep", evaluation.empty_definition_sweep)
on(B.telemetry, "fixed_vs_pct_threshold", evaluation.fixed_vs_pct_threshold)
on(B.telemetry, "persistence_baseline", evaluation.persistence_baseline)
on(B.scored, "roc_auc", evaluation.roc_auc)
on(B.scored, "average_precision", evaluation.average_precision)
on(
    B.scored,
    "regression_metrics",
    lambda df: evaluation.regression_metrics(df, group=F.concat(F.lit("g"), F.col("station_id") % 4)),
)


@query
def model_comparison(spark, sf_dir):
    """"Empty now, empty later" against the fixed score rule on the same rows."""
    rows = B.scored(spark, sf_dir)
    empty_now = rows.withColumn("now", (F.col("bikes") < D.EMPTY_BELOW).cast("double"))
    long = evaluation.metrics_long(
        evaluation.classification_metrics(empty_now, score="now"), "persistence"
    ).unionByName(evaluation.metrics_long(evaluation.classification_metrics(rows), "score_rule"))
    return evaluation.model_comparison(long, "persistence", "score_rule")


# --- growth and siting ----------------------------------------------------------

on(B.history, "growth_metrics", lambda df: growth.growth_metrics(df, uses="uses"))
REGIME_DATE = "1996-01-01"
LOGISTIC_BOUNDS = ((0.001, 2.0), (-50, 200))
on(B.history, "cagr", lambda df: growth.cagr(df, split_date=REGIME_DATE))
on(B.history, "fit_exponential", lambda df: growth.fit_exponential(df, split_date=REGIME_DATE))
on(B.history, "fit_logistic", lambda df: growth.fit_logistic(df, bounds=LOGISTIC_BOUNDS, split_date=REGIME_DATE))
on(B.history, "project_growth", lambda df: growth.project_growth(df, bounds=LOGISTIC_BOUNDS, split_date=REGIME_DATE))
on(B.districts, "siting_score", siting.siting_score)
on(B.districts, "siting_top_n", siting.siting_top_n)
on(B.districts, "priority_distribution", siting.priority_distribution)
on(B.districts, "income_fields", siting.income_fields)
on(B.districts, "city_totals", siting.city_totals)


@query
def publish_results(spark, sf_dir):
    """The district ranking as a CSV result: one version, and another that replaces it."""
    ranking = siting.siting_score(B.districts(spark, sf_dir)).select("district", "score_total", "priority")
    root = shared_dir(spark, "ranking")
    results.publish(ranking.where("priority = 'Alta'"), root, "csv")
    results.publish(ranking, root, "csv")
    return results.read(spark, root, ranking.schema, "csv")


# --- streaming ------------------------------------------------------------------


def ten_days(df: DataFrame) -> list[DataFrame]:
    """January in three pieces of ten days; the last one takes the rest."""
    cut = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21")]
    ts = F.col("ts")
    return [df.where(ts < cut[0]), df.where((ts >= cut[0]) & (ts < cut[1])), df.where(ts >= cut[1])]


def closed(df: DataFrame) -> list[DataFrame]:
    """January in pieces, then one row a day past the end: the watermark passes every window but that row's own."""
    last = df.agg(F.max("ts") + F.expr("INTERVAL 1 DAY")).first()[0]
    ids = {c: F.lit(-1).cast("bigint") for c in ("event_id", "station_id") if c in df.columns}
    return [*ten_days(df), df.limit(1).withColumns({**ids, "ts": F.lit(last).cast("timestamp_ntz")})]


def streamed(spark, pieces, start, purpose, *times) -> DataFrame:
    out = spark.read.parquet(replay.replay(spark, pieces, start, purpose))
    return out.withColumns({t: C.naive(F.col(t)) for t in times})


@query
def stream_enrich(spark, sf_dir):
    df, dimension = B.telemetry(spark, sf_dir), B.stations(spark, sf_dir)
    start = replay.to_parquet(lambda s: jobs.stream_enrich(s, dimension, holidays=HOLIDAYS))
    rows = streamed(spark, ten_days(df), start, "enrich", "ts")
    return rows.withColumns({c: C.r6(F.col(c)) for c in ("lat", "lon")})


@query
def stream_delta(spark, sf_dir):
    df = B.telemetry(spark, sf_dir).select("event_id", "station_id", "ts", "bikes")
    return streamed(spark, ten_days(df), replay.delta_starter, "delta", "ts").where("late = 0").drop("bikes", "late")


@query
def stream_system_health(spark, sf_dir):
    df = B.telemetry(spark, sf_dir).select("ts", "bikes", "docks", "capacity")
    start = replay.to_parquet(jobs.stream_system_health)
    return streamed(spark, closed(df), start, "health", "ts")


@query
def stream_corrected_health(spark, sf_dir):
    """Every fifth reading comes a month late, and corrects the windows reported before."""
    df = B.telemetry(spark, sf_dir).select("event_id", "ts", "bikes", "docks", "capacity")
    late = F.col("event_id") % 5 == 0
    pieces = [p.drop("event_id") for p in (*ten_days(df.where(~late)), df.where(late))]
    out = replay.replay(spark, pieces, jobs.window_partials, "corrected")
    return jobs.window_totals(spark.read.parquet(out))


@query
def stream_hourly_activity(spark, sf_dir):
    df = B.telemetry(spark, sf_dir).select("event_id", "station_id", "ts", "bikes")
    start = replay.chained(jobs.stream_hourly_activity)
    return streamed(spark, closed(df), start, "activity", "hour_ts")


@query
def stream_dedup(spark, sf_dir):
    """Every third poll arrives twice."""
    df = B.telemetry(spark, sf_dir).select("event_id", "station_id", "ts", "bikes")
    twice = [piece.unionByName(piece.where("event_id % 3 = 0")) for piece in ten_days(df)]
    return streamed(spark, twice, replay.to_parquet(jobs.stream_dedup), "dedup", "ts")
