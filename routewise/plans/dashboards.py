"""Dashboard queries D01-D26 (and the S12/S13 recent exports they read).

Each function takes the mart DataFrames it needs and returns the small
aggregated frame a page or BI slice shows; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import ranking as R
from ..operators import reshape as X
from ..operators import windows as W

PROFILE_FEATURES = ["trips_per_week", "avg_fare_paid_php", "transfers_required",
                    "wait_time_min", "travel_time_min", "satisfaction_score"]


# -- S12/S13: recent exports ---------------------------------------------------
def recent(df: DataFrame, date_col: str = "trip_date", days: int = K.RECENT_DAYS) -> DataFrame:
    """Rows with date >= max(date) - days (inclusive, up to days+1 dates).
    ``max`` is an uncorrelated scalar subquery (``DataFrame.scalar``): run
    once, then used as a scan filter, so partition pruning applies when the
    mart is partitioned by date."""
    mx = df.agg(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) >= F.date_sub(mx, days))


# -- Home page -------------------------------------------------------------
def home_kpis(clusters: DataFrame) -> DataFrame:
    """Passengers, mean score/fare/wait, underserved count and share."""
    n = F.count(F.lit(1))
    under = C.count_if(F.col("cluster_id") == K.UNDERSERVED_CLUSTER)
    return clusters.agg(
        n.alias("total_passengers"),
        C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"),
        C.round_mean("avg_fare_paid_php", 2).alias("avg_fare"),
        C.round_mean("wait_time_min", 1).alias("avg_wait_min"),
        under.alias("underserved_riders"),
        C.safe_ratio(under * 100, n, 1).alias("underserved_pct"))


def riders_by_route(summary: DataFrame) -> DataFrame:
    return summary.groupBy("route_id").agg(F.sum("total_passengers").alias("total_passengers"))


def top_routes(summary: DataFrame, k: int = 12) -> DataFrame:
    """Top k routes by riders."""
    return R.top_k(riders_by_route(summary), k, "total_passengers", ["route_id"])


def top_route_series(summary: DataFrame, k: int = 5) -> DataFrame:
    """Daily series restricted to the top k routes."""
    top = R.top_k(riders_by_route(summary), k, "total_passengers", ["route_id"])
    return R.restrict_to_top(summary, top, "route_id").select(
        "route_id", "trip_date", "total_passengers")


def boardings_by_district(district: DataFrame) -> DataFrame:
    """D03."""
    return district.groupBy("district").agg(F.sum("total_boardings").alias("total_boardings"))


# -- Cluster explorer --------------------------------------------------------
def filter_clusters(clusters: DataFrame, cluster_ids=None, districts=None, purposes=None,
                    incomes=None) -> DataFrame:
    """Optional multi-select filters; empty selection means all."""
    return clusters.filter(C.conj([
        C.optional_isin("cluster_id", cluster_ids),
        C.optional_isin("origin_district", districts),
        C.optional_isin("trip_purpose", purposes),
        C.optional_isin("income_bracket", incomes)]))


def cluster_kpis(clusters: DataFrame, **filters) -> DataFrame:
    """D04."""
    f = filter_clusters(clusters, **filters)
    return f.agg(F.count(F.lit(1)).alias("total_passengers"),
                 F.countDistinct("cluster_id").alias("clusters_shown"),
                 C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"),
                 C.round_mean("transfers_required", 2).alias("avg_transfers"),
                 C.round_mean("wait_time_min", 1).alias("avg_wait_min"))


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """Passengers per cluster."""
    return clusters.groupBy("cluster_id", "cluster_label").agg(F.count(F.lit(1)).alias("n"))


def cluster_comparison(clusters: DataFrame, a: int = 0, b: int = 3) -> DataFrame:
    """Per-feature means of two clusters and the difference (B - A),
    one filtered pass, then unpivoted."""
    aggs = []
    for c in PROFILE_FEATURES:
        aggs += [F.avg(F.when(F.col("cluster_id") == a, F.col(c))).alias(f"a_{c}"),
                 F.avg(F.when(F.col("cluster_id") == b, F.col(c))).alias(f"b_{c}")]
    wide = clusters.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("ma"),
                              F.col(f"b_{c}").alias("mb")) for c in PROFILE_FEATURES])
    return wide.select(F.inline(rows)).select(
        "feature",
        F.round("ma", 2).alias("mean_a"), F.round("mb", 2).alias("mean_b"),
        F.round(F.col("mb") - F.col("ma"), 2).alias("diff_b_minus_a"))


def cluster_cards(clusters: DataFrame) -> DataFrame:
    """Per-cluster means, share of passengers, aircon rate, top purpose."""
    g = clusters.groupBy("cluster_id", "cluster_label").agg(
        F.count(F.lit(1)).alias("passengers"),
        C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"),
        C.round_mean("transfers_required", 2).alias("avg_transfers"),
        C.round_mean("wait_time_min", 1).alias("avg_wait_min"),
        C.round_mean("trips_per_week", 1).alias("avg_trips_per_week"),
        C.round_mean("avg_fare_paid_php", 2).alias("avg_fare"),
        C.round_mean("travel_time_min", 1).alias("avg_travel_min"),
        F.round(F.avg(F.col("prefers_aircon").cast("int")) * 100, 1).alias("aircon_pct"))
    g = W.share_of_total(g, "passengers", "share_pct", 3)
    top_purpose = R.mode(clusters, ["cluster_id"], "trip_purpose").select(
        "cluster_id", F.col("mode_trip_purpose").alias("top_trip_purpose"))
    return g.join(top_purpose, "cluster_id", "left")


def cluster_top_districts(clusters: DataFrame, k: int = 5) -> DataFrame:
    """Top k origin districts per cluster by passengers."""
    counts = R.value_counts(clusters, ["cluster_id"], "origin_district")
    return R.top_k_per_group(counts, ["cluster_id"], k,
                             [F.col("n").desc(), F.col("origin_district").asc()])


def cluster_deviation(clusters: DataFrame) -> DataFrame:
    """Feature deviation from the overall mean per cluster."""
    g = W.group_means_with_deviation(clusters, ["cluster_id"], PROFILE_FEATURES)
    return g.select("cluster_id", *[F.round(f"{c}_dev", 6).alias(f"{c}_dev")
                                    for c in PROFILE_FEATURES])


def cluster_radar(clusters: DataFrame) -> DataFrame:
    """Per-cluster means min-max scaled across clusters."""
    g = clusters.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in PROFILE_FEATURES])
    s = W.minmax_scale(g, PROFILE_FEATURES, "_radar")
    return s.select("cluster_id", *[F.round(f"{c}_radar", 6).alias(f"{c}_radar")
                                    for c in PROFILE_FEATURES])


# -- Route trends ------------------------------------------------------------
def filter_routes(summary: DataFrame, route_ids=None, start=None, end=None) -> DataFrame:
    """Route set and inclusive date range."""
    cond = [C.optional_isin("route_id", route_ids)]
    if start is not None:
        cond.append(F.col("trip_date") >= F.lit(start).cast("date"))
    if end is not None:
        cond.append(F.col("trip_date") <= F.lit(end).cast("date"))
    return summary.filter(C.conj(cond))


def trend_kpis(summary: DataFrame, **flt) -> DataFrame:
    """Riders, days of data, mean load, revenue."""
    f = filter_routes(summary, **flt)
    return f.agg(F.sum("total_passengers").alias("total_passengers"),
                 F.countDistinct("trip_date").alias("days_of_data"),
                 F.round(F.avg(F.col("avg_load_factor").cast("decimal(18,3)").cast("decimal(28,10)")), 6).cast("double")
                  .alias("avg_load_factor"),
                 F.round(F.sum(F.col("total_revenue_php").cast("decimal(18,2)")), 2).cast("double")
                  .alias("total_revenue_php"))


def route_rolling_series(summary: DataFrame, smooth: int = 3, **flt) -> DataFrame:
    """Per-route n-row rolling mean of riders."""
    f = filter_routes(summary, **flt).select("route_id", "route_name", "trip_date",
                                             "total_passengers")
    out = W.rolling_mean(f, ["route_id"], "trip_date", "total_passengers", smooth,
                         "passengers_smoothed")
    return out.withColumn("passengers_smoothed", F.round("passengers_smoothed", 6))


def revenue_series(summary: DataFrame, smooth: int = 3, **flt) -> DataFrame:
    """Global daily revenue, optional n-row mean, then a 7-row mean
    of that series.  Money stays decimal and each smoothed stage is rounded
    half-up to cents, so ties (e.g. a 2-row mean ending in .5 cent) round
    the same way at any magnitude.  One row per date, so the
    single-partition window sees dates, not trips."""
    f = filter_routes(summary, **flt)
    daily = f.groupBy("trip_date").agg(
        F.sum(F.col("total_revenue_php").cast("decimal(18,2)")).alias("revenue"))
    if smooth > 1:
        daily = W.rolling_mean(daily, [], "trip_date", "revenue", smooth, "revenue")
        daily = daily.withColumn("revenue", F.round("revenue", 2))
    out = W.rolling_mean(daily, [], "trip_date", "revenue", 7, "revenue_7d")
    return out.select("trip_date", F.round("revenue", 2).cast("double").alias("revenue"),
                      F.round("revenue_7d", 2).cast("double").alias("revenue_7d"))


def route_weekday_heatmap(summary: DataFrame, **flt) -> DataFrame:
    """Route x weekday mean riders, weekday columns in calendar order."""
    f = filter_routes(summary, **flt).withColumn("day_of_week", C.weekday_name("trip_date"))
    return X.pivot_mean(f, ["route_id"], "day_of_week", K.WEEKDAYS, "total_passengers", 4)


def district_series(district: DataFrame, start=None, end=None) -> DataFrame:
    """District series in a date range."""
    cond = []
    if start is not None:
        cond.append(F.col("trip_date") >= F.lit(start).cast("date"))
    if end is not None:
        cond.append(F.col("trip_date") <= F.lit(end).cast("date"))
    return district.filter(C.conj(cond)).select("trip_date", "district", "total_boardings")


def top_bottom_routes(summary: DataFrame, routes: DataFrame, k: int = 5, **flt) -> DataFrame:
    """Top and bottom k routes by riders, with route names."""
    f = filter_routes(summary, **flt)
    agg = f.groupBy("route_id").agg(F.sum("total_passengers").alias("total_passengers"))
    return with_route_label(R.top_and_bottom(agg, k, "total_passengers", ["route_id"]), routes)


def with_route_label(df: DataFrame, routes: DataFrame) -> DataFrame:
    """J12: "id - name" display label from the (fixed-size) route dimension;
    a route missing from the lookup shows its id."""
    names = routes.select("route_id", "route_name")
    j = df.join(F.broadcast(names), "route_id", "left")
    label = F.concat_ws(" - ", F.col("route_id").cast("string"),
                        F.coalesce(F.col("route_name"), F.col("route_id").cast("string")))
    return j.withColumn("route_label", label).drop("route_name")


# -- Route map ---------------------------------------------------------------
def district_satisfaction_map(survey: DataFrame, stops: DataFrame) -> DataFrame:
    """District survey means joined to the district centroid
    (mean stop coordinates); districts without a centroid are skipped
    (inner join).  Colour scale and marker radius are plain expressions."""
    sv = survey.groupBy(F.col("origin_district").alias("district")).agg(
        C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"),
        C.round_mean("wait_time_min", 1).alias("avg_wait_min"),
        F.count(F.lit(1)).alias("respondents"))
    cen = stops.groupBy("district").agg(
        F.round(F.avg("latitude"), 6).cast("double").alias("lat"),
        F.round(F.avg("longitude"), 6).cast("double").alias("lon"))
    return (sv.join(cen, "district")
              .withColumn("color", C.score_color("avg_satisfaction"))
              .withColumn("radius", F.greatest(F.lit(5), F.col("respondents") / 10.0)))


def route_stop_stats(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes joined to stops through list membership (explode the
    comma list, then an equi-join), stops and boardings per route."""
    ex = stops.select("stop_id", "avg_daily_boardings", "has_shelter",
                      F.explode(F.split("routes_served", ",")).alias("rid"))
    ex = ex.withColumn("route_id", F.col("rid").cast("int"))
    return (ex.join(routes.select("route_id", "route_name"), "route_id")
              .groupBy("route_id", "route_name")
              .agg(F.count(F.lit(1)).alias("n_stops"),
                   F.sum("avg_daily_boardings").alias("total_daily_boardings"),
                   C.count_if(F.col("has_shelter")).alias("sheltered_stops")))


def stop_table(stops: DataFrame, stop_types=None, districts=None) -> DataFrame:
    """Stops filtered by type / district, by boardings."""
    f = stops.filter(C.optional_isin("stop_type", stop_types) & C.optional_isin("district", districts))
    return f.select("stop_id", "stop_name", "district", "stop_type", "avg_daily_boardings",
                    "has_shelter").orderBy(F.desc("avg_daily_boardings"), "stop_id")


# -- BI slices ---------------------------------------------------------------
def bi_daily_riders_by_route(summary: DataFrame, limit: int | None = None) -> DataFrame:
    """SUM(riders) by day and route; a limit is the slice's, if it sets one."""
    out = (summary.groupBy(F.to_date(F.date_trunc("day", "trip_date")).alias("day"), "route_id")
                   .agg(F.sum("total_passengers").alias("riders"))
                   .orderBy("day", "route_id"))
    return out if limit is None else out.limit(limit)


def bi_mean_by_route(df: DataFrame, measure: str, scale: int, alias: str) -> DataFrame:
    """Mean of a (rounded, decimal-scaled) measure by route."""
    return df.groupBy("route_id").agg(
        F.round(F.avg(F.col(measure).cast(f"decimal(18,{scale})")), 4).cast("double").alias(alias))


def bi_weekly_on_time(summary: DataFrame) -> DataFrame:
    """Weekly (Monday-start) mean on-time rate by route."""
    return summary.groupBy(F.to_date(F.date_trunc("week", "trip_date")).alias("week"), "route_id").agg(
        F.round(F.avg(F.col("on_time_rate").cast("decimal(18,3)")), 4).cast("double").alias("on_time_rate"))


def bi_peak_offpeak(daily: DataFrame) -> DataFrame:
    """Daily peak vs off-peak riders (off-peak = total - peak)."""
    return daily.groupBy("trip_date").agg(
        F.sum("peak_passengers").alias("peak_passengers"),
        (F.sum("total_passengers") - F.coalesce(F.sum("peak_passengers"), F.lit(0)))
         .alias("off_peak_passengers"))


def bi_rain_delay_box(summary: DataFrame) -> DataFrame:
    """Five-number summary of route-day delay by rain flag."""
    return X.five_number(summary, ["is_rainy_day"], "avg_delay_min")


def bi_district_daily(district: DataFrame) -> DataFrame:
    """Daily riders by district."""
    return district.groupBy("trip_date", "district").agg(F.sum("total_boardings").alias("riders"))


def bi_district_weekday(district: DataFrame) -> DataFrame:
    """District x weekday heat map (weekday derived from the date)."""
    d = district.withColumn("day_of_week", C.weekday_name("trip_date"))
    return X.pivot_mean(d, ["district"], "day_of_week", K.WEEKDAYS, "total_boardings", 4)


def bi_district_service(district: DataFrame) -> DataFrame:
    """Wait, satisfaction and shelter by district."""
    return district.groupBy("district").agg(
        F.round(F.avg(F.col("avg_wait_time_min").cast("decimal(18,2)")), 4).cast("double").alias("avg_wait_time_min"),
        F.round(F.avg(F.col("avg_satisfaction").cast("decimal(18,2)")), 4).cast("double").alias("avg_satisfaction"),
        F.round(F.avg(F.col("pct_with_shelter").cast("decimal(18,3)")), 4).cast("double").alias("pct_with_shelter"))


def bi_monthly_transfers(survey: DataFrame) -> DataFrame:
    """Monthly mean transfers by origin district (survey date)."""
    return survey.groupBy(F.to_date(F.date_trunc("month", "survey_date")).alias("month"),
                          F.col("origin_district").alias("district")).agg(
        C.round_mean("transfers_required", 4).alias("avg_transfers"))


def bi_ab_group_means(ab: DataFrame) -> DataFrame:
    """Mean score, travel time and transfers by group."""
    return ab.groupBy("group").agg(
        C.round_mean("satisfaction_score", 4).alias("avg_satisfaction"),
        F.round(F.avg(F.col("simulated_travel_time_min").cast("decimal(18,2)")), 4).cast("double")
         .alias("avg_travel_time"),
        C.round_mean("transfers_needed", 4).alias("avg_transfers"))


def bi_ab_reuse_counts(ab: DataFrame) -> DataFrame:
    """Counts by group x would-use-again."""
    return ab.groupBy("group", "would_use_again").agg(F.count(F.lit(1)).alias("n"))


def bi_ab_weekly_score(ab: DataFrame) -> DataFrame:
    """Mean score by week and group."""
    return ab.groupBy("test_week", "group").agg(C.round_mean("satisfaction_score", 4).alias("avg_satisfaction"))


def bi_ab_significance(ab: DataFrame, limit: int = 20) -> DataFrame:
    """The slice's first rows of the mart's statistics columns, in order of record."""
    return ab.orderBy("experiment_record_id").limit(limit).select(
        "experiment_record_id", "experiment_id", "group", "p_value", "is_significant", "effect_size", "confidence_interval_low", "confidence_interval_high")


# -- Filter options and bounds (D26) --------------------------------------------
def option_counts(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with counts."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")).orderBy(column)


def cluster_split(clusters: DataFrame, column: str) -> DataFrame:
    """Passengers by cluster and one attribute."""
    return clusters.groupBy("cluster_label", column).agg(F.count(F.lit(1)).alias("passengers"))


def bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def fleet_per_route(vehicles: DataFrame) -> DataFrame:
    """Vehicles and modernised vehicles per assigned route."""
    return vehicles.groupBy("route_assigned").agg(
        F.count(F.lit(1)).alias("vehicles"),
        C.count_if(F.col("vehicle_type") == "modernized_PUV").alias("modern_vehicles"))
