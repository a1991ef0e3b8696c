"""Marts M04-M07 (S07 full-refresh tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..sources.standin import Entities
from . import intermediate as I
from . import staging as S


def _audit(df: DataFrame, with_audit: bool) -> DataFrame:
    """P20: ``refreshed_at`` audit column.  Non-deterministic, so the
    registered queries leave it out; writers pass ``with_audit=True``."""
    return df.withColumn("refreshed_at", F.current_timestamp()) if with_audit else df


def mart_route_summary(E: Entities, with_audit: bool = False,
                       route_perf: DataFrame | None = None) -> DataFrame:
    """Route x day KPIs; P13 target flag and peak ratio."""
    rp = route_perf if route_perf is not None else I.int_route_performance(E)
    out = rp.select(
        "route_id", "route_name", "district_covered", "trip_date", "total_trips",
        "total_passengers", "avg_passengers_per_trip", "total_revenue_php",
        "revenue_per_km_php", "avg_load_factor", "avg_travel_time_min", "avg_delay_min",
        "on_time_trips", "on_time_rate",
        C.flag(F.col("on_time_rate") >= K.ON_TIME_TARGET).alias("meets_ltfrb_target"),
        "peak_trips", "off_peak_trips",
        C.safe_ratio("peak_trips", "total_trips", 3).alias("peak_trip_ratio"),
        "is_rainy_day", "distinct_vehicles", "modern_vehicles", "avg_vehicle_capacity",
        "avg_fleet_age_years", "electric_vehicles", "pct_compliant_operators",
        "overcrowded_trips",
    )
    return _audit(out, with_audit)


def district_stops(E: Entities) -> DataFrame:
    """Stops per district, sheltered count and share."""
    st = S.stg_stops(E)
    return st.groupBy("district").agg(
        F.count("stop_id").alias("total_stops"),
        C.count_if(F.col("has_shelter") & F.col("stop_id").isNotNull()).alias("stops_with_shelter"),
    ).withColumn("pct_with_shelter", C.safe_ratio("stops_with_shelter", "total_stops", 3))


def district_survey(E: Entities, survey: DataFrame | None = None) -> DataFrame:
    """Survey means per origin district."""
    sv = S.stg_passenger_survey(E, survey)
    return sv.groupBy(F.col("origin_district").alias("district")).agg(
        C.round_mean("wait_time_min", 2).alias("avg_wait_time_min"),
        C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"))


def mart_district_ridership(E: Entities, with_audit: bool = False,
                            daily: DataFrame | None = None) -> DataFrame:
    """District x day roll-up of route-days (A07) with the static
    per-district stop and survey figures (J06)."""
    d = daily if daily is not None else I.int_daily_ridership(E)
    # Route-day grain makes every route appear once per (district, day), so
    # COUNT(DISTINCT route_id) equals COUNT(route_id): no distinct expansion.
    dd = d.groupBy(F.col("district_covered").alias("district"), "trip_date").agg(
        F.bool_or("is_rainy_day").alias("is_rainy_day"),
        F.sum("total_trips").alias("total_trips_serving"),
        F.count("route_id").alias("active_routes"),
        F.sum("total_passengers").alias("total_boardings"),
        F.sum("peak_passengers").alias("peak_boardings"),
        F.sum("weekend_passengers").alias("weekend_boardings"),
    )
    # per-district aggregates: AQE broadcasts them by their measured size
    out = (dd.join(district_stops(E), "district", "left")
             .join(district_survey(E), "district", "left")
             .select("district", "trip_date", "total_boardings", "total_trips_serving",
                     "active_routes", "avg_wait_time_min", "avg_satisfaction",
                     "pct_with_shelter",
                     F.coalesce("peak_boardings", F.lit(0)).alias("peak_boardings"),
                     F.coalesce("weekend_boardings", F.lit(0)).alias("weekend_boardings"),
                     "is_rainy_day"))
    return _audit(out, with_audit)


def mart_commuter_clusters(E: Entities, with_audit: bool = False,
                           features: DataFrame | None = None) -> DataFrame:
    """Clustered passengers only (P15), eligibility and weighted
    severity for cluster 3 (P12)."""
    f = features if features is not None else I.int_passenger_features(E)
    c3 = F.col("cluster_id") == K.UNDERSERVED_CLUSTER
    out = f.filter(F.col("cluster_id").isNotNull()).select(
        "passenger_id", "origin_barangay", "origin_district", "destination_type",
        "trip_purpose", "primary_route_used", "income_bracket", "prefers_aircon",
        "trips_per_week", "avg_fare_paid_php", "transfers_required", "wait_time_min",
        "travel_time_min", "satisfaction_score", "cluster_id", "cluster_label",
        C.flag(c3).alias("is_ab_test_eligible"),
        F.when(c3, C.weighted_severity()).alias("underserved_severity_score"),
        "primary_route_name", "primary_route_district", "route_length_km",
    )
    return _audit(out, with_audit)


def mart_ab_test_results(E: Entities, with_audit: bool = False,
                         features: DataFrame | None = None) -> DataFrame:
    """Experiment rows of passengers labelled Underserved (J07 inner
    join, which is a filter as well as an enrichment), P14 derived columns."""
    ab = S.stg_ab_experiment(E)
    f = features if features is not None else I.int_passenger_features(E)
    cl = f.filter(F.col("cluster_label") == K.UNDERSERVED_LABEL).select(
        "passenger_id", "cluster_id", "cluster_label", "origin_district", "income_bracket",
        "underserved_severity_score")
    treat = F.col("is_treatment")
    out = ab.drop("cluster_id").join(cl, "passenger_id").select(
        "experiment_record_id", "experiment_id", "passenger_id", "cluster_id",
        "cluster_label", "origin_district", "income_bracket", "group", "route_variant",
        "test_week", "experiment_phase", "is_treatment", "simulated_travel_time_min",
        F.col("simulated_fare_php").cast("double").alias("simulated_fare_php"),
        "transfers_needed", "satisfaction_score", "would_use_again",
        F.when(treat, F.lit(K.CONTROL_BASE_TRAVEL_MIN) - F.col("simulated_travel_time_min"))
         .alias("estimated_time_saving_min"),
        F.when(treat, F.col("simulated_fare_php") - F.lit(K.BASE_FARE_PHP).cast("decimal(6,2)"))
         .cast("double").alias("fare_delta_php"),
        "underserved_severity_score", "p_value", "is_significant", "effect_size",
        "confidence_interval_low", "confidence_interval_high",
    )
    return _audit(out, with_audit)
