"""Intermediate models M01-M03."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..sources.standin import Entities
from . import staging as S


def int_daily_ridership(E: Entities, trips: DataFrame | None = None) -> DataFrame:
    """Route x day.  Aggregate first (partial aggregation map-side), then
    join the fixed-size route dimension to the small aggregate (J01)."""
    t = trips if trips is not None else S.stg_trips(E)
    daily = t.groupBy("route_id", "trip_date").agg(
        F.bool_or("is_rainy_day").alias("is_rainy_day"),
        F.count("trip_id").alias("total_trips"),
        F.sum("passengers_boarded").alias("total_passengers"),
        C.round_mean("passengers_boarded", 2).alias("avg_passengers_per_trip"),
        F.sum("revenue_php").alias("total_revenue_php"),
        C.round_mean("load_factor", 3).alias("avg_load_factor"),
        C.round_mean("travel_time_min", 2).alias("avg_travel_time_min"),
        C.round_mean("delay_min", 2).alias("avg_delay_min"),
        C.count_if(F.col("is_on_time") & F.col("trip_id").isNotNull()).alias("on_time_trips"),
        C.count_if(F.col("is_peak") & F.col("trip_id").isNotNull()).alias("peak_trips"),
        C.count_if(~F.col("is_peak") & F.col("trip_id").isNotNull()).alias("off_peak_trips"),
        C.sum_if("passengers_boarded", F.col("is_peak")).alias("peak_passengers"),
        C.sum_if("passengers_boarded", F.col("is_weekend")).alias("weekend_passengers"),
    )
    r = S.stg_routes(E).select("route_id", "route_name", "district_covered", "route_length_km")
    return daily.join(r, "route_id").select(
        "route_id", "route_name", "district_covered", "route_length_km", "trip_date",
        "is_rainy_day", "total_trips", "total_passengers", "avg_passengers_per_trip",
        F.col("total_revenue_php").cast("double").alias("total_revenue_php"),
        C.safe_ratio("total_revenue_php", "route_length_km", 2).alias("revenue_per_km_php"),
        "avg_load_factor", "avg_travel_time_min", "avg_delay_min", "on_time_trips",
        C.safe_ratio("on_time_trips", "total_trips", 3).alias("on_time_rate"),
        "peak_trips", "off_peak_trips", "peak_passengers", "weekend_passengers",
    )


def _route_vehicle_day(t: DataFrame) -> DataFrame:
    """Level 1 of M02: trips -> (route, day, vehicle).  Every trip measure is
    kept as (sum, non-null count) so means stay exact after the second level."""
    nn = lambda c: F.count(c)  # noqa: E731  (count of non-NULL values)
    return t.groupBy("route_id", "trip_date", "vehicle_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("trip_id").alias("n_trips"),
        F.bool_or("is_rainy_day").alias("any_rain"),
        F.sum("passengers_boarded").alias("s_pass"), nn("passengers_boarded").alias("c_pass"),
        F.sum("revenue_php").alias("s_rev"),
        F.sum("load_factor").alias("s_load"), nn("load_factor").alias("c_load"),
        F.sum("travel_time_min").alias("s_travel"), nn("travel_time_min").alias("c_travel"),
        F.sum("delay_min").alias("s_delay"), nn("delay_min").alias("c_delay"),
        C.count_if(F.col("is_on_time") & F.col("trip_id").isNotNull()).alias("n_on_time"),
        C.count_if(F.col("is_peak") & F.col("trip_id").isNotNull()).alias("n_peak"),
        C.count_if(~F.col("is_peak") & F.col("trip_id").isNotNull()).alias("n_off_peak"),
        C.count_if(F.col("is_overcrowded") & F.col("trip_id").isNotNull()).alias("n_overcrowded"),
    )


def int_route_performance(E: Entities, trips: DataFrame | None = None) -> DataFrame:
    """M02 in two levels.

    The one-level SQL joins vehicles and operators to every trip and needs
    four filtered COUNT(DISTINCT) aggregates, which Catalyst expands into one
    copy of every trip row per distinct group.  Here trips are first reduced
    to one row per (route, day, vehicle); the vehicle/operator dimensions are
    joined to that much smaller set, distinct vehicles become plain counts,
    fuel cost a plain sum (one per vehicle-day, J03 inner semantics), and the
    capacity/age means trip-weighted sums over matched rows.  Only distinct
    operators still needs COUNT(DISTINCT) on a single column.
    """
    t = trips if trips is not None else S.stg_trips(E)
    rvd = _route_vehicle_day(t)
    v = S.stg_vehicles(E).select(
        "vehicle_id", "vehicle_type", F.col("capacity").alias("vehicle_capacity"),
        "fuel_type", "vehicle_age_years", "avg_fuel_cost_daily_php",
        F.col("operator_id").alias("v_operator_id"))
    o = S.stg_operators(E).select("operator_id", "is_compliant_puv")
    enriched = (rvd.join(v, "vehicle_id", "left")
                   .join(o, F.col("v_operator_id") == F.col("operator_id"), "left"))
    matched = F.col("vehicle_capacity").isNotNull()
    rd = enriched.groupBy("route_id", "trip_date").agg(
        F.bool_or("any_rain").alias("is_rainy_day"),
        F.sum("n_trips").alias("total_trips"),
        F.sum("s_pass").alias("total_passengers"),
        (F.sum("s_pass") / F.sum("c_pass")).alias("m_pass"),
        F.sum("s_rev").alias("total_revenue_php"),
        (F.sum("s_load") / F.sum("c_load")).alias("m_load"),
        (F.sum("s_travel") / F.sum("c_travel")).alias("m_travel"),
        (F.sum("s_delay") / F.sum("c_delay")).alias("m_delay"),
        F.sum("n_on_time").alias("on_time_trips"),
        F.sum("n_peak").alias("peak_trips"),
        F.sum("n_off_peak").alias("off_peak_trips"),
        F.sum("n_overcrowded").alias("overcrowded_trips"),
        F.count("vehicle_id").alias("distinct_vehicles"),
        C.count_if(F.col("vehicle_type") == "modernized_PUV").alias("modern_vehicles"),
        C.count_if(F.col("fuel_type") == "electric").alias("electric_vehicles"),
        (F.sum(F.col("vehicle_capacity") * F.col("n_rows"))
         / F.sum(F.when(matched, F.col("n_rows")))).alias("m_capacity"),
        (F.sum(F.col("vehicle_age_years") * F.col("n_rows"))
         / F.sum(F.when(F.col("vehicle_age_years").isNotNull(), F.col("n_rows")))).alias("m_age"),
        F.countDistinct("operator_id").alias("n_ops"),
        # same child as the plain distinct count, so both share one distinct
        # group in Catalyst's rewrite (2 expanded copies instead of 3)
        F.expr("count(DISTINCT operator_id) FILTER (WHERE is_compliant_puv)").alias("n_ops_ok"),
        F.sum("avg_fuel_cost_daily_php").alias("fuel"),
    )
    r = S.stg_routes(E).select("route_id", "route_name", "district_covered", "route_length_km",
                               "base_fare_php", "peak_frequency_min", "off_peak_frequency_min")
    rnd = lambda c, n: F.round(F.col(c), n).cast("double")
    return rd.join(r, "route_id").select(
        "route_id", "route_name", "district_covered", "route_length_km", "base_fare_php",
        "peak_frequency_min", "off_peak_frequency_min", "trip_date", "is_rainy_day",
        "total_trips", "total_passengers",
        rnd("m_pass", 2).alias("avg_passengers_per_trip"),
        F.col("total_revenue_php").cast("double").alias("total_revenue_php"),
        C.safe_ratio("total_revenue_php", "route_length_km", 2).alias("revenue_per_km_php"),
        rnd("m_load", 3).alias("avg_load_factor"),
        rnd("m_travel", 2).alias("avg_travel_time_min"),
        rnd("m_delay", 2).alias("avg_delay_min"),
        "on_time_trips",
        C.safe_ratio("on_time_trips", "total_trips", 3).alias("on_time_rate"),
        "peak_trips", "off_peak_trips", "overcrowded_trips", "distinct_vehicles",
        "modern_vehicles",
        rnd("m_capacity", 1).alias("avg_vehicle_capacity"),
        rnd("m_age", 1).alias("avg_fleet_age_years"),
        "electric_vehicles",
        C.safe_ratio("n_ops_ok", "n_ops", 3).alias("pct_compliant_operators"),
        F.coalesce(F.col("fuel"), F.lit(0)).cast("double").alias("total_fuel_cost_php"),
    )


def int_passenger_features(E: Entities, survey: DataFrame | None = None) -> DataFrame:
    """Encodings, tiered severity and route enrichment (J05 left join)."""
    s = S.stg_passenger_survey(E, survey)
    r = S.stg_routes(E).select(
        F.col("route_id").alias("primary_route_used"),
        F.col("route_name").alias("primary_route_name"),
        F.col("district_covered").alias("primary_route_district"),
        F.col("base_fare_php").alias("route_base_fare_php"), "route_length_km")
    return s.join(r, "primary_route_used", "left").select(
        "passenger_id", "survey_date", "origin_barangay", "origin_district",
        "destination_type", "trip_purpose", "primary_route_used", "income_bracket",
        "prefers_aircon", "trips_per_week", "avg_fare_paid_php", "transfers_required",
        "wait_time_min", "satisfaction_score",
        C.map_value("income_bracket", K.INCOME_CODE_SQL).alias("income_bracket_encoded"),
        C.map_value("destination_type", K.DESTINATION_CODE).alias("destination_type_encoded"),
        C.map_value("trip_purpose", K.PURPOSE_CODE).alias("trip_purpose_encoded"),
        F.col("prefers_aircon").cast("int").alias("prefers_aircon_int"),
        "travel_time_min", "primary_route_name", "primary_route_district",
        "route_base_fare_php", "route_length_km", "cluster_id", "cluster_label",
        "is_ab_test_eligible", "is_likely_underserved",
        C.tiered_severity().alias("underserved_severity_score"),
    )
