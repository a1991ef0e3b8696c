"""Analyses M08-M09 over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.standin import Entities
from . import marts as M


def _avg_dec(c: str, scale: int, out_scale: int) -> F.Column:
    """Mean of an already-rounded column.  The inputs carry ``scale`` decimals
    (numeric in the original), so average them as exact decimals."""
    return F.round(F.avg(F.col(c).cast(f"decimal(18,{scale})")), out_scale).cast("double")


def route_efficiency(E: Entities, summary: DataFrame | None = None) -> DataFrame:
    """M08 (A09, L02): year leaderboard per route."""
    s = summary if summary is not None else M.mart_route_summary(E)
    rainy = F.col("is_rainy_day")

    def avg_dec_if(c, cond, scale, out):
        return F.round(F.avg(F.when(cond, F.col(c).cast(f"decimal(18,{scale})"))), out).cast("double")

    out = s.groupBy("route_id", "route_name", "district_covered").agg(
        F.sum("total_trips").alias("annual_trips"),
        F.sum("total_passengers").alias("annual_passengers"),
        F.round(F.sum(F.col("total_revenue_php").cast("decimal(18,2)")), 2).cast("double")
         .alias("annual_revenue_php"),
        _avg_dec("revenue_per_km_php", 2, 2).alias("avg_revenue_per_km"),
        _avg_dec("avg_load_factor", 3, 3).alias("avg_load_factor"),
        _avg_dec("avg_delay_min", 2, 2).alias("avg_delay_min"),
        _avg_dec("on_time_rate", 3, 3).alias("avg_on_time_rate"),
        F.round(F.sum(F.when(F.col("meets_ltfrb_target"), 1).otherwise(0)) / F.count(F.lit(1)), 3)
         .alias("pct_days_meeting_ltfrb"),
        avg_dec_if("avg_delay_min", rainy, 2, 2).alias("avg_delay_rainy_days"),
        avg_dec_if("avg_delay_min", ~rainy, 2, 2).alias("avg_delay_dry_days"),
        C.round_mean("distinct_vehicles", 1).alias("avg_daily_vehicles"),
        _avg_dec("avg_fleet_age_years", 1, 1).alias("avg_fleet_age"),
        _avg_dec("pct_compliant_operators", 3, 3).alias("avg_operator_compliance"),
    )
    return out.orderBy(F.desc_nulls_last("avg_on_time_rate"),
                       F.desc_nulls_last("avg_revenue_per_km"), "route_id")


def cluster_profile(E: Entities, clusters: DataFrame | None = None) -> DataFrame:
    """M09 (A10, W01): per-cluster profile and share of all passengers.  The
    share window runs over the already-grouped rows (one per cluster), so the
    single-partition window sees only K rows."""
    m = clusters if clusters is not None else M.mart_commuter_clusters(E)
    g = m.groupBy("cluster_id", "cluster_label").agg(
        F.count("passenger_id").alias("passenger_count"),
        C.round_mean("trips_per_week", 2).alias("avg_trips_per_week"),
        C.round_mean("avg_fare_paid_php", 2).alias("avg_fare_paid_php"),
        C.round_mean("transfers_required", 2).alias("avg_transfers"),
        C.round_mean("wait_time_min", 1).alias("avg_wait_min"),
        C.round_mean("travel_time_min", 1).alias("avg_travel_min"),
        C.round_mean("satisfaction_score", 2).alias("avg_satisfaction"),
        F.round(C.count_if((F.col("income_bracket") == "low") & F.col("passenger_id").isNotNull())
                / F.count("passenger_id"), 3).alias("pct_low_income"),
        F.round(C.count_if(F.col("prefers_aircon") & F.col("passenger_id").isNotNull())
                / F.count("passenger_id"), 3).alias("pct_prefers_aircon"),
        C.count_if(F.col("is_ab_test_eligible") & F.col("passenger_id").isNotNull())
         .alias("ab_eligible_count"),
        F.round(F.avg(F.col("underserved_severity_score").cast("decimal(18,4)")), 4)
         .cast("double").alias("avg_severity_score"),
    )
    total = F.sum("passenger_count").over(Window.partitionBy())
    return (g.withColumn("pct_of_total", F.round(F.col("passenger_count") / total, 3))
             .orderBy("cluster_id"))
