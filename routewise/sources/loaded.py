"""The entities as loaded: views on the raw tables that an ingest wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import fixed_dim
from .standin import AS_OF_YEAR, Entities


def number(code: str, prefix: str) -> Column:
    """The id in a padded code."""
    return F.substring(code, len(prefix) + 1, 20).cast("long").alias(code)


class LoadedEntities(Entities):
    """Entities over ``root/raw/<entity>``: codes back to ids, money to decimals.  Labels of
    passengers are NULL until a segmentation writes them."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, as_of_year: int = AS_OF_YEAR):
        super().__init__(spark, sf_dir, as_of_year)
        self.root = root

    def raw(self, entity: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/raw/{entity}")

    def routes(self) -> DataFrame:
        # as many as there are nations at most
        return fixed_dim(self.raw("routes").select(
            number("route_id", "R"), "route_name", "origin", "destination", "district_covered", F.col("route_length_km").cast("int").alias("route_length_km"), "num_stops",
            F.col("base_fare_php").cast("int").alias("base_fare_php"), "peak_frequency_min", "off_peak_frequency_min", "is_active"))

    def operators(self) -> DataFrame:
        return self.raw("operators").select(number("operator_id", "OPR-"), "operator_name", "franchise_type", "num_units", "is_compliant_puv")

    def vehicles(self) -> DataFrame:
        return self.raw("vehicles").select(
            number("vehicle_id", "VHC-"), "plate_number", "vehicle_type", "capacity", "fuel_type", "year_manufactured", number("route_assigned", "R"), number("operator_id", "OPR-"),
            F.col("avg_fuel_cost_daily_php").cast("decimal(12,2)").alias("avg_fuel_cost_daily_php"), "is_active")

    def stops(self) -> DataFrame:
        route = number("route_id", "R")
        return self.raw("stops").select(
            number("stop_id", "S"), "stop_name", "barangay", "district", "stop_type", "has_shelter", "avg_daily_boardings", route,
            F.col("latitude").cast("decimal(9,6)").alias("latitude"), F.col("longitude").cast("decimal(9,6)").alias("longitude"),
            F.concat_ws(",", route.cast("string"), ((route + 1) % 25).cast("string")).alias("routes_served"))

    def trips(self) -> DataFrame:
        return self.trips_of(self.raw("trips"))

    def survey(self) -> DataFrame:
        return self.raw("passengers").select(
            number("passenger_id", "PAX-"), "survey_date", "origin_barangay", "origin_district", "destination_type", "trip_purpose", number("primary_route_used", "R"), "trips_per_week",
            F.col("avg_fare_paid_php").cast("int").alias("avg_fare_paid_php"), "transfers_required", "wait_time_min", "travel_time_min", "satisfaction_score", "income_bracket", "prefers_aircon",
            F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("string").alias("cluster_label"))

    def ab_experiment(self) -> DataFrame:
        return self.raw("experiment").select(
            number("experiment_record_id", "ABR-"), "experiment_id", number("passenger_id", "PAX-"), "cluster_id", "group", "route_variant", "test_week", "simulated_travel_time_min",
            F.col("simulated_fare_php").cast("decimal(6,2)").alias("simulated_fare_php"), "transfers_needed", "satisfaction_score", "would_use_again")
