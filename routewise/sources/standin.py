"""Transit entities derived from the driver's TPC-H-style tables.

The reference's entities (routes, vehicles, operators, trips, stops, survey,
experiment) are re-expressed as deterministic projections of the given tables,
so every model grows with the input.  Integer ids replace string codes.
The same definitions exist as DuckDB SQL in ``oracle/standin.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import ensure_checkpoint_dir, ship_package
from ..operators.dims import fixed_dim
from .tables import read_table

AS_OF_YEAR = 2025          # vehicle age reference year (parameter, P02)
EXPERIMENT_ID = "EXP-001"


class Entities:
    """Lazily built entity DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of_year: int = AS_OF_YEAR):
        self.spark, self.sf_dir, self.as_of_year = spark, sf_dir, as_of_year
        ensure_checkpoint_dir(spark)  # iterative operators cut lineage there
        ship_package(spark)

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- dimensions with a fixed domain -----------------------------------
    @cached_property
    def _nation_region(self) -> DataFrame:
        n = self.t("nation")
        r = self.t("region")
        return n.join(fixed_dim(r), n.n_regionkey == r.r_regionkey).select(
            "n_nationkey", "n_name", "r_name")

    def routes(self) -> DataFrame:
        k = F.col("n_nationkey")
        return fixed_dim(self._nation_region.select(
            k.alias("route_id"),
            F.col("n_name").alias("route_name"),
            F.col("n_name").alias("origin"),
            F.col("r_name").alias("destination"),
            F.col("r_name").alias("district_covered"),
            (k + 5).alias("route_length_km"),
            (k % 7 + 3).alias("num_stops"),
            (k % 5 + 13).alias("base_fare_php"),
            (k % 4 + 5).alias("peak_frequency_min"),
            (k % 6 + 10).alias("off_peak_frequency_min"),
            (k % 9 != 0).alias("is_active"),
        ))

    # -- dimensions that grow with the data --------------------------------
    @staticmethod
    def trips_of(raw: DataFrame) -> DataFrame:
        """The trips entity from loaded raw rows: codes back to ids, money and load to
        decimals."""
        number = lambda c, prefix: F.substring(c, len(prefix) + 1, 20).cast("long")
        return raw.select(
            number("trip_id", "TRP-").alias("trip_id"), number("route_id", "R").alias("route_id"),
            number("vehicle_id", "VHC-").alias("vehicle_id"), "trip_date", "time_period", "day_of_week", "passengers_boarded",
            F.col("revenue_php").cast("decimal(12,2)").alias("revenue_php"), "travel_time_min", "scheduled_time_min", "delay_min",
            "is_on_time", "is_rainy_day", F.col("load_factor").cast("decimal(4,3)").alias("load_factor"))

    def vehicles(self) -> DataFrame:
        s = self.t("supplier")
        k = F.col("s_suppkey")
        modern = (k % 4 == 0)
        return s.select(
            k.alias("vehicle_id"),
            F.col("s_name").alias("plate_number"),
            F.when(modern, "modernized_PUV").otherwise("traditional").alias("vehicle_type"),
            F.when(modern, 23).otherwise(16).alias("capacity"),
            F.when(k % 8 == 0, "electric").when(k % 8 == 4, "euro4_diesel")
             .otherwise("diesel").alias("fuel_type"),
            (F.lit(2000) + k % 25).alias("year_manufactured"),
            F.col("s_nationkey").alias("route_assigned"),
            F.expr("s_suppkey div 3").alias("operator_id"),   # ~3 vehicles per operator
            F.abs(F.col("s_acctbal")).cast("decimal(12,2)").alias("avg_fuel_cost_daily_php"),
            (k % 10 != 0).alias("is_active"),
        )

    def operators(self) -> DataFrame:
        """Every customer is a franchise holder (the dimension grows with the
        data); vehicles point at ``suppkey div 3``."""
        c = self.t("customer")
        return c.select(
            F.col("c_custkey").alias("operator_id"),
            F.col("c_name").alias("operator_name"),
            F.col("c_mktsegment").alias("franchise_type"),
            (F.col("c_custkey") % 20 + 1).alias("num_units"),
            (F.col("c_acctbal") > 0).alias("is_compliant_puv"),
        )

    @cached_property
    def _supplier_route(self) -> DataFrame:
        # supplier -> route key, 16 bytes a row; its size decides the join
        return self.t("supplier").select("s_suppkey", "s_nationkey")

    def trips(self) -> DataFrame:
        li = self.t("lineitem")
        s = self._supplier_route
        ln = F.col("l_linenumber")
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        period = (F.when(rf == "A", "AM_peak")
                  .when((rf == "N") & (ls == "O"), "PM_peak")
                  .when(rf == "N", "off_peak")
                  .otherwise("midday"))
        return li.join(s, li.l_suppkey == s.s_suppkey).select(
            (F.col("l_orderkey") * 10 + ln).alias("trip_id"),
            F.col("s_nationkey").alias("route_id"),
            F.col("l_suppkey").alias("vehicle_id"),
            F.to_date("l_shipdate").alias("trip_date"),
            period.alias("time_period"),
            C.weekday_name("l_shipdate").alias("day_of_week"),
            F.col("l_quantity").cast("int").alias("passengers_boarded"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("revenue_php"),
            (F.lit(30) + 2 * ln).alias("travel_time_min"),
            F.lit(30).alias("scheduled_time_min"),
            (2 * ln).alias("delay_min"),
            (2 * ln <= 5).alias("is_on_time"),
            (ls == "F").alias("is_rainy_day"),
            (F.col("l_quantity") * 0.03).cast("decimal(4,3)").alias("load_factor"),
        )

    def stops(self) -> DataFrame:
        c = self.t("customer")
        nr = fixed_dim(self._nation_region)
        k = F.col("c_custkey")
        stype = C.map_value(k % 6, {0: "terminal", 1: "market", 2: "school",
                                    3: "hospital", 4: "mall", 5: "residential"})
        return c.join(nr, c.c_nationkey == nr.n_nationkey).select(
            k.alias("stop_id"),
            F.col("c_name").alias("stop_name"),
            F.col("n_name").alias("barangay"),
            F.col("r_name").alias("district"),
            stype.alias("stop_type"),
            (F.col("c_acctbal") >= 0).alias("has_shelter"),
            ((k * 37) % 500).alias("avg_daily_boardings"),
            F.col("c_nationkey").alias("route_id"),
            F.expr("cast(6.8 + (c_custkey % 700) * 0.001 as decimal(9,6))").alias("latitude"),
            F.expr("cast(125 + (c_custkey % 997) * 0.001 as decimal(9,6))").alias("longitude"),
            F.concat_ws(",", F.col("c_nationkey").cast("string"),
                        ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("routes_served"),
        )

    def survey(self) -> DataFrame:
        c = self.t("customer")
        nr = fixed_dim(self._nation_region)
        # order counts per customer: partial aggregation before the shuffle
        o = (self.t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")))
        k = F.col("c_custkey")
        base = (c.join(nr, c.c_nationkey == nr.n_nationkey)
                 .join(o, c.c_custkey == o.o_custkey, "left"))
        cid = k % 5
        return base.select(
            k.alias("passenger_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int")).alias("survey_date"),
            F.col("n_name").alias("origin_barangay"),
            F.col("r_name").alias("origin_district"),
            C.map_value(k % 5, {0: "work", 1: "school", 2: "market", 3: "hospital", 4: "mall"})
             .alias("destination_type"),
            C.map_value(k % 3, {0: "daily_commute", 1: "occasional", 2: "weekend_only"})
             .alias("trip_purpose"),
            F.col("c_nationkey").alias("primary_route_used"),
            F.least(F.coalesce(F.col("n_orders"), F.lit(0)), F.lit(14)).alias("trips_per_week"),
            (F.lit(13) + k % 20).alias("avg_fare_paid_php"),
            (k % 4).alias("transfers_required"),
            (F.lit(5) + (k * 7) % 50).alias("wait_time_min"),
            (F.lit(15) + (k * 11) % 70).alias("travel_time_min"),
            (F.lit(1) + (k * 3) % 5).alias("satisfaction_score"),
            C.map_value(k % 3, {0: "low", 1: "middle", 2: "high"}).alias("income_bracket"),
            (k % 2 == 0).alias("prefers_aircon"),
            cid.alias("cluster_id"),
            C.cluster_label(cid).alias("cluster_label"),
        )

    def ab_experiment(self) -> DataFrame:
        e = self.t("events")
        treat = (F.col("user_id") % 2 != 0)
        return e.select(
            F.col("event_id").alias("experiment_record_id"),
            F.lit(EXPERIMENT_ID).alias("experiment_id"),
            F.col("user_id").alias("passenger_id"),
            F.lit(3).alias("cluster_id"),
            F.when(treat, "treatment").otherwise("control").alias("group"),
            F.when(treat, "B_express").otherwise("A_current").alias("route_variant"),
            (F.lit(1) + F.col("event_id") % 8).alias("test_week"),
            F.col("value").alias("simulated_travel_time_min"),
            (F.lit(26) + F.col("event_id") % 7).cast("decimal(6,2)").alias("simulated_fare_php"),
            (F.col("event_id") % 4).alias("transfers_needed"),
            (F.lit(1) + F.col("event_id") % 5).alias("satisfaction_score"),
            F.col("event_type").isin("purchase", "click").alias("would_use_again"),
        )
