"""Deliveries of all seven landing entities, derived from the given tables, with the
faults that real deliveries have: missing and unreadable values, NaN, values out of range,
repeated keys and plates, and children of rows that will not load.  Which rows are faulty
follows from their keys, so faults grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import landing as L
from .standin import Entities


def _typed(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def routes(E: Entities) -> DataFrame:
    df = E._nation_region.withColumn("k", F.col("n_nationkey").cast("int")).select(
        C.zero_pad("R", F.col("k"), 2).alias("route_id"), F.col("n_name").alias("route_name"), F.concat(F.lit(" "), "n_name").alias("origin"),
        F.col("r_name").alias("destination"), F.col("r_name").alias("district_covered"),
        F.expr("case when k % 13 = 12 then double('NaN') else k + 5 end as route_length_km"), F.expr("k % 7 + 3 as num_stops"),
        F.expr("case when k % 5 = 4 then null else 13 + k % 5 end as base_fare_php"), F.expr("k % 4 + 5 as peak_frequency_min"),
        F.expr("case when k % 11 = 10 then 1 else k % 6 + 10 end as off_peak_frequency_min"),
        F.expr("case when k % 6 = 5 then null when k % 9 = 0 then 'False' else ' true' end as is_active"),
        F.expr("k % 4 as _chunk"), F.expr("date'2024-01-01' as _date"))
    return _typed(df, route_length_km="double", base_fare_php="double")


def _customers(E: Entities) -> DataFrame:
    c, n = E.t("customer"), E._nation_region
    return c.join(n, c.c_nationkey == n.n_nationkey).withColumn("k", F.col("c_custkey"))


def operators(E: Entities) -> DataFrame:
    """Every tenth operator is delivered a second time, a week later and under another name."""
    first = _customers(E).select(
        "k", C.zero_pad("OPR-", F.col("k"), 3).alias("operator_id"), F.col("c_name").alias("operator_name"), C.zero_pad("0917-", F.col("k"), 7).alias("contact_number"),
        F.expr("case when k % 67 = 0 then 'syndicate' when k % 3 = 0 then 'individual' when k % 3 = 1 then ' cooperative' else 'corporation' end as franchise_type"),
        F.expr("case when k % 59 = 0 then null when k % 53 = 0 then 0 else cast(k % 20 + 1 as int) end as num_units"), F.col("r_name").alias("base_district"),
        F.expr("case when k % 61 = 0 then 'maybe' when k % 4 = 0 then null when k % 4 = 1 then 'TRUE' else 'false' end as is_compliant_puv"),
        F.expr("cast(k % 4 as int) as _chunk"), F.expr("date'2024-01-01' as _date"))
    again = first.where("k % 10 = 0").withColumns({"operator_name": F.lit("again"), "_date": F.expr("date'2024-01-08'")})
    return first.unionByName(again).drop("k")


def stops(E: Entities) -> DataFrame:
    return _customers(E).select(
        C.zero_pad("S", F.col("k"), 3).alias("stop_id"), F.col("c_name").alias("stop_name"), F.col("n_name").alias("barangay"), F.col("r_name").alias("district"),
        F.expr("case when k % 71 = 0 then 9.9 else 6.8 + (k % 700) / 1000 end").cast("double").alias("latitude"), F.expr("125 + (k % 997) / 1000").cast("double").alias("longitude"),
        F.expr("case k % 6 when 0 then ' terminal' when 1 then 'market ' when 2 then 'school' when 3 then 'hospital' when 4 then 'mall' else 'residential' end as stop_type"),
        F.expr("case when k % 3 = 0 then null when k % 3 = 1 then 'true' else 'False' end as has_shelter"), F.expr("cast((k * 37) % 500 as int) as avg_daily_boardings"),
        C.zero_pad("R", F.col("c_nationkey"), 2).alias("route_id"), F.expr("cast(k % 4 as int) as _chunk"), F.expr("date'2024-01-01' as _date"))


def vehicles(E: Entities) -> DataFrame:
    """Two of each forty vehicles share a plate."""
    s = E.t("supplier").withColumn("k", F.col("s_suppkey"))
    return s.select(
        C.zero_pad("VHC-", F.col("k"), 3).alias("vehicle_id"), C.zero_pad("DBX-", F.expr("case when k % 40 = 1 then k - 1 else k end"), 4).alias("plate_number"),
        F.expr("case when k % 4 = 0 then 'modernized_PUV' else 'traditional' end as vehicle_type"), F.expr("case when k % 43 = 7 then null when k % 4 = 0 then 23 else 16 end as capacity"),
        F.expr("case when k % 8 = 0 then 'electric' when k % 8 = 4 then 'euro4_diesel' else 'diesel' end as fuel_type"), F.expr("cast(2000 + k % 25 as int) as year_manufactured"),
        C.zero_pad("R", F.col("s_nationkey"), 2).alias("route_assigned"), C.zero_pad("OPR-", F.expr("k div 3"), 3).alias("operator_id"),
        F.expr("case when k % 47 = 5 then double('NaN') else abs(s_acctbal) end as avg_fuel_cost_daily_php"),
        F.expr("case when k % 5 = 0 then null when k % 10 = 1 then 'false' else 'TRUE' end as is_active"), F.expr("cast(k % 4 as int) as _chunk"), F.expr("date'2024-01-01' as _date"))


def trips(E: Entities) -> DataFrame:
    """Every 1009th order has no revenue; flags land as text."""
    df = L.landing_trips(E)
    order = F.substring("trip_id", 5, 20).cast("long")
    return df.withColumns({"revenue_php": F.when(F.floor(order / 10) % 1009 == 0, F.lit(float("nan"))).otherwise(F.col("revenue_php")),
                           "is_on_time": F.col("is_on_time").cast("string"), "is_rainy_day": F.col("is_rainy_day").cast("string")})


def passengers(E: Entities) -> DataFrame:
    df = L.landing_passengers(E)
    k = F.substring("passenger_id", 5, 20).cast("long")
    return df.withColumns({"prefers_aircon": F.when(k % 7 == 0, F.lit(None)).when(k % 73 == 1, F.lit("unknown")).otherwise(F.col("prefers_aircon").cast("string")),
                           "survey_date": F.when(k % 79 == 2, F.lit("2024-13-01")).otherwise(F.col("survey_date"))})


def experiment(E: Entities) -> DataFrame:
    df = L.landing_experiment(E)
    k = F.substring("experiment_record_id", 5, 20).cast("long")
    return df.withColumns({"experiment_id": F.when(k % 2 == 0, F.col("experiment_id")), "cluster_id": F.when(k % 113 == 0, 4).otherwise(3),
                           "simulated_fare_php": (F.lit(26) + k % 7).cast("double"), "would_use_again": F.col("would_use_again").cast("string")})


DELIVERIES = {"routes": routes, "operators": operators, "stops": stops, "vehicles": vehicles, "trips": trips, "passengers": passengers, "experiment": experiment}


def landed(E: Entities, names=None) -> dict[str, DataFrame]:
    return {n: f(E) for n, f in DELIVERIES.items() if names is None or n in names}
