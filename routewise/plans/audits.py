"""Audit and page queries that complete the operator surface: derived-trip
audit (P21), time-of-day periods (P22), payload validation (V02-V09),
page filters and previews (P18, L07), histograms and crosstabs (A14, A17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import reshape as X
from ..operators import validation as V
from ..sources.standin import Entities
from . import staging as S


def trip_audit(E: Entities) -> DataFrame:
    """The generator's derivation rules as audit expressions; one row per
    rule with the number of trips that break it.  Fare rule: base fare +
    1.50 per km beyond 4 km; revenue = riders x fare."""
    t = S.stg_trips(E)
    r = S.stg_routes(E).select("route_id", "base_fare_php", "route_length_km")
    j = t.join(r, "route_id")
    fare = (F.col("base_fare_php").cast("decimal(10,2)")
            + F.lit(K.FARE_PER_KM).cast("decimal(4,2)")
            * F.greatest(F.lit(0), F.col("route_length_km") - K.FARE_BASE_KM).cast("decimal(10,2)"))
    rules = [
        ("travel_equals_scheduled_plus_delay",
         F.col("travel_time_min") == F.col("scheduled_time_min") + F.col("delay_min")),
        ("on_time_iff_delay_le_5", F.col("is_on_time") == (F.col("delay_min") <= K.ON_TIME_MAX_DELAY_MIN)),
        ("revenue_equals_riders_times_fare", F.col("revenue_php") == F.col("passengers_boarded") * fare),
        ("load_factor_within_range", F.col("load_factor").between(0, 1.5)),
    ]
    return V.rule_failures(j, rules)


def timed_trips(E: Entities) -> DataFrame:
    """Trips with times of day in seconds, by rules on the keys: departures at any second,
    arrivals by travel time past midnight if need be, a minute late on every 997th order."""
    day = 24 * 3600
    order, line = F.floor(F.col("trip_id") / 10), F.col("trip_id") % 10
    dep = (order * 7919 + line * 61) % day
    late = F.when(order % 997 == 0, 60).otherwise(0)
    return S.stg_trips(E).withColumn("departure_s", dep).withColumn("arrival_s", (F.col("departure_s") + F.col("travel_time_min") * 60 + late) % day)


def trip_time_audit(E: Entities) -> DataFrame:
    """Arrival is departure plus travel time, on a clock that wraps at midnight with
    the seconds kept; a trip's fare from its revenue is its route's, where the base fare of
    some routes overrides the common one; trips past midnight arrive earlier than they left."""
    base = C.map_value("route_id", K.ROUTE_BASE_FARE)
    r = S.stg_routes(E).select("route_id", "route_length_km")
    fare = F.coalesce(base, F.lit(K.BASE_FARE)).cast("decimal(10,2)") + F.lit(K.FARE_PER_KM).cast("decimal(4,2)") * F.greatest(F.lit(0), F.col("route_length_km") - K.FARE_BASE_KM).cast("decimal(10,2)")
    wraps = F.col("departure_s") + F.col("travel_time_min") * 60 >= 24 * 3600
    rules = [
        ("arrival_is_departure_plus_travel", F.col("arrival_s") == (F.col("departure_s") + F.col("travel_time_min") * 60) % (24 * 3600)),
        ("seconds_are_kept", F.col("arrival_s") % 60 == F.col("departure_s") % 60),
        ("earlier_only_past_midnight", (F.col("arrival_s") < F.col("departure_s")) == wraps),
        ("revenue_covers_the_route_fare", F.col("revenue_php") >= F.col("passengers_boarded") * fare),
    ]
    return V.rule_failures(timed_trips(E).join(r, "route_id"), rules)


def events_by_period(E: Entities) -> DataFrame:
    """Experiment events bucketed by time-of-day period."""
    e = E.t("events")
    return e.groupBy(C.period_of_hour(F.hour("ts")).alias("time_period"), "event_type").agg(
        F.count(F.lit(1)).alias("events"))


def survey_validation(E: Entities) -> DataFrame:
    """V02-V04, V08, V09 on survey payloads: declared fields only, defaults
    filled, then per-rule failures (length limits included)."""
    s = S.stg_passenger_survey(E)
    fields = ["passenger_id", "origin_barangay", "origin_district", "destination_type",
              "trip_purpose", "trips_per_week", "avg_fare_paid_php", "transfers_required",
              "wait_time_min", "travel_time_min", "satisfaction_score", "income_bracket",
              "prefers_aircon"]
    p = V.with_defaults(V.project_schema(s, fields), {"prefers_aircon": False})
    rules = V.survey_rules() + [
        ("origin_district_length", F.char_length("origin_district").between(2, 50)),
        ("origin_barangay_length", F.char_length("origin_barangay").between(2, 100)),
    ]
    return V.rule_failures(p, rules)


def ab_validation(E: Entities) -> DataFrame:
    """V03/V04/V07 on experiment payloads."""
    return V.rule_failures(S.stg_ab_experiment(E), V.ab_rules())


def ab_results_page(ab: DataFrame, weeks=(1, 8), groups=None, limit: int = 500) -> DataFrame:
    """Week range + group filter, first ``limit`` rows in export order."""
    f = ab.filter(F.col("test_week").between(*weeks) & C.optional_isin("group", groups))
    return f.orderBy("passenger_id", "test_week", "experiment_record_id").limit(limit)


def route_preview(summary: DataFrame, limit: int = 500) -> DataFrame:
    """Newest rows first, preview limit."""
    return summary.orderBy(F.desc("trip_date"), "route_id").limit(limit)


def score_histogram(ab: DataFrame) -> DataFrame:
    """Satisfaction score in 5 unit bins by group."""
    b = F.width_bucket(F.col("satisfaction_score"), F.lit(0.5), F.lit(5.5), F.lit(5))
    return X.histogram(ab, ["group"], b, "score_bin")


def transfer_histogram(ab: DataFrame) -> DataFrame:
    """Transfers needed (discrete values) by group."""
    return X.histogram(ab, ["group"], "transfers_needed", "transfers")


def reuse_crosstab(ab: DataFrame) -> DataFrame:
    """Would-use-again x group counts."""
    return X.crosstab(ab.withColumn("reuse", F.col("would_use_again").cast("int")), "reuse", "group",
                      K.AB_GROUPS)
