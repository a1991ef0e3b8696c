"""Staging views (S06 lazy views): 1:1 rows plus derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.standin import Entities


def stg_routes(E: Entities) -> DataFrame:
    return E.routes()


def stg_operators(E: Entities) -> DataFrame:
    return E.operators()


def stg_stops(E: Entities) -> DataFrame:
    return E.stops()


def stg_vehicles(E: Entities) -> DataFrame:
    """Age relative to a parameterised year (not today)."""
    return E.vehicles().withColumn(
        "vehicle_age_years", F.lit(E.as_of_year) - F.col("year_manufactured"))


def stg_trips(E: Entities, raw: DataFrame | None = None) -> DataFrame:
    """Peak / weekend / overcrowded flags (NULL -> false).  raw: the loaded
    trips, where the view stands on an ingest instead of the entity."""
    return (E.trips() if raw is None else E.trips_of(raw)).withColumns({
        "is_peak": C.is_peak("time_period"),
        "is_weekend": C.is_weekend("day_of_week"),
        "is_overcrowded": C.is_overcrowded("load_factor"),
    })


def stg_passenger_survey(E: Entities, survey: DataFrame | None = None) -> DataFrame:
    """Eligibility (cluster 3) and the underserved proxy rule.
    ``survey`` lets the labelled version (after segmentation, J09) flow in."""
    s = survey if survey is not None else E.survey()
    return s.withColumns({
        "is_ab_test_eligible": C.flag(F.col("cluster_id") == 3),
        "is_likely_underserved": C.flag((F.col("transfers_required") >= 2)
                                        & (F.col("wait_time_min") >= 25)
                                        & (F.col("satisfaction_score") <= 2)),
    })


def stg_ab_experiment(E: Entities) -> DataFrame:
    """Phase from week (NULL week -> main), treatment flag (NULL stays
    NULL) and the typed-NULL statistic columns the mart carries."""
    return E.ab_experiment().withColumns({
        "experiment_phase": F.when(F.col("test_week") <= 4, "ramp_up").otherwise("main"),
        "is_treatment": F.col("group") == "treatment",
        "p_value": F.lit(None).cast("double"),
        "is_significant": F.lit(None).cast("boolean"),
        "effect_size": F.lit(None).cast("double"),
        "confidence_interval_low": F.lit(None).cast("double"),
        "confidence_interval_high": F.lit(None).cast("double"),
    })
