"""Row validation (V01-V11): entity -> named rule expressions; rows are
split into valid and quarantined (with the names of the failed rules)
instead of rejecting a whole request.  A NULL rule result counts as failed
(a missing required field fails validation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def rule(name: str, valid: Column) -> tuple[str, Column]:
    return name, valid


c = F.col


# Codes are padded to a least width; ids past it are longer, not invalid.
def trip_rules() -> list[tuple[str, Column]]:
    return [
        rule("trip_id_pattern", c("trip_id").rlike(r"^TRP-\d{7,}$")),
        rule("route_id_pattern", c("route_id").rlike(r"^R\d{2,}$")),
        rule("vehicle_id_pattern", c("vehicle_id").rlike(r"^VHC-\d{3,}$")),
        rule("trip_date_present", c("trip_date").isNotNull()),
        rule("time_period_enum", c("time_period").isin(K.TIME_PERIODS)),
        rule("day_of_week_enum", c("day_of_week").isin(K.WEEKDAYS)),
        rule("passengers_range", c("passengers_boarded").between(1, 50)),
        rule("revenue_non_negative", c("revenue_php") >= 0),
        rule("travel_time_positive", c("travel_time_min") > 0),
        rule("scheduled_time_positive", c("scheduled_time_min") > 0),
        rule("delay_non_negative", c("delay_min") >= 0),
        rule("load_factor_range", c("load_factor").between(K.LOAD_FACTOR_RANGE[0], K.LOAD_FACTOR_RANGE[1])),
        rule("on_time_implies_small_delay", ~c("is_on_time") | (c("delay_min") <= K.ON_TIME_MAX_DELAY_MIN)),
    ]

def survey_rules() -> list[tuple[str, Column]]:
    return [
        rule("satisfaction_range", c("satisfaction_score").between(*K.SATISFACTION_RANGE)),
        rule("trips_per_week_range", c("trips_per_week").between(0, 14)),
        rule("transfers_range", c("transfers_required").between(0, 3)),
        rule("wait_non_negative", c("wait_time_min") >= 0),
        rule("travel_positive", c("travel_time_min") > 0),
        rule("income_enum", c("income_bracket").isin(K.INCOME_BRACKETS)),
        rule("destination_enum", c("destination_type").isin(K.DESTINATION_TYPES)),
        rule("purpose_enum", c("trip_purpose").isin(K.TRIP_PURPOSES)),
    ]

def ab_rules() -> list[tuple[str, Column]]:
    return [
        rule("group_enum", c("group").isin(K.AB_GROUPS)),
        rule("week_range", c("test_week").between(1, 8)),
        rule("score_range", c("satisfaction_score").between(1, 5)),
        rule("transfers_range", c("transfers_needed").between(0, 3)),
        rule("group_variant_alignment",
         ((c("group") == "control") & (c("route_variant") == "A_current"))
             | ((c("group") == "treatment") & (c("route_variant") == "B_express"))),
    ]


def failed_rules(rules) -> Column:
    """Array of the names of the rules a row fails (``array_compact`` drops
    the passes; no lambda, so it stays inside generated code)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(pred, F.lit(False)), F.lit(n))
                                     for n, pred in rules]))


def all_valid(rules) -> Column:
    """Row passes every rule (a NULL rule result fails)."""
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for _, p in rules], F.lit(True))


def split_valid(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows + ``failed_rules``).  The valid side is one
    conjunctive filter (codegen'd, pushed below later operators); the
    failed-rule names are only built for the rejected rows."""
    ok = all_valid(rules)
    valid = df.filter(ok)
    rejected = df.filter(~ok).withColumn("failed_rules", failed_rules(rules))
    return valid, rejected


def rule_failures(df: DataFrame, rules) -> DataFrame:
    """V10 summary: failures per rule in one aggregation pass."""
    agg = df.agg(*[F.count(F.when(~F.coalesce(p, F.lit(False)), 1)).alias(f"_r{i}")
                   for i, (_, p) in enumerate(rules)])
    recs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("failures"))
                     for i, (n, _) in enumerate(rules)])
    return agg.select(F.inline(recs))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill defaults for optional payload fields."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def project_schema(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only declared payload fields are landed."""
    return df.select(*fields)
