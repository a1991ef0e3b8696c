"""The concrete test suites: declarative column tests on staging and marts
(Q01-Q07), business-rule tests (Q08-Q15), coverage (Q18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.quality import DataTest, row_counts, run_tests
from ..sources.standin import Entities
from . import intermediate as I
from . import marts as M
from . import staging as S

T = DataTest

# Columns that must not be NULL, by model.
NOT_NULL = {
    "stg_routes": "route_id route_name origin destination district_covered route_length_km num_stops base_fare_php "
                  "peak_frequency_min off_peak_frequency_min is_active",
    "stg_operators": "operator_id operator_name franchise_type num_units is_compliant_puv",
    "stg_stops": "stop_id stop_name barangay district latitude longitude stop_type has_shelter route_id",
    "stg_vehicles": "vehicle_id plate_number vehicle_type capacity fuel_type year_manufactured route_assigned operator_id is_active",
    "stg_trips": "trip_id route_id vehicle_id trip_date time_period day_of_week passengers_boarded revenue_php is_on_time "
                 "is_rainy_day load_factor",
    "stg_passenger_survey": "passenger_id origin_district destination_type trip_purpose primary_route_used transfers_required "
                            "satisfaction_score income_bracket",
    "stg_ab_experiment": "experiment_record_id passenger_id cluster_id group route_variant test_week satisfaction_score would_use_again",
    "int_daily_ridership": "route_id trip_date total_trips total_passengers",
    "int_route_performance": "route_id trip_date",
    "int_passenger_features": "passenger_id",
    "mart_route_summary": "route_id trip_date route_name district_covered total_trips total_passengers avg_passengers_per_trip "
                          "total_revenue_php revenue_per_km_php avg_load_factor avg_travel_time_min avg_delay_min on_time_trips "
                          "on_time_rate meets_ltfrb_target peak_trips off_peak_trips is_rainy_day",
    "mart_district_ridership": "district trip_date total_boardings total_trips_serving active_routes pct_with_shelter "
                               "peak_boardings weekend_boardings is_rainy_day",
    "mart_commuter_clusters": "passenger_id cluster_id cluster_label satisfaction_score is_ab_test_eligible",
    "mart_ab_test_results": "experiment_record_id passenger_id group route_variant test_week satisfaction_score",
}
VARIANTS = ("A_current", "B_express")
LABELS = tuple(K.CLUSTER_LABELS.values())

#: The other tests of each model: unique keys first, then values, ranges and parents.
OTHER: dict[str, list[DataTest]] = {
    "stg_routes": [
        T("unique", "route_id"), T("accepted_range", "route_length_km", lo=0, hi=200),
        T("expression", "", predicate="off_peak_frequency_min < peak_frequency_min", name="headway_order"),
    ],
    "stg_operators": [T("unique", "operator_id"), T("accepted_values", "franchise_type", values=tuple(K.FRANCHISE_TYPES))],
    "stg_stops": [
        T("unique", "stop_id"), T("accepted_values", "stop_type", values=tuple(K.STOP_TYPES)),
        T("accepted_range", "latitude", lo=6.8, hi=7.5),
        T("relationships", "route_id", parent="stg_routes", parent_col="route_id"),
    ],
    "stg_vehicles": [
        T("unique", "vehicle_id"), T("unique", "plate_number"),
        T("accepted_values", "vehicle_type", values=tuple(K.VEHICLE_TYPES)),
        T("accepted_values", "fuel_type", values=tuple(K.FUEL_TYPES)), T("accepted_range", "capacity", lo=10, hi=30),
        T("relationships", "route_assigned", parent="stg_routes", parent_col="route_id"),
        T("relationships", "operator_id", parent="stg_operators", parent_col="operator_id"),
    ],
    "stg_trips": [
        T("unique", "trip_id"), T("accepted_values", "time_period", values=tuple(K.TIME_PERIODS)),
        T("accepted_values", "day_of_week", values=tuple(K.WEEKDAYS)),
        T("accepted_range", "load_factor", lo=0, hi=1.5), T("accepted_range", "passengers_boarded", lo=1, hi=50),
        T("accepted_range", "delay_min", lo=0, where="is_on_time"),
        T("relationships", "route_id", parent="stg_routes", parent_col="route_id"),
        T("relationships", "vehicle_id", parent="stg_vehicles", parent_col="vehicle_id"),
    ],
    "stg_passenger_survey": [
        T("unique", "passenger_id"), T("accepted_values", "destination_type", values=tuple(K.DESTINATION_TYPES)),
        T("accepted_values", "trip_purpose", values=tuple(K.TRIP_PURPOSES)),
        T("accepted_values", "income_bracket", values=tuple(K.INCOME_BRACKETS)),
        T("accepted_range", "transfers_required", lo=0, hi=3), T("accepted_range", "satisfaction_score", lo=1, hi=5),
        T("accepted_range", "cluster_id", lo=0, hi=4), T("accepted_range", "trips_per_week", lo=0, hi=14),
        T("relationships", "primary_route_used", parent="stg_routes", parent_col="route_id"),
    ],
    "stg_ab_experiment": [
        T("unique", "experiment_record_id"), T("accepted_values", "cluster_id", values=(3,)),
        T("accepted_values", "group", values=tuple(K.AB_GROUPS)), T("accepted_values", "route_variant", values=VARIANTS),
        T("accepted_range", "test_week", lo=1, hi=8), T("accepted_range", "satisfaction_score", lo=1, hi=5),
        T("relationships", "passenger_id", parent="stg_passenger_survey", parent_col="passenger_id"),
    ],
    "int_daily_ridership": [],
    "int_route_performance": [],
    "int_passenger_features": [],
    "mart_route_summary": [
        T("unique_combination", "", columns=("route_id", "trip_date")), T("accepted_range", "avg_load_factor", lo=0, hi=1.5),
        T("accepted_range", "on_time_rate", lo=0, hi=1), T("accepted_range", "peak_trip_ratio", lo=0, hi=1),
        T("positive", "total_trips", name="assert_column_is_positive"),
    ],
    "mart_district_ridership": [
        T("unique_combination", "", columns=("district", "trip_date")), T("accepted_range", "pct_with_shelter", lo=0, hi=1),
        T("accepted_range", "avg_satisfaction", lo=1, hi=5),
    ],
    "mart_commuter_clusters": [
        T("unique", "passenger_id"), T("accepted_values", "cluster_id", values=(0, 1, 2, 3, 4)),
        T("accepted_values", "cluster_label", values=LABELS), T("accepted_range", "satisfaction_score", lo=1, hi=5),
        T("accepted_range", "underserved_severity_score", lo=0, where="cluster_id = 3"),
    ],
    "mart_ab_test_results": [
        T("unique", "experiment_record_id"), T("accepted_values", "group", values=tuple(K.AB_GROUPS)),
        T("accepted_values", "route_variant", values=VARIANTS), T("accepted_values", "experiment_phase", values=("ramp_up", "main")),
        T("accepted_range", "test_week", lo=1, hi=8), T("accepted_range", "satisfaction_score", lo=1, hi=5),
        T("accepted_range", "p_value", lo=0, hi=1),
    ],
}


def _suite(layer: str) -> dict[str, list[DataTest]]:
    return {m: [T("not_null", c) for c in NOT_NULL[m].split()] + tests for m, tests in OTHER.items() if m.startswith(layer)}


STAGING_TESTS, INTERMEDIATE_TESTS, MART_TESTS = _suite("stg_"), _suite("int_"), _suite("mart_")

# Q08-Q15: business-rule tests, each a violation predicate on one model.
BUSINESS_RULES: list[tuple[str, str, str]] = [
    ("stg_trips", "on_time_consistency",
     "(is_on_time and delay_min > 5) or (not is_on_time and delay_min <= 5)"),
    ("stg_trips", "load_factor_range", "load_factor < 0 or load_factor > 1.5"),
    ("stg_ab_experiment", "group_variant_alignment",
     "(`group` = 'control' and route_variant <> 'A_current') or "
     "(`group` = 'treatment' and route_variant <> 'B_express')"),
    ("stg_ab_experiment", "only_cluster_3", "cluster_id <> 3"),
    ("mart_route_summary", "on_time_count_lte_total", "on_time_trips > total_trips"),
    ("mart_district_ridership", "peak_lte_total",
     "peak_boardings > total_boardings or weekend_boardings > total_boardings"),
    ("mart_commuter_clusters", "ab_eligibility",
     "(cluster_id = 3 and not is_ab_test_eligible) or (cluster_id <> 3 and is_ab_test_eligible)"),
    ("mart_ab_test_results", "ci_order",
     "confidence_interval_low is not null and confidence_interval_high is not null "
     "and confidence_interval_low > confidence_interval_high"),
]


def staging_models(E: Entities) -> dict[str, DataFrame]:
    return {"stg_routes": S.stg_routes(E), "stg_operators": S.stg_operators(E),
            "stg_stops": S.stg_stops(E), "stg_vehicles": S.stg_vehicles(E),
            "stg_trips": S.stg_trips(E), "stg_passenger_survey": S.stg_passenger_survey(E),
            "stg_ab_experiment": S.stg_ab_experiment(E)}


def mart_models(E: Entities) -> dict[str, DataFrame]:
    return {"mart_route_summary": M.mart_route_summary(E),
            "mart_district_ridership": M.mart_district_ridership(E),
            "mart_commuter_clusters": M.mart_commuter_clusters(E),
            "mart_ab_test_results": M.mart_ab_test_results(E)}


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def staging_tests(E: Entities) -> DataFrame:
    models = staging_models(E)
    return _union([run_tests(m, models[m], ts, models) for m, ts in STAGING_TESTS.items()])


def intermediate_tests(E: Entities, models: dict[str, DataFrame] | None = None) -> DataFrame:
    """models: written tables to test instead of recomputing all."""
    models = models or {"int_daily_ridership": I.int_daily_ridership(E), "int_route_performance": I.int_route_performance(E),
                        "int_passenger_features": I.int_passenger_features(E)}
    return _union([run_tests(m, df, INTERMEDIATE_TESTS[m]) for m, df in models.items()])


def mart_tests(E: Entities, marts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Q01-Q07 on the marts; pass ``marts`` to test already-written tables
    instead of recomputing them."""
    models = marts or mart_models(E)
    return _union([run_tests(m, models[m], ts, models) for m, ts in MART_TESTS.items()])


def business_rules(E: Entities, marts: dict[str, DataFrame] | None = None) -> DataFrame:
    models = {**staging_models(E), **(marts or mart_models(E))}
    by_model: dict[str, list[DataTest]] = {}
    for m, name, pred in BUSINESS_RULES:
        by_model.setdefault(m, []).append(DataTest("expression", "", predicate=pred, name=name))
    return _union([run_tests(m, models[m], ts) for m, ts in by_model.items()])


def staging_row_counts(E: Entities) -> DataFrame:
    """C13."""
    return row_counts(staging_models(E))


def mart_row_counts(E: Entities) -> DataFrame:
    """Q17."""
    return row_counts(mart_models(E))


def route_coverage(E: Entities) -> DataFrame:
    """Q18: stops per route, including routes with no stop (0)."""
    st = S.stg_stops(E).groupBy("route_id").agg(F.count(F.lit(1)).alias("n_stops"))
    return (S.stg_routes(E).select("route_id", "route_name").join(st, "route_id", "left")
            .select("route_id", "route_name", F.coalesce("n_stops", F.lit(0)).alias("n_stops"),
                    F.col("n_stops").isNull().alias("has_no_stop")))


def survey_null_profile(E: Entities) -> DataFrame:
    """C08 over the features table (NULL route enrichment shows up here)."""
    from ..operators.quality import null_profile
    return null_profile(I.int_passenger_features(E))


# Q16: the stage gates.  A gate returns one row: name, the numbers it looks at, verdict.
def _gate(name: str, df: DataFrame, **values) -> DataFrame:
    ok = values.pop("ok")
    return df.agg(*[v.alias(k) for k, v in values.items()]).select(
        F.lit(name).alias("gate"), F.to_json(F.struct(*values)).alias("seen"), F.expr(ok).alias("passed"))


def not_empty(name: str, df: DataFrame) -> DataFrame:
    return _gate(name, df, rows=F.count(F.lit(1)), ok="rows > 0")


def clusters_agree(assigned: DataFrame, survey: DataFrame) -> DataFrame:
    """At least two clusters were assigned, and the survey holds as many."""
    ids = assigned.select(F.lit("a").alias("side"), "cluster_id").unionByName(survey.select(F.lit("s").alias("side"), "cluster_id"))
    count = lambda side: F.expr(f"count(distinct cluster_id) filter (where side = '{side}')")
    return _gate("cluster_assignments", ids, assigned=count("a"), written_back=count("s"), ok="assigned >= 2 and written_back = assigned")


def enough_tests(statistics: DataFrame) -> DataFrame:
    return _gate("ab_results", statistics, tests=F.count(F.lit(1)), ok="tests >= 3")


def outputs_present(name: str, inventory: DataFrame, required: list[str]) -> DataFrame:
    return _gate(name, inventory.where(F.col("name").isin(required)), present=F.sum(F.col("present").cast("int")), ok=f"present = {len(required)}")


def marts_counted(marts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each mart; passes if every count could be taken."""
    return _gate("mart_row_counts", row_counts(marts), marts=F.count("rows"), rows=F.sum("rows"), ok=f"marts = {len(marts)}")


def rows_observed(name: str, rows: dict[str, int], spark) -> DataFrame:
    """Every written table has rows, as counted while it was written."""
    return _gate(name, spark.createDataFrame(sorted(rows.items()), "name string, rows long"), tables=F.count("rows"), least=F.min("rows"), ok="least > 0")


def labels_in_mart(clusters: DataFrame) -> DataFrame:
    return _gate("cluster_labels", clusters, unlabelled=F.count_if(F.col("cluster_label").isNull()), ok="unlabelled = 0")


def ab_mart_contents(ab: DataFrame) -> DataFrame:
    return _gate("ab_mart", ab, rows=F.count(F.lit(1)), passengers=F.countDistinct("passenger_id"), ok="rows > 0")


def stage_gates(E: Entities) -> DataFrame:
    """The gates that need no written files, over the models."""
    m = mart_models(E)
    features = I.int_passenger_features(E)
    survey = S.stg_passenger_survey(E)
    return _union([not_empty("passenger_features", features), clusters_agree(m["mart_commuter_clusters"], survey), marts_counted(m),
                   labels_in_mart(m["mart_commuter_clusters"]), ab_mart_contents(m["mart_ab_test_results"])])
