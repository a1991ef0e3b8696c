"""Oracle SQL for the quality suites: each declarative test compiled to a
DuckDB violation count (as a SQL test compiler would)."""

from .models import (AB_RESULTS, COMMUTER_CLUSTERS, DISTRICT_CTES, DAILY_CTES,
                     PASSENGER_FEATURES, ROUTE_CTES, ROUTE_SUMMARY)
from .standin import rratio, with_clause

ALL = with_clause(
    "routes", "operators", "stops", "stg_trips", "stg_vehicles", "stg_survey", "stg_ab",
    extra=[("stg_routes", "select * from routes"), ("stg_operators", "select * from operators"),
           ("stg_stops", "select * from stops"), ("stg_passenger_survey", "select * from stg_survey"),
           ("stg_ab_experiment", "select * from stg_ab"),
           *DAILY_CTES]
    + ROUTE_CTES + [("mart_route_summary", ROUTE_SUMMARY)] + DISTRICT_CTES
    + [("int_passenger_features", PASSENGER_FEATURES),
       ("mart_commuter_clusters", COMMUTER_CLUSTERS), ("mart_ab_test_results", AB_RESULTS)])


#: The declared tests, written here on their own.  One line a model:
#: nn = not null, u = unique, av = accepted values, ar = accepted range (with a condition
#: after ?), fk = relationship, uc = unique combination, pos = positive, ex = expression.
EXPECTED = """
stg_routes | nn route_id route_name origin destination district_covered route_length_km num_stops base_fare_php peak_frequency_min off_peak_frequency_min is_active | u route_id | ar route_length_km 0 200 | ex headway_order: off_peak_frequency_min < peak_frequency_min
stg_operators | nn operator_id operator_name franchise_type num_units is_compliant_puv | u operator_id | av franchise_type 'individual','cooperative','corporation'
stg_stops | nn stop_id stop_name barangay district latitude longitude stop_type has_shelter route_id | u stop_id | av stop_type 'terminal','market','school','hospital','mall','residential' | ar latitude 6.8 7.5 | fk route_id stg_routes route_id
stg_vehicles | nn vehicle_id plate_number vehicle_type capacity fuel_type year_manufactured route_assigned operator_id is_active | u vehicle_id | u plate_number | av vehicle_type 'traditional','modernized_PUV' | av fuel_type 'diesel','euro4_diesel','electric' | ar capacity 10 30 | fk route_assigned stg_routes route_id | fk operator_id stg_operators operator_id
stg_trips | nn trip_id route_id vehicle_id trip_date time_period day_of_week passengers_boarded revenue_php is_on_time is_rainy_day load_factor | u trip_id | av time_period 'AM_peak','midday','PM_peak','off_peak' | av day_of_week 'Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday' | ar load_factor 0 1.5 | ar passengers_boarded 1 50 | ar delay_min 0 - ? is_on_time | fk route_id stg_routes route_id | fk vehicle_id stg_vehicles vehicle_id
stg_passenger_survey | nn passenger_id origin_district destination_type trip_purpose primary_route_used transfers_required satisfaction_score income_bracket | u passenger_id | av destination_type 'work','school','market','hospital','mall' | av trip_purpose 'daily_commute','occasional','weekend_only' | av income_bracket 'low','middle','high' | ar transfers_required 0 3 | ar satisfaction_score 1 5 | ar cluster_id 0 4 | ar trips_per_week 0 14 | fk primary_route_used stg_routes route_id
stg_ab_experiment | nn experiment_record_id passenger_id cluster_id group route_variant test_week satisfaction_score would_use_again | u experiment_record_id | av cluster_id 3 | av group 'control','treatment' | av route_variant 'A_current','B_express' | ar test_week 1 8 | ar satisfaction_score 1 5 | fk passenger_id stg_passenger_survey passenger_id
int_daily_ridership | nn route_id trip_date total_trips total_passengers
int_route_performance | nn route_id trip_date
int_passenger_features | nn passenger_id
mart_route_summary | nn route_id trip_date route_name district_covered total_trips total_passengers avg_passengers_per_trip total_revenue_php revenue_per_km_php avg_load_factor avg_travel_time_min avg_delay_min on_time_trips on_time_rate meets_ltfrb_target peak_trips off_peak_trips is_rainy_day | uc route_id,trip_date | ar avg_load_factor 0 1.5 | ar on_time_rate 0 1 | ar peak_trip_ratio 0 1 | pos total_trips
mart_district_ridership | nn district trip_date total_boardings total_trips_serving active_routes pct_with_shelter peak_boardings weekend_boardings is_rainy_day | uc district,trip_date | ar pct_with_shelter 0 1 | ar avg_satisfaction 1 5
mart_commuter_clusters | nn passenger_id cluster_id cluster_label satisfaction_score is_ab_test_eligible | u passenger_id | av cluster_id 0,1,2,3,4 | av cluster_label 'Student Commuters','Market Workers','CBD Workers','Underserved Riders','Occasional Riders' | ar satisfaction_score 1 5 | ar underserved_severity_score 0 - ? cluster_id = 3
mart_ab_test_results | nn experiment_record_id passenger_id group route_variant test_week satisfaction_score | u experiment_record_id | av group 'control','treatment' | av route_variant 'A_current','B_express' | av experiment_phase 'ramp_up','main' | ar test_week 1 8 | ar satisfaction_score 1 5 | ar p_value 0 1
"""
RULES = """
stg_trips | ex on_time_consistency: is_on_time <> (delay_min <= 5) | ex load_factor_range: load_factor not between 0 and 1.5
stg_ab_experiment | ex group_variant_alignment: route_variant <> case "group" when 'control' then 'A_current' when 'treatment' then 'B_express' end | ex only_cluster_3: cluster_id <> 3
mart_route_summary | ex on_time_count_lte_total: on_time_trips > total_trips
mart_district_ridership | ex peak_lte_total: greatest(peak_boardings, weekend_boardings) > total_boardings
mart_commuter_clusters | ex ab_eligibility: is_ab_test_eligible <> (cluster_id = 3)
mart_ab_test_results | ex ci_order: confidence_interval_low > confidence_interval_high
"""


def _violations(model: str, spec: str):
    """(test, column, SQL that counts violations) of one spec."""
    kind, _, rest = spec.strip().partition(" ")
    if kind == "nn":
        for c in rest.split():
            yield "not_null", c, f'select count(*) from {model} where "{c}" is null'
        return
    if kind in ("u", "uc"):
        cols = ", ".join(f'"{c}"' for c in rest.split(","))
        some = f"where {cols} is not null" if kind == "u" else ""
        yield {"u": "unique", "uc": "unique_combination"}[kind], rest, f"select count(*) from (select {cols} from {model} {some} group by {cols} having count(*) > 1)"
    elif kind == "av":
        c, values = rest.split(" ", 1)
        yield "accepted_values", c, f'select count(*) from {model} where "{c}" not in ({values})'
    elif kind == "ar":
        span, _, where = rest.partition("?")
        c, lo, hi = span.split()
        bad = f"{c} < {lo}" + ("" if hi == "-" else f" or {c} > {hi}")
        yield "accepted_range", c, f"select count(*) from {model} where ({bad})" + (f" and ({where})" if where else "")
    elif kind == "pos":
        yield "assert_column_is_positive", rest, f"select count(*) from {model} where {rest} <= 0"
    elif kind == "fk":
        c, parent, pk = rest.split()
        yield "relationships", c, f"select count(*) from {model} where {c} not in (select {pk} from {parent} where {pk} is not null)"
    else:
        name, _, test = rest.partition(": ")
        yield name, "", f"select count(*) from {model} where {test}"


def _models(text: str, layer: str = "") -> dict[str, list[str]]:
    lines = [line.split(" | ") for line in text.strip().splitlines()]
    return {m: specs for m, *specs in lines if m.startswith(layer)}


def compile_suite(text: str, layer: str = "") -> str:
    return ALL + "\nunion all\n".join(
        f"select '{m}' as model, '{test}' as test, '{c}' as column_name, ({sql}) as failures"
        for m, specs in _models(text, layer).items() for spec in specs for test, c, sql in _violations(m, spec))


FEATURE_COLUMNS = [
    "passenger_id", "survey_date", "origin_barangay", "origin_district", "destination_type",
    "trip_purpose", "primary_route_used", "income_bracket", "prefers_aircon", "trips_per_week",
    "avg_fare_paid_php", "transfers_required", "wait_time_min", "satisfaction_score",
    "income_bracket_encoded", "destination_type_encoded", "trip_purpose_encoded",
    "prefers_aircon_int", "travel_time_min", "primary_route_name", "primary_route_district",
    "route_base_fare_php", "route_length_km", "cluster_id", "cluster_label",
    "is_ab_test_eligible", "is_likely_underserved", "underserved_severity_score"]

_prof = "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls, "
    f"{rratio(f'count(*) filter (where {c} is null)', 'count(*)', 4)} as null_rate, "
    f"coalesce({rratio(f'count(*) filter (where {c} is null)', 'count(*)', 4)} > 0.2, false) as flagged "
    f"from int_passenger_features" for c in FEATURE_COLUMNS)

SQL = {
    "dq_staging_tests": compile_suite(EXPECTED, "stg_"),
    "dq_intermediate_tests": compile_suite(EXPECTED, "int_"),
    "dq_mart_tests": compile_suite(EXPECTED, "mart_"),
    "dq_business_rules": compile_suite(RULES),
    "dq_stage_gates": ALL + """
select 'passenger_features' as gate, '{"rows":' || count(*) || '}' as seen, count(*) > 0 as passed from int_passenger_features
union all
select 'cluster_assignments', '{"assigned":' || a || ',"written_back":' || s || '}', a >= 2 and a = s
from (select (select count(distinct cluster_id) from mart_commuter_clusters) as a, (select count(distinct cluster_id) from stg_survey) as s)
union all
select 'mart_row_counts', '{"marts":4,"rows":' || n || '}', true from (select (select count(*) from mart_route_summary) + (select count(*) from mart_district_ridership)
  + (select count(*) from mart_commuter_clusters) + (select count(*) from mart_ab_test_results) as n)
union all
select 'cluster_labels', '{"unlabelled":' || count(*) || '}', count(*) = 0 from mart_commuter_clusters where cluster_label is null
union all
select 'ab_mart', '{"rows":' || count(*) || ',"passengers":' || count(distinct passenger_id) || '}', count(*) > 0 from mart_ab_test_results""",
    "staging_row_counts": ALL + "\nunion all\n".join(
        f"select '{m}' as name, count(*) as rows from {m}" for m in _models(EXPECTED, "stg_")),
    "mart_row_counts": ALL + "\nunion all\n".join(
        f"select '{m}' as name, count(*) as rows from {m}" for m in _models(EXPECTED, "mart_")),
    "route_coverage": with_clause("routes", "stops") + """
select r.route_id, r.route_name, coalesce(s.n_stops, 0) as n_stops, s.n_stops is null as has_no_stop
from routes r left join (select route_id, count(*) as n_stops from stops group by route_id) s
  on r.route_id = s.route_id""",
    "survey_null_profile": with_clause("routes", "stg_survey", extra=[
        ("int_passenger_features", PASSENGER_FEATURES)]) + _prof,
}
