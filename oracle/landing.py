"""Oracle SQL for the landing ingest path."""

from .standin import rratio, with_clause

LANDING = """
select printf('TRP-%07d', l_orderkey * 10 + l_linenumber) as trip_id,
       printf('R%02d', s_nationkey) as route_id, printf('VHC-%03d', l_suppkey) as vehicle_id,
       strftime(l_shipdate, '%Y-%m-%d') as trip_date,
       case when l_returnflag = 'A' then ' AM_peak' when l_returnflag = 'N' and l_linestatus = 'O' then 'PM_peak '
            when l_returnflag = 'N' then 'off_peak' else 'midday' end as time_period,
       dayname(l_shipdate) as day_of_week, cast(l_quantity as integer) as passengers_boarded,
       l_extendedprice as revenue_php, 30 + 2 * l_linenumber as travel_time_min,
       30 as scheduled_time_min, 2 * l_linenumber as delay_min, 2 * l_linenumber <= 5 as is_on_time,
       l_linestatus = 'F' as is_rainy_day, round(l_quantity * 0.03, 4) as load_factor,
       l_linenumber as _chunk, cast(date_trunc('month', l_shipdate) as date) as _date
from lineitem join supplier on l_suppkey = s_suppkey"""

DATA = ["trip_id", "route_id", "vehicle_id", "trip_date", "time_period", "day_of_week",
        "passengers_boarded", "revenue_php", "travel_time_min", "scheduled_time_min", "delay_min",
        "is_on_time", "is_rainy_day", "load_factor"]
STRINGS = ["trip_id", "route_id", "vehicle_id", "time_period", "day_of_week"]

_clean_cols = ", ".join(
    [f"nullif(trim({c}), '') as {c}" for c in STRINGS]
    + ["try_cast(nullif(trim(trip_date), '') as date) as trip_date"]
    + [c for c in DATA if c not in STRINGS + ["trip_date", "revenue_php", "load_factor"]]
    + ["case when isnan(revenue_php) then null else revenue_php end as revenue_php",
       "case when isnan(load_factor) then null else load_factor end as load_factor", "_date", "_chunk"])

RULES = [
    ("trip_id_pattern", r"regexp_matches(trip_id, '^TRP-\d{7,}$')"),
    ("route_id_pattern", r"regexp_matches(route_id, '^R\d{2,}$')"),
    ("vehicle_id_pattern", r"regexp_matches(vehicle_id, '^VHC-\d{3,}$')"),
    ("trip_date_present", "trip_date is not null"),
    ("time_period_enum", "time_period in ('AM_peak', 'midday', 'PM_peak', 'off_peak')"),
    ("day_of_week_enum", "day_of_week in ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')"),
    ("passengers_range", "passengers_boarded between 1 and 50"),
    ("revenue_non_negative", "revenue_php >= 0"),
    ("travel_time_positive", "travel_time_min > 0"),
    ("scheduled_time_positive", "scheduled_time_min > 0"),
    ("delay_non_negative", "delay_min >= 0"),
    ("load_factor_range", "load_factor between 0.0 and 1.5"),
    ("on_time_implies_small_delay", "not is_on_time or delay_min <= 5"),
]

_valid = " and ".join(f"coalesce({p}, false)" for _, p in RULES)
ORDER = "_date, _chunk, time_period, day_of_week, passengers_boarded, revenue_php, load_factor, is_rainy_day, route_id, vehicle_id"
_data = ", ".join(DATA)

def _with(*extra):
    parts = [("landing", LANDING),
             ("dedup", f"select {_data}, min(_date) as _date, min(_chunk) as _chunk from landing group by all"),
             ("cleaned", f"select {_clean_cols} from dedup"),
             ("valid", f"select * from cleaned where {_valid}")] + list(extra)
    return "with " + ",\n".join(f"{n} as ({b}\n)" for n, b in parts) + "\n"


def _winners(src):
    return (f"select * exclude (rn) from (select *, row_number() over (partition by trip_id order by {ORDER}) "
            f"as rn from {src}) where rn = 1")


SQL = {
    "landing_trip_validation": _with() + "\nunion all\n".join(
        f"select '{n}' as rule, count(*) filter (where not coalesce({p}, false)) as failures from cleaned"
        for n, p in RULES),
    "ingest_trips": _with() + _winners("valid"),
    "ingest_trips_deliveries": _with(("winners", _winners("valid"))) + f"select {_data} from winners",
    "ingest_trips_streamed": _with(("winners", _winners("valid"))) + f"select {_data} from winners",
    "ingest_trips_rerun": _with(
        ("valid_first", "select * from valid where _date < DATE '1997-01-01'"),
        ("first_dedup", "select l.* from (select * from landing where _date < DATE '1997-01-01') l"),
        ("first_clean", f"select {_clean_cols} from (select {_data}, min(_date) as _date, min(_chunk) as _chunk from first_dedup group by all)"),
        ("first_valid", f"select * from first_clean where {_valid}"),
        ("target", _winners("first_valid")),
        ("all_winners", _winners("valid"))) + """
select * from all_winners w where not exists (select 1 from target t where t.trip_id = w.trip_id)""",
    "landing_receipt": with_clause(extra=[("landing", LANDING)]) + """
select 'trips' as entity, _date as partition_date, count(*) as rows_written from landing group by _date""",
    "experiment_orphans": with_clause("stg_survey", "stg_ab") + """
, per_key as (select passenger_id, count(*) as orphan_rows from stg_ab a
              where passenger_id is not null and not exists (select 1 from stg_survey s where s.passenger_id = a.passenger_id)
              group by passenger_id)
select passenger_id, orphan_rows, (select cast(sum(orphan_rows) as bigint) from per_key) as total_orphan_rows
from per_key order by passenger_id limit 10""",
    "experiment_fk_filtered": with_clause("stg_survey", "stg_ab") + """
select experiment_record_id, passenger_id, "group" from stg_ab a
where exists (select 1 from stg_survey s where s.passenger_id = a.passenger_id)""",
    "landing_null_profile": _with() + "\nunion all\n".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls, "
        f"{rratio(f'count(*) filter (where {c} is null)', 'count(*)', 4)} as null_rate, "
        f"coalesce({rratio(f'count(*) filter (where {c} is null)', 'count(*)', 4)} > 0.2, false) as flagged from cleaned"
        for c in DATA + ["_date", "_chunk"]),
    "ingest_range_checks": with_clause("stg_survey") + ", " + _with()[5:] + """
select 'satisfaction_score' as "check", count(*) filter (where not coalesce(satisfaction_score between 1 and 5, false)) as failures from stg_survey
union all
select 'load_factor', count(*) filter (where not coalesce(load_factor between 0 and 1.5, false)) from cleaned""",
}


def _pad(prefix, expr, width):
    s = f"cast({expr} as varchar)"
    return f"'{prefix}' || case when length({s}) >= {width} then {s} else lpad({s}, {width}, '0') end"


LANDING_PAX = f"""
select {_pad('PAX-', 'passenger_id', 4)} as passenger_id, cast(survey_date as varchar) as survey_date,
       origin_barangay, ' ' || origin_district as origin_district, destination_type, trip_purpose,
       {_pad('R', 'primary_route_used', 2)} as primary_route_used,
       cast(trips_per_week as integer) as trips_per_week, cast(avg_fare_paid_php as double) as avg_fare_paid_php,
       cast(transfers_required as integer) as transfers_required, cast(wait_time_min as integer) as wait_time_min,
       cast(travel_time_min as integer) as travel_time_min, cast(satisfaction_score as integer) as satisfaction_score,
       income_bracket, prefers_aircon, cast(passenger_id % 4 as integer) as _chunk,
       cast(date_trunc('month', survey_date) as date) as _date
from survey"""
PAX_DATA = ["passenger_id", "survey_date", "origin_barangay", "origin_district", "destination_type",
            "trip_purpose", "primary_route_used", "trips_per_week", "avg_fare_paid_php",
            "transfers_required", "wait_time_min", "travel_time_min", "satisfaction_score",
            "income_bracket", "prefers_aircon"]
PAX_STR = ["passenger_id", "origin_barangay", "origin_district", "destination_type", "trip_purpose",
           "primary_route_used", "income_bracket"]
_pax_clean = ", ".join([f"nullif(trim({c}), '') as {c}" for c in PAX_STR]
                       + ["try_cast(nullif(trim(survey_date), '') as date) as survey_date"]
                       + [c for c in PAX_DATA if c not in PAX_STR + ["survey_date", "avg_fare_paid_php"]]
                       + ["case when isnan(avg_fare_paid_php) then null else avg_fare_paid_php end as avg_fare_paid_php",
                          "_date", "_chunk"])
PAX_RULES = [r"regexp_matches(passenger_id, '^PAX-\d{4,}$')", "satisfaction_score between 1 and 5",
             "trips_per_week between 0 and 14", "transfers_required between 0 and 3", "wait_time_min >= 0",
             "travel_time_min > 0", "income_bracket in ('low', 'middle', 'high')",
             "destination_type in ('work', 'school', 'market', 'hospital', 'mall')",
             "trip_purpose in ('daily_commute', 'occasional', 'weekend_only')"]

LANDING_AB = f"""
select {_pad('ABR-', 'event_id', 7)} as experiment_record_id, 'EXP-001' as experiment_id,
       {_pad('PAX-', 'user_id', 4)} as passenger_id,
       case when user_id % 2 <> 0 then 'treatment' else 'control' end as "group",
       case when user_id % 2 <> 0 then 'B_express' else 'A_current' end as route_variant,
       cast(1 + event_id % 8 as integer) as test_week, value as simulated_travel_time_min,
       cast(1 + event_id % 5 as integer) as satisfaction_score, cast(event_id % 4 as integer) as transfers_needed,
       event_type in ('purchase', 'click') as would_use_again,
       cast(1 + event_id % 8 as integer) as _chunk, cast(date_trunc('month', ts) as date) as _date
from events"""
AB_DATA = ["experiment_record_id", "experiment_id", "passenger_id", '"group"', "route_variant", "test_week",
           "simulated_travel_time_min", "satisfaction_score", "transfers_needed", "would_use_again"]
AB_STR = ["experiment_record_id", "experiment_id", "passenger_id", '"group"', "route_variant"]
_ab_clean = ", ".join([f"nullif(trim({c}), '') as {c}" for c in AB_STR]
                      + [c for c in AB_DATA if c not in AB_STR + ["simulated_travel_time_min"]]
                      + ["case when isnan(simulated_travel_time_min) then null else simulated_travel_time_min end "
                         "as simulated_travel_time_min", "_date", "_chunk"])
AB_RULES_SQL = [r"regexp_matches(experiment_record_id, '^ABR-\d{7,}$')", r"regexp_matches(passenger_id, '^PAX-\d{4,}$')",
                "\"group\" in ('control', 'treatment')", "test_week between 1 and 8",
                "satisfaction_score between 1 and 5", "transfers_needed between 0 and 3",
                "(\"group\" = 'control' and route_variant = 'A_current') or (\"group\" = 'treatment' and route_variant = 'B_express')"]


def _ok(rules):
    return " and ".join(f"coalesce({r}, false)" for r in rules)


ORDERED = with_clause("survey", extra=[
    ("lp", LANDING_PAX),
    ("lp_dedup", f"select {', '.join(PAX_DATA)}, min(_date) as _date, min(_chunk) as _chunk from lp group by all"),
    ("lp_clean", f"select {_pax_clean} from lp_dedup"),
    ("lp_valid", f"select * from lp_clean where {_ok(PAX_RULES)}"),
    ("passengers", "select * exclude (rn) from (select *, row_number() over (partition by passenger_id "
                   "order by _date, _chunk, survey_date, origin_district, satisfaction_score) as rn from lp_valid) where rn = 1"),
    ("le", LANDING_AB),
    ("le_dedup", f"select {', '.join(AB_DATA)}, min(_date) as _date, min(_chunk) as _chunk from le group by all"),
    ("le_clean", f"select {_ab_clean} from le_dedup"),
    ("le_valid", f"select * from le_clean v where {_ok(AB_RULES_SQL)} "
                 "and exists (select 1 from passengers p where p.passenger_id = v.passenger_id)"),
    ("experiment", "select * exclude (rn) from (select *, row_number() over (partition by experiment_record_id "
                   "order by _date, _chunk, test_week, satisfaction_score, simulated_travel_time_min) as rn "
                   "from le_valid) where rn = 1"),
])

SQL.update({
    "ingest_passengers": ORDERED + "select * from passengers",
    "ingest_experiment": ORDERED + "select * from experiment",
})


# marts over the loaded trips: one row for each trip key, codes back to ids
from .models import ROUTE_CTES, ROUTE_SUMMARY  # noqa: E402
from .standin import ENTITIES, STAGING  # noqa: E402

_number = lambda c, prefix: f"cast(substr({c}, {len(prefix) + 1}) as bigint) as {c}"
_TRIPS = f"""select {_number('trip_id', 'TRP-')}, {_number('route_id', 'R')}, {_number('vehicle_id', 'VHC-')}, trip_date, time_period, day_of_week,
  passengers_boarded, cast(revenue_php as decimal(12,2)) as revenue_php, travel_time_min, scheduled_time_min, delay_min, is_on_time,
  is_rainy_day, cast(load_factor as decimal(4,3)) as load_factor from loaded"""
SQL["mart_route_summary_ingested"] = _with(
    ("loaded", _winners("valid")), ("trips", _TRIPS), ("routes", ENTITIES["routes"]), ("operators", ENTITIES["operators"]),
    ("vehicles", ENTITIES["vehicles"]), ("stg_vehicles", STAGING["stg_vehicles"]), ("stg_trips", STAGING["stg_trips"]),
    *ROUTE_CTES, ("mart_route_summary", ROUTE_SUMMARY)) + "select * from mart_route_summary"
