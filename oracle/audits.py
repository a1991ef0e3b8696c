"""Oracle SQL for audits, pages, histograms and crosstabs."""

from .dashboards import AB, SUMMARY
from .experiment import EXP
from .standin import with_clause


def _rules(src, rules):
    return "\nunion all\n".join(
        f"select '{n}' as rule, count(*) filter (where not coalesce({p}, false)) as failures from {src}"
        for n, p in rules)


TRIP_RULES = [
    ("travel_equals_scheduled_plus_delay", "travel_time_min = scheduled_time_min + delay_min"),
    ("on_time_iff_delay_le_5", "is_on_time = (delay_min <= 5)"),
    ("revenue_equals_riders_times_fare",
     "revenue_php = passengers_boarded * (cast(base_fare_php as decimal(10,2)) "
     "+ cast(1.50 as decimal(4,2)) * cast(greatest(0, route_length_km - 4) as decimal(10,2)))"),
    ("load_factor_within_range", "load_factor between 0 and 1.5"),
]
SURVEY_RULES = [
    ("satisfaction_range", "satisfaction_score between 1 and 5"),
    ("trips_per_week_range", "trips_per_week between 0 and 14"),
    ("transfers_range", "transfers_required between 0 and 3"),
    ("wait_non_negative", "wait_time_min >= 0"),
    ("travel_positive", "travel_time_min > 0"),
    ("income_enum", "income_bracket in ('low', 'middle', 'high')"),
    ("destination_enum", "destination_type in ('work', 'school', 'market', 'hospital', 'mall')"),
    ("purpose_enum", "trip_purpose in ('daily_commute', 'occasional', 'weekend_only')"),
    ("origin_district_length", "length(origin_district) between 2 and 50"),
    ("origin_barangay_length", "length(origin_barangay) between 2 and 100"),
]
AB_RULES = [
    ("group_enum", "\"group\" in ('control', 'treatment')"),
    ("week_range", "test_week between 1 and 8"),
    ("score_range", "satisfaction_score between 1 and 5"),
    ("transfers_range", "transfers_needed between 0 and 3"),
    ("group_variant_alignment",
     "(\"group\" = 'control' and route_variant = 'A_current') or (\"group\" = 'treatment' and route_variant = 'B_express')"),
]

SQL = {
    "trip_audit": with_clause("routes", "stg_trips", extra=[
        ("j", "select t.*, r.base_fare_php, r.route_length_km from stg_trips t join routes r on t.route_id = r.route_id")])
        + _rules("j", TRIP_RULES),
    "events_by_period": """
select case when hour(ts) >= 6 and hour(ts) < 9 then 'AM_peak' when hour(ts) >= 9 and hour(ts) < 17 then 'midday'
            when hour(ts) >= 17 and hour(ts) < 20 then 'PM_peak' else 'off_peak' end as time_period,
       event_type, count(*) as events
from events group by 1, 2""",
    "survey_validation": with_clause("stg_survey") + _rules("stg_survey", SURVEY_RULES),
    "ab_validation": with_clause("stg_ab") + _rules("stg_ab", AB_RULES),
    "ab_results_page": AB + """
select * from mart_ab where test_week between 2 and 6 and "group" in ('control', 'treatment')
order by passenger_id, test_week, experiment_record_id limit 500""",
    "route_preview": SUMMARY + "select * from mart_route_summary order by trip_date desc, route_id limit 500",
    "ab_score_histogram": AB + """
select cast(floor((satisfaction_score - 0.5) / 1.0) + 1 as bigint) as score_bin, "group", count(*) as n
from mart_ab group by 1, 2""",
    "ab_transfer_histogram": AB + """select transfers_needed as transfers, "group", count(*) as n from mart_ab group by 1, 2""",
    "ab_reuse_crosstab": EXP + """
select cast(would_use_again as integer) as reuse, count(*) filter (where "group" = 'control') as control,
       count(*) filter (where "group" = 'treatment') as treatment
from exp group by 1""",
}

SQL.update({
    "sql_parquet_route_volume": """
select s_nationkey as route_id, cast(year(l_shipdate) as integer) as ship_year, count(*) as trips,
       cast(sum(l_quantity) as bigint) as riders
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2""",
    "sql_parquet_regions": "select * from region where r_regionkey >= 0",
})

_TIMED = with_clause("routes", "stg_trips", extra=[("timed", """
  select t.*, r.route_length_km, (trip_id // 10 * 7919 + trip_id % 10 * 61) % 86400 as dep,
         (dep + travel_time_min * 60 + case when trip_id // 10 % 997 = 0 then 60 else 0 end) % 86400 as arr,
         passengers_boarded * (case route_id when 11 then 15.00 else 13.00 end + 1.50 * greatest(0, r.route_length_km - 4)) as due
  from stg_trips t join routes r using (route_id)""")])
SQL["trip_time_audit"] = _TIMED + _rules("timed", [
    ("arrival_is_departure_plus_travel", "arr = (dep + travel_time_min * 60) % 86400"),
    ("seconds_are_kept", "arr % 60 = dep % 60"),
    ("earlier_only_past_midnight", "(arr < dep) = (dep + travel_time_min * 60 >= 86400)"),
    ("revenue_covers_the_route_fare", "revenue_php >= due")])
