"""Oracle SQL for the dashboard queries (D01-D26, S12/S13, A-/L-/W- operators)."""

from .models import (AB_RESULTS, COMMUTER_CLUSTERS, DISTRICT_CTES, DAILY_CTES,
                     PASSENGER_FEATURES, ROUTE_CTES, ROUTE_SUMMARY)
from .standin import rmean, rnum, rratio, with_clause

FEATURES = ["trips_per_week", "avg_fare_paid_php", "transfers_required",
            "wait_time_min", "travel_time_min", "satisfaction_score"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SUMMARY = with_clause("routes", "operators", "stg_trips", "stg_vehicles",
                      extra=ROUTE_CTES + [("mart_route_summary", ROUTE_SUMMARY)])
RECENT_SUMMARY = with_clause("routes", "operators", "stg_trips", "stg_vehicles", extra=ROUTE_CTES + [
    ("mart_route_summary", ROUTE_SUMMARY),
    ("recent_summary", """select * from mart_route_summary where trip_date >=
        (select max(trip_date) - interval 30 day from mart_route_summary)""")])
DISTRICT = with_clause("routes", "stops", "stg_trips", "stg_survey",
                       extra=DAILY_CTES
                       + DISTRICT_CTES)
RECENT_DISTRICT = with_clause("routes", "stops", "stg_trips", "stg_survey", extra=[
    *DAILY_CTES] + DISTRICT_CTES + [
    ("recent_district", """select * from mart_district_ridership where trip_date >=
        (select max(trip_date) - interval 30 day from mart_district_ridership)""")])
DAILY = with_clause("routes", "stg_trips", extra=DAILY_CTES)
CLUSTERS = with_clause("routes", "stg_survey", extra=[
    ("int_passenger_features", PASSENGER_FEATURES), ("mart_commuter_clusters", COMMUTER_CLUSTERS)])
AB = with_clause("routes", "stg_survey", "stg_ab", extra=[
    ("int_passenger_features", PASSENGER_FEATURES), ("mart_ab", AB_RESULTS)])

_cmp_cols = "\nunion all\n".join(
    f"select '{c}' as feature, {rnum(f'avg({c}) filter (where cluster_id = 0)', 2)} as mean_a, "
    f"{rnum(f'avg({c}) filter (where cluster_id = 3)', 2)} as mean_b, "
    f"{rnum(f'avg({c}) filter (where cluster_id = 3) - avg({c}) filter (where cluster_id = 0)', 2)} "
    f"as diff_b_minus_a from mart_commuter_clusters" for c in FEATURES)

_dev = ", ".join(
    f"{rnum(f'coalesce((avg({c}) - sum(sum({c})) over () / sum(count({c})) over ()) / nullif(sum(sum({c})) over () / sum(count({c})) over (), 0), 0)', 6)} as {c}_dev"
    for c in FEATURES)

_radar_means = ", ".join(f"avg({c}) as {c}" for c in FEATURES)
_radar = ", ".join(
    f"{rnum(f'({c} - min({c}) over ()) / coalesce(nullif(max({c}) over () - min({c}) over (), 0), 1.0)', 6)} as {c}_radar"
    for c in FEATURES)


def _pivot(src, idx, measure, n=4):
    cols = ", ".join(f"{rnum(f'avg({measure}) filter (where day_of_week = ' + chr(39) + d + chr(39) + ')', n)} as \"{d}\""
                     for d in WEEKDAYS)
    return f"select {idx}, {cols} from {src} group by {idx}"


SQL = {
    "route_summary_recent": RECENT_SUMMARY + "select * from recent_summary",
    "district_ridership_recent": RECENT_DISTRICT + "select * from recent_district",
    "home_kpis": CLUSTERS + f"""
select count(*) as total_passengers, {rmean('satisfaction_score', 2)} as avg_satisfaction,
       {rmean('avg_fare_paid_php', 2)} as avg_fare, {rmean('wait_time_min', 1)} as avg_wait_min,
       count(*) filter (where cluster_id = 3) as underserved_riders,
       {rratio('count(*) filter (where cluster_id = 3) * 100', 'count(*)', 1)} as underserved_pct
from mart_commuter_clusters""",
    "top_routes_by_riders": RECENT_SUMMARY + """
select route_id, cast(sum(total_passengers) as bigint) as total_passengers from recent_summary
group by route_id order by total_passengers desc, route_id limit 12""",
    "top5_route_series": RECENT_SUMMARY + """
select route_id, trip_date, total_passengers from recent_summary where route_id in (
  select route_id from recent_summary group by route_id
  order by sum(total_passengers) desc, route_id limit 5)""",
    "boardings_by_district": RECENT_DISTRICT + """
select district, cast(sum(total_boardings) as bigint) as total_boardings from recent_district group by district""",
    "cluster_kpis": CLUSTERS + f"""
select count(*) as total_passengers, count(distinct cluster_id) as clusters_shown,
       {rmean('satisfaction_score', 2)} as avg_satisfaction, {rmean('transfers_required', 2)} as avg_transfers,
       {rmean('wait_time_min', 1)} as avg_wait_min
from mart_commuter_clusters where trip_purpose in ('daily_commute', 'occasional')""",
    "cluster_counts": CLUSTERS + """
select cluster_id, cluster_label, count(*) as n from mart_commuter_clusters group by cluster_id, cluster_label""",
    "cluster_comparison": CLUSTERS + _cmp_cols,
    "cluster_cards": CLUSTERS + f"""
, g as (select cluster_id, cluster_label, count(*) as passengers,
       {rmean('satisfaction_score', 2)} as avg_satisfaction, {rmean('transfers_required', 2)} as avg_transfers,
       {rmean('wait_time_min', 1)} as avg_wait_min, {rmean('trips_per_week', 1)} as avg_trips_per_week,
       {rmean('avg_fare_paid_php', 2)} as avg_fare, {rmean('travel_time_min', 1)} as avg_travel_min,
       {rnum('avg(cast(prefers_aircon as integer)) * 100', 1)} as aircon_pct
  from mart_commuter_clusters group by cluster_id, cluster_label),
p as (select cluster_id, trip_purpose, row_number() over (partition by cluster_id order by count(*) desc, trip_purpose) as rn
  from mart_commuter_clusters where trip_purpose is not null group by cluster_id, trip_purpose)
select g.*, {rratio('passengers', 'sum(passengers) over ()', 3)} as share_pct, p.trip_purpose as top_trip_purpose
from g left join p on g.cluster_id = p.cluster_id and p.rn = 1""",
    "cluster_top_districts": CLUSTERS + """
select * from (select cluster_id, origin_district, count(*) as n,
       cast(row_number() over (partition by cluster_id order by count(*) desc, origin_district) as integer) as rank
  from mart_commuter_clusters group by cluster_id, origin_district) where rank <= 5""",
    "cluster_deviation": CLUSTERS + f"select cluster_id, {_dev} from mart_commuter_clusters group by cluster_id",
    "cluster_radar": CLUSTERS + f", g as (select cluster_id, {_radar_means} from mart_commuter_clusters group by cluster_id) select cluster_id, {_radar} from g",
    "trend_kpis": SUMMARY + f"""
select cast(sum(total_passengers) as bigint) as total_passengers, count(distinct trip_date) as days_of_data,
       {rmean('cast(avg_load_factor as decimal(18,3))', 6)} as avg_load_factor,
       cast(sum(cast(total_revenue_php as decimal(18,2))) as double) as total_revenue_php
from mart_route_summary""",
    "route_rolling_series": SUMMARY + f"""
select route_id, route_name, trip_date, total_passengers,
       {rnum('avg(total_passengers) over (partition by route_id order by trip_date rows between 2 preceding and current row)', 6)} as passengers_smoothed
from mart_route_summary""",
    "revenue_series": SUMMARY + """
, d as (select trip_date, cast(sum(cast(total_revenue_php as decimal(18,2))) * 100 as bigint) as rc
        from mart_route_summary group by trip_date),
s as (select trip_date, sum(rc) over (order by trip_date rows between 2 preceding and current row) as s3,
             count(*) over (order by trip_date rows between 2 preceding and current row) as n3 from d),
s2 as (select trip_date, (2 * s3 + n3) // (2 * n3) as sm from s),
s7 as (select trip_date, sm, sum(sm) over (order by trip_date rows between 6 preceding and current row) as t7,
              count(*) over (order by trip_date rows between 6 preceding and current row) as n7 from s2)
select trip_date, sm / 100.0 as revenue, ((2 * t7 + n7) // (2 * n7)) / 100.0 as revenue_7d from s7""",
    "route_weekday_heatmap": SUMMARY + ", hm as (select *, dayname(trip_date) as day_of_week from mart_route_summary) "
        + _pivot("hm", "route_id", "total_passengers"),
    "district_series": DISTRICT + "select trip_date, district, total_boardings from mart_district_ridership",
    "top_bottom_routes": SUMMARY + """
, a as (select route_id, cast(sum(total_passengers) as bigint) as total_passengers
        from mart_route_summary group by route_id),
tb as ((select *, 'top' as rank_group from a order by total_passengers desc, route_id limit 5)
       union all
       (select *, 'bottom' as rank_group from a order by total_passengers asc, route_id limit 5))
select tb.*, cast(tb.route_id as varchar) || ' - ' || coalesce(r.route_name, cast(tb.route_id as varchar)) as route_label
from tb left join routes r on tb.route_id = r.route_id""",
    "district_satisfaction_map": with_clause("stops", "stg_survey") + f"""
, sv as (select origin_district as district, {rmean('satisfaction_score', 2)} as avg_satisfaction,
       {rmean('wait_time_min', 1)} as avg_wait_min, count(*) as respondents
  from stg_survey group by origin_district),
cen as (select district, {rmean('latitude', 6)} as lat, {rmean('longitude', 6)} as lon from stops group by district)
select sv.*, cen.lat, cen.lon,
       printf('#%02x%02x40', cast(round((1 - greatest(0.0, least(1.0, (avg_satisfaction - 1) / 4.0))) * 255) as integer),
              cast(round(greatest(0.0, least(1.0, (avg_satisfaction - 1) / 4.0)) * 255) as integer)) as color,
       greatest(5, respondents / 10.0) as radius
from sv join cen on sv.district = cen.district""",
    "route_stop_stats": with_clause("stops", "routes") + """
, ex as (select stop_id, avg_daily_boardings, has_shelter, cast(unnest(string_split(routes_served, ',')) as integer) as route_id from stops)
select ex.route_id, r.route_name, count(*) as n_stops, cast(sum(avg_daily_boardings) as bigint) as total_daily_boardings,
       count(*) filter (where has_shelter) as sheltered_stops
from ex join routes r on ex.route_id = r.route_id group by ex.route_id, r.route_name""",
    "stop_table": with_clause("stops") + """
select stop_id, stop_name, district, stop_type, avg_daily_boardings, has_shelter from stops""",
    "bi_daily_riders_by_route": SUMMARY + """
select cast(date_trunc('day', trip_date) as date) as day, route_id, cast(sum(total_passengers) as bigint) as riders
from mart_route_summary group by 1, 2""",
    "bi_load_by_route": SUMMARY + f"""
select route_id, {rmean('cast(avg_load_factor as decimal(18,3))', 4)} as avg_load_factor
from mart_route_summary group by route_id""",
    "bi_revenue_per_km_by_route": DAILY + f"""
select route_id, {rmean('cast(revenue_per_km_php as decimal(18,2))', 4)} as avg_revenue_per_km
from int_daily_ridership group by route_id""",
    "bi_weekly_on_time": SUMMARY + f"""
select cast(date_trunc('week', trip_date) as date) as week, route_id,
       {rmean('cast(on_time_rate as decimal(18,3))', 4)} as on_time_rate
from mart_route_summary group by 1, 2""",
    "bi_peak_offpeak": DAILY + """
select trip_date, cast(sum(peak_passengers) as bigint) as peak_passengers,
       cast(sum(total_passengers) - coalesce(sum(peak_passengers), 0) as bigint) as off_peak_passengers
from int_daily_ridership group by trip_date""",
    "bi_rain_delay_box": SUMMARY + f"""
select is_rainy_day, count(avg_delay_min) as n, min(avg_delay_min) as min,
       {rnum('quantile_cont(avg_delay_min, 0.25)', 6)} as q1, {rnum('quantile_cont(avg_delay_min, 0.5)', 6)} as median,
       {rnum('quantile_cont(avg_delay_min, 0.75)', 6)} as q3, max(avg_delay_min) as max
from mart_route_summary group by is_rainy_day""",
    "bi_district_daily": DISTRICT + """
select trip_date, district, cast(sum(total_boardings) as bigint) as riders from mart_district_ridership group by 1, 2""",
    "bi_district_weekday": DISTRICT + ", dw as (select *, dayname(trip_date) as day_of_week from mart_district_ridership) "
        + _pivot("dw", "district", "total_boardings"),
    "bi_district_service": DISTRICT + f"""
select district, {rmean('cast(avg_wait_time_min as decimal(18,2))', 4)} as avg_wait_time_min,
       {rmean('cast(avg_satisfaction as decimal(18,2))', 4)} as avg_satisfaction,
       {rmean('cast(pct_with_shelter as decimal(18,3))', 4)} as pct_with_shelter
from mart_district_ridership group by district""",
    "bi_monthly_transfers": with_clause("stg_survey") + f"""
select cast(date_trunc('month', survey_date) as date) as month, origin_district as district,
       {rmean('transfers_required', 4)} as avg_transfers
from stg_survey group by 1, 2""",
    "bi_ab_group_means": AB + f"""
select "group", {rmean('satisfaction_score', 4)} as avg_satisfaction,
       {rmean('cast(simulated_travel_time_min as decimal(18,2))', 4)} as avg_travel_time,
       {rmean('transfers_needed', 4)} as avg_transfers
from mart_ab group by "group\"""",
    "bi_ab_reuse_counts": AB + """select "group", would_use_again, count(*) as n from mart_ab group by 1, 2""",
    "bi_ab_weekly_score": AB + f"""
select test_week, "group", {rmean('satisfaction_score', 4)} as avg_satisfaction from mart_ab group by 1, 2""",
    "filter_options_district": CLUSTERS + """
select origin_district, count(*) as n from mart_commuter_clusters where origin_district is not null group by 1""",
    "bounds_trip_date": SUMMARY + "select min(trip_date) as min_trip_date, max(trip_date) as max_trip_date from mart_route_summary",
    "bounds_test_week": AB + "select min(test_week) as min_test_week, max(test_week) as max_test_week from mart_ab",
    "fleet_per_route": with_clause("vehicles") + """
select route_assigned, count(*) as vehicles, count(*) filter (where vehicle_type = 'modernized_PUV') as modern_vehicles
from vehicles group by route_assigned""",
}

SQL["cluster_sample"] = CLUSTERS + """
select * from mart_commuter_clusters order by md5(passenger_id || ':42'), passenger_id limit 2000"""

_SELECTED = "mart_route_summary where route_id in (1, 4, 9, 16) and trip_date between date '1995-01-01' and date '1996-12-31'"
SQL["trend_kpis_filtered"] = SUMMARY + f"""
select cast(sum(total_passengers) as bigint) as total_passengers, count(distinct trip_date) as days_of_data,
       {rmean('cast(avg_load_factor as decimal(18,3))', 6)} as avg_load_factor,
       cast(sum(cast(total_revenue_php as decimal(18,2))) as double) as total_revenue_php
from {_SELECTED}"""
SQL["route_weekday_heatmap_filtered"] = (SUMMARY + f", hm as (select *, dayname(trip_date) as day_of_week from {_SELECTED}) "
                                         + _pivot("hm", "route_id", "total_passengers"))
SQL["district_series_filtered"] = DISTRICT + """select trip_date, district, total_boardings from mart_district_ridership
where trip_date between date '1995-01-01' and date '1996-12-31'"""
SQL["stop_table_filtered"] = SQL["stop_table"] + " where stop_type in ('terminal', 'market') and district in ('ASIA', 'EUROPE')"
for _name, _column in (("purpose", "trip_purpose"), ("income", "income_bracket")):
    SQL[f"filter_options_{_name}"] = CLUSTERS + f"select {_column}, count(*) as n from mart_commuter_clusters where {_column} is not null group by 1"
    SQL[f"cluster_by_{_name}"] = CLUSTERS + f"select cluster_label, {_column}, count(*) as passengers from mart_commuter_clusters group by 1, 2"
SQL["filter_options_stop_type"] = with_clause("stops") + "select stop_type, count(*) as n from stops where stop_type is not null group by 1"

#: A16 boxes with whiskers and violins over the experiment mart.
_RAW = AB + """, v as (select "group", simulated_travel_time_min::double as v from mart_ab where simulated_travel_time_min is not null),
q as (select "group", count(*) as n, min(v) as lo, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) as q3, max(v) as hi from v group by 1),
f as (select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)"""
SQL["ab_travel_box"] = _RAW + f"""
select f."group", any_value(n) as n, {rnum('any_value(lo)', 6)} as min, {rnum('min(v) filter (where v between low and high)', 6)} as whisker_low, {rnum('any_value(q1)', 6)} as q1,
       {rnum('any_value(med)', 6)} as median, {rnum('any_value(q3)', 6)} as q3, {rnum('max(v) filter (where v between low and high)', 6)} as whisker_high, {rnum('any_value(hi)', 6)} as max,
       count(*) filter (where v not between low and high) as outliers
from f join v using ("group") group by 1"""
SQL["ab_fare_violin"] = AB + f""", v as (select "group", simulated_fare_php::double as v from mart_ab where simulated_fare_php is not null),
s as (select "group", count(*) as n, min(v) as lo, max(v) as hi, stddev_samp(v) as s from v group by 1 having stddev_samp(v) > 0),
b as (select "group", least(floor((v - lo) / ((hi - lo) / 128)), 127) as b, count(*) as c from v join s using ("group") group by 1, 2),
p as (select *, unnest(range(64)) as point, 1.06 * s * pow(n, -0.2) as h from s),
x as (select *, lo + (hi - lo) * point / 63 as x from p)
select "group", point::int as point, {rnum('any_value(x)', 6)} as x, {rnum("sum(c * exp(-pow((x - (lo + (b + 0.5) * ((hi - lo) / 128))) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi()))", 6)} as density
from x join b using ("group") group by 1, 2"""
SQL["route_summary_recent_months"] = SQL["route_summary_recent"]
SQL["bi_ab_significance"] = AB + """
select experiment_record_id, experiment_id, "group", p_value, is_significant, effect_size, confidence_interval_low, confidence_interval_high from mart_ab order by experiment_record_id limit 20"""
SQL["bi_daily_riders_limited"] = "select * from (" + SQL["bi_daily_riders_by_route"] + ") order by day, route_id limit 1000"
SQL["cluster_kpis_filtered"] = CLUSTERS + f"""
select count(*) as total_passengers, count(distinct cluster_id) as clusters_shown, {rmean('satisfaction_score', 2)} as avg_satisfaction, {rmean('transfers_required', 2)} as avg_transfers,
       {rmean('wait_time_min', 1)} as avg_wait_min
from mart_commuter_clusters where cluster_id in (0, 3) and origin_district in ('ASIA', 'EUROPE') and trip_purpose in ('daily_commute', 'weekend_only') and income_bracket in ('low', 'high')"""
