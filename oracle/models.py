"""Oracle SQL of the models, written from their output contract.

Route-day measures are declared once, as (name, expression) pairs over trips joined to
their vehicle and operator, and evaluated at the grain of trips, so the two-level Spark
plans are checked against a one-level form.  A vehicle counts once a route-day through
a flag on its first trip there.
"""

from .standin import rmean, rratio, with_clause


def _list(pairs) -> str:
    return ",\n       ".join(e if e == n else f"{e} as {n}" for n, e in pairs)


def _trips(cond: str) -> str:
    return f"count(trip_id) filter (where {cond})"


#: Measures of a route-day that need trips only.
VOLUME = [
    ("is_rainy_day", "bool_or(is_rainy_day)"),
    ("total_trips", "count(trip_id)"),
    ("total_passengers", "sum(passengers_boarded)::bigint"),
    *[(name, rmean(source, scale)) for name, source, scale in (
        ("avg_passengers_per_trip", "passengers_boarded", 2), ("avg_load_factor", "load_factor", 3),
        ("avg_travel_time_min", "travel_time_min", 2), ("avg_delay_min", "delay_min", 2))],
    ("revenue", "sum(revenue_php)"),
    ("on_time_trips", _trips("is_on_time")),
    ("peak_trips", _trips("is_peak")),
    ("off_peak_trips", _trips("not is_peak")),
]
#: What follows from a route-day's volume and its route.
RATES = [
    ("total_revenue_php", "revenue::double"),
    ("revenue_per_km_php", rratio("revenue", "route_length_km", 2)),
    ("on_time_rate", rratio("on_time_trips", "total_trips", 3)),
]
RIDERS = [(f"{k}_passengers", f"(sum(passengers_boarded) filter (where is_{k}))::bigint") for k in ("peak", "weekend")]
#: Measures that need the vehicle and its operator.  first_run: a vehicle's first trip of the route-day.
FLEET = [
    ("overcrowded_trips", _trips("is_overcrowded")),
    ("distinct_vehicles", "count(vehicle_id) filter (where first_run)"),
    ("modern_vehicles", "count(*) filter (where first_run and vehicle_type = 'modernized_PUV')"),
    ("electric_vehicles", "count(*) filter (where first_run and fuel_type = 'electric')"),
    ("avg_vehicle_capacity", rmean("capacity", 1)),
    ("avg_fleet_age_years", rmean("vehicle_age_years", 1)),
    ("pct_compliant_operators", rratio("coalesce(len(list_distinct(list(holder) filter (where is_compliant_puv))), 0)", "len(list_distinct(list(holder)))", 3)),
    ("total_fuel_cost_php", "coalesce(sum(avg_fuel_cost_daily_php) filter (where first_run), 0)::double"),
]


def _columns(pairs) -> str:
    return ", ".join(n for n, _ in pairs if n != "revenue")


DAILY_CTES = [("int_daily_ridership", f"""
select route_id, route_name, district_covered, route_length_km, trip_date, {_columns(VOLUME + RIDERS)},
       {_list(RATES)}
from (select route_id, trip_date, {_list(VOLUME + RIDERS)} from stg_trips group by all)
     join routes using (route_id)""")]

ROUTE_CTES = [
    ("runs", """
select t.*, vehicle_type, fuel_type, capacity, vehicle_age_years, avg_fuel_cost_daily_php, o.operator_id as holder, is_compliant_puv,
       t.vehicle_id is not null and row_number() over (partition by t.route_id, t.trip_date, t.vehicle_id order by t.trip_id) = 1 as first_run
from stg_trips t left join (stg_vehicles v left join operators o on o.operator_id = v.operator_id) on v.vehicle_id = t.vehicle_id"""),
    ("int_route_performance", f"""
select route_id, route_name, district_covered, route_length_km, base_fare_php, peak_frequency_min, off_peak_frequency_min, trip_date,
       {_columns(VOLUME + FLEET)}, {_list(RATES)}
from (select route_id, trip_date, {_list(VOLUME + FLEET)} from runs group by all)
     join routes using (route_id)"""),
]

ROUTE_SUMMARY = f"""
select * exclude (base_fare_php, peak_frequency_min, off_peak_frequency_min, route_length_km, total_fuel_cost_php),
       on_time_rate is not null and on_time_rate >= 0.80 as meets_ltfrb_target,
       {rratio('peak_trips', 'total_trips', 3)} as peak_trip_ratio
from int_route_performance"""


def route_ctes(with_summary=True):
    return with_clause("routes", "operators", "stg_trips", "stg_vehicles",
                       extra=ROUTE_CTES + [("mart_route_summary", ROUTE_SUMMARY)] * with_summary)


#: Static figures of a district by scalar look-up, the days by roll-up of route-days.
_SHELTERED = rratio("count(stop_id) filter (where has_shelter)", "count(stop_id)", 3)
DISTRICT_CTES = [
    ("places", f"""
select district, max(pct_with_shelter) as pct_with_shelter, max(w) as avg_wait_time_min, max(s) as avg_satisfaction
from (select district, {_SHELTERED} as pct_with_shelter, null as w, null as s from stops group by district
      union all
      select origin_district, null, {rmean('wait_time_min', 2)}, {rmean('satisfaction_score', 2)} from stg_survey group by origin_district)
group by district"""),
    ("mart_district_ridership", """
select district, trip_date, boarded as total_boardings, served as total_trips_serving, active_routes,
       avg_wait_time_min, avg_satisfaction, pct_with_shelter,
       ifnull(at_peak, 0) as peak_boardings, ifnull(at_weekend, 0) as weekend_boardings, is_rainy_day
from (select district_covered as district, trip_date, sum(total_passengers)::bigint as boarded, sum(total_trips)::bigint as served,
             count(distinct route_id) as active_routes, sum(peak_passengers)::bigint as at_peak,
             sum(weekend_passengers)::bigint as at_weekend, bool_or(is_rainy_day) as is_rainy_day
      from int_daily_ridership group by all) left join places using (district)"""),
]

#: 1-based codes are places in these lists; an unknown or null value has none.
_CODES = {"income_bracket": ["low", "middle", "high"], "destination_type": ["work", "school", "market", "hospital", "mall"],
          "trip_purpose": ["daily_commute", "occasional", "weekend_only"]}
_SURVEY = ["passenger_id", "survey_date", "origin_barangay", "origin_district", "destination_type", "trip_purpose", "primary_route_used",
           "income_bracket", "prefers_aircon", "trips_per_week", "avg_fare_paid_php", "transfers_required", "wait_time_min",
           "satisfaction_score", "travel_time_min", "cluster_id", "cluster_label", "is_ab_test_eligible", "is_likely_underserved"]
#: (score, least wait, least transfers, greatest satisfaction); the highest score that applies counts.
_TIERS = [(1.00, 45, 2, 2), (0.75, 35, 1, 3), (0.50, 25, None, None)]


def _tier(score, wait, transfers, satisfaction) -> str:
    test = f"wait_time_min >= {wait}" + (f" and transfers_required >= {transfers} and satisfaction_score <= {satisfaction}" if transfers is not None else "")
    return f"if(coalesce({test}, false), {score}, 0.25)"


PASSENGER_FEATURES = f"""
select {', '.join(f's.{c}' for c in _SURVEY)},
       {', '.join(f"nullif(list_position({v}, {c}), 0) as {c}_encoded" for c, v in _CODES.items())},
       prefers_aircon::int as prefers_aircon_int, greatest({', '.join(_tier(*t) for t in _TIERS)}) as underserved_severity_score,
       r.route_name as primary_route_name, r.district_covered as primary_route_district, r.base_fare_php as route_base_fare_php, r.route_length_km
from stg_survey s left join routes r on r.route_id = s.primary_route_used"""

_WEIGHTED = "transfers_required * 0.35 + wait_time_min * 0.01 + (6 - satisfaction_score) * 0.30 + travel_time_min * 0.005"
COMMUTER_CLUSTERS = f"""
select * exclude (survey_date, income_bracket_encoded, destination_type_encoded, trip_purpose_encoded, prefers_aircon_int,
                  route_base_fare_php, is_likely_underserved)
       replace (cluster_id = 3 as is_ab_test_eligible, if(cluster_id = 3, round({_WEIGHTED}, 4)::double, null) as underserved_severity_score)
from int_passenger_features where cluster_id is not null"""


def features_ctes(*more):
    return with_clause("routes", "stg_survey", *more, extra=[("int_passenger_features", PASSENGER_FEATURES)])


_LATER = [("p_value", "double"), ("is_significant", "boolean"), ("effect_size", "double"), ("confidence_interval_low", "double"), ("confidence_interval_high", "double")]
AB_RESULTS = f"""
select * replace (simulated_fare_php::double as simulated_fare_php),
       if(is_treatment, 55 - simulated_travel_time_min, null) as estimated_time_saving_min,
       if(is_treatment, simulated_fare_php - 26.00, null)::double as fare_delta_php,
       {', '.join(f'null::{t} as {c}' for c, t in _LATER)}
from (select * exclude (cluster_id) from stg_ab)
     join (select passenger_id, cluster_id, cluster_label, origin_district, income_bracket, underserved_severity_score
           from int_passenger_features where cluster_label = 'Underserved Riders') using (passenger_id)"""

ROUTE_EFFICIENCY = f"""
select route_id, route_name, district_covered,
       cast(sum(total_trips) as bigint) as annual_trips,
       cast(sum(total_passengers) as bigint) as annual_passengers,
       cast(round(sum(cast(total_revenue_php as decimal(18,2))), 2) as double) as annual_revenue_php,
       {rmean('cast(revenue_per_km_php as decimal(18,2))', 2)} as avg_revenue_per_km,
       {rmean('cast(avg_load_factor as decimal(18,3))', 3)} as avg_load_factor,
       {rmean('cast(avg_delay_min as decimal(18,2))', 2)} as avg_delay_min,
       {rmean('cast(on_time_rate as decimal(18,3))', 3)} as avg_on_time_rate,
       {rratio('sum(case when meets_ltfrb_target then 1 else 0 end)', 'count(*)', 3)}
         as pct_days_meeting_ltfrb,
       {rmean('cast(avg_delay_min as decimal(18,2))) filter (where is_rainy_day', 2)}
         as avg_delay_rainy_days,
       {rmean('cast(avg_delay_min as decimal(18,2))) filter (where not is_rainy_day', 2)}
         as avg_delay_dry_days,
       {rmean('distinct_vehicles', 1)} as avg_daily_vehicles,
       {rmean('cast(avg_fleet_age_years as decimal(18,1))', 1)} as avg_fleet_age,
       {rmean('cast(pct_compliant_operators as decimal(18,3))', 3)} as avg_operator_compliance
from mart_route_summary group by route_id, route_name, district_covered"""

CLUSTER_PROFILE = f"""
select cluster_id, cluster_label, count(passenger_id) as passenger_count,
       {rratio('count(passenger_id)', 'sum(count(passenger_id)) over ()', 3)} as pct_of_total,
       {rmean('trips_per_week', 2)} as avg_trips_per_week,
       {rmean('avg_fare_paid_php', 2)} as avg_fare_paid_php,
       {rmean('transfers_required', 2)} as avg_transfers,
       {rmean('wait_time_min', 1)} as avg_wait_min,
       {rmean('travel_time_min', 1)} as avg_travel_min,
       {rmean('satisfaction_score', 2)} as avg_satisfaction,
       {rratio("count(passenger_id) filter (where income_bracket = 'low')", 'count(passenger_id)', 3)}
         as pct_low_income,
       {rratio('count(passenger_id) filter (where prefers_aircon)', 'count(passenger_id)', 3)}
         as pct_prefers_aircon,
       count(passenger_id) filter (where is_ab_test_eligible) as ab_eligible_count,
       {rmean('cast(underserved_severity_score as decimal(18,4))', 4)} as avg_severity_score
from mart_commuter_clusters group by cluster_id, cluster_label"""

SQL = {
    "int_daily_ridership": with_clause("routes", "stg_trips", extra=DAILY_CTES) + "select * from int_daily_ridership",
    "int_route_performance": route_ctes(False) + "select * from int_route_performance",
    "mart_route_summary": route_ctes() + "select * from mart_route_summary",
    "mart_district_ridership": with_clause("routes", "stops", "stg_trips", "stg_survey", extra=DAILY_CTES + DISTRICT_CTES) + "select * from mart_district_ridership",
    "int_passenger_features": features_ctes() + "select * from int_passenger_features",
    "mart_commuter_clusters": with_clause("routes", "stg_survey", extra=[
            ("int_passenger_features", PASSENGER_FEATURES),
            ("mart_commuter_clusters", COMMUTER_CLUSTERS)]) + "select * from mart_commuter_clusters",
    "mart_ab_test_results": with_clause("routes", "stg_survey", "stg_ab", extra=[
            ("int_passenger_features", PASSENGER_FEATURES)]) + AB_RESULTS,
    "route_efficiency": route_ctes() + ROUTE_EFFICIENCY,
    "cluster_profile": with_clause("routes", "stg_survey", extra=[
            ("int_passenger_features", PASSENGER_FEATURES),
            ("mart_commuter_clusters", COMMUTER_CLUSTERS)]) + CLUSTER_PROFILE,
}
