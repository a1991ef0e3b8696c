"""Oracle SQL of the seven landing entities: deliveries, cleaning, rules, parents."""

from .landing import LANDING, LANDING_AB, LANDING_PAX, _pad
from .standin import with_clause

_CUSTOMERS = "(select *, c_custkey as k from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_DAY = "DATE '2024-01-01' as _date"

LANDED = {
    "routes": f"""
select {_pad('R', 'k', 2)} as route_id, n_name as route_name, ' ' || n_name as origin, r_name as destination, r_name as district_covered,
       case when k % 13 = 12 then 'NaN'::double else k + 5 end as route_length_km, k % 7 + 3 as num_stops, case when k % 5 <> 4 then 13 + k % 5 end::double as base_fare_php,
       k % 4 + 5 as peak_frequency_min, case when k % 11 = 10 then 1 else k % 6 + 10 end as off_peak_frequency_min,
       case when k % 6 = 5 then null when k % 9 = 0 then 'False' else ' true' end as is_active, k % 4 as _chunk, {_DAY}
from (select *, n_nationkey::int as k from nation join region on n_regionkey = r_regionkey)""",
    "operators": f"""
with first as (
  select k, {_pad('OPR-', 'k', 3)} as operator_id, c_name as operator_name, {_pad('0917-', 'k', 7)} as contact_number,
         case when k % 67 = 0 then 'syndicate' when k % 3 = 0 then 'individual' when k % 3 = 1 then ' cooperative' else 'corporation' end as franchise_type,
         case when k % 59 = 0 then null when k % 53 = 0 then 0 else (k % 20 + 1)::int end as num_units, r_name as base_district,
         case when k % 61 = 0 then 'maybe' when k % 4 = 0 then null when k % 4 = 1 then 'TRUE' else 'false' end as is_compliant_puv, (k % 4)::int as _chunk, {_DAY}
  from {_CUSTOMERS})
select * exclude (k) from first union all select * exclude (k) replace ('again' as operator_name, DATE '2024-01-08' as _date) from first where k % 10 = 0""",
    "stops": f"""
select {_pad('S', 'k', 3)} as stop_id, c_name as stop_name, n_name as barangay, r_name as district, case when k % 71 = 0 then 9.9 else 6.8::double + (k % 700) / 1000 end::double as latitude,
       (125 + (k % 997) / 1000)::double as longitude,
       case k % 6 when 0 then ' terminal' when 1 then 'market ' when 2 then 'school' when 3 then 'hospital' when 4 then 'mall' else 'residential' end as stop_type,
       case when k % 3 = 0 then null when k % 3 = 1 then 'true' else 'False' end as has_shelter, ((k * 37) % 500)::int as avg_daily_boardings, {_pad('R', 'c_nationkey', 2)} as route_id,
       (k % 4)::int as _chunk, {_DAY}
from {_CUSTOMERS}""",
    "vehicles": f"""
select {_pad('VHC-', 'k', 3)} as vehicle_id, {_pad('DBX-', 'case when k % 40 = 1 then k - 1 else k end', 4)} as plate_number,
       case when k % 4 = 0 then 'modernized_PUV' else 'traditional' end as vehicle_type, case when k % 43 = 7 then null when k % 4 = 0 then 23 else 16 end as capacity,
       case when k % 8 = 0 then 'electric' when k % 8 = 4 then 'euro4_diesel' else 'diesel' end as fuel_type, (2000 + k % 25)::int as year_manufactured, {_pad('R', 's_nationkey', 2)} as route_assigned,
       {_pad('OPR-', 'k // 3', 3)} as operator_id, case when k % 47 = 5 then 'NaN'::double else abs(s_acctbal) end as avg_fuel_cost_daily_php,
       case when k % 5 = 0 then null when k % 10 = 1 then 'false' else 'TRUE' end as is_active, (k % 4)::int as _chunk, {_DAY}
from (select *, s_suppkey as k from supplier)""",
    "trips": f"""
select * replace (case when (substr(trip_id, 5)::bigint // 10) % 1009 = 0 then 'NaN'::double else revenue_php end as revenue_php,
                  is_on_time::varchar as is_on_time, is_rainy_day::varchar as is_rainy_day) from ({LANDING})""",
    "passengers": f"""
select * replace (case when substr(passenger_id, 5)::bigint % 7 = 0 then null when substr(passenger_id, 5)::bigint % 73 = 1 then 'unknown' else prefers_aircon::varchar end as prefers_aircon,
                  case when substr(passenger_id, 5)::bigint % 79 = 2 then '2024-13-01' else survey_date end as survey_date) from ({LANDING_PAX})""",
    "experiment": f"""
select * exclude (k) replace (case when k % 2 = 0 then experiment_id end as experiment_id, would_use_again::varchar as would_use_again),
       case when k % 113 = 0 then 4 else 3 end as cluster_id, (26 + k % 7)::double as simulated_fare_php
from (select *, substr(experiment_record_id, 5)::bigint as k from ({LANDING_AB}))""",
}

#: Columns by entity: t text, n number that may be NaN, i other number, d date, f flag.
COLUMNS = {
    "routes": "route_id:t route_name:t origin:t destination:t district_covered:t route_length_km:n num_stops:i base_fare_php:n peak_frequency_min:i off_peak_frequency_min:i is_active:f",
    "operators": "operator_id:t operator_name:t contact_number:t franchise_type:t num_units:i base_district:t is_compliant_puv:f",
    "stops": "stop_id:t stop_name:t barangay:t district:t latitude:n longitude:n stop_type:t has_shelter:f avg_daily_boardings:i route_id:t",
    "vehicles": "vehicle_id:t plate_number:t vehicle_type:t capacity:i fuel_type:t year_manufactured:i route_assigned:t operator_id:t avg_fuel_cost_daily_php:n is_active:f",
    "trips": "trip_id:t route_id:t vehicle_id:t trip_date:d time_period:t day_of_week:t passengers_boarded:i revenue_php:n travel_time_min:i scheduled_time_min:i delay_min:i is_on_time:f is_rainy_day:f load_factor:n",
    "passengers": "passenger_id:t survey_date:d origin_barangay:t origin_district:t destination_type:t trip_purpose:t primary_route_used:t trips_per_week:i avg_fare_paid_php:n transfers_required:i "
                  "wait_time_min:i travel_time_min:i satisfaction_score:i income_bracket:t prefers_aircon:f",
    "experiment": "experiment_record_id:t experiment_id:t passenger_id:t cluster_id:i group:t route_variant:t test_week:i simulated_travel_time_min:n simulated_fare_php:n transfers_needed:i satisfaction_score:i would_use_again:f",
}
DEFAULTS = {"base_fare_php": "13", "is_active": "true", "is_compliant_puv": "true", "has_shelter": "false", "delay_min": "0", "is_rainy_day": "false", "prefers_aircon": "false", "experiment_id": "'EXP-001'"}
PARENTS = {"stops": [("route_id", "routes", "route_id")], "vehicles": [("route_assigned", "routes", "route_id"), ("operator_id", "operators", "operator_id")],
           "trips": [("route_id", "routes", "route_id"), ("vehicle_id", "vehicles", "vehicle_id")], "passengers": [("primary_route_used", "routes", "route_id")],
           "experiment": [("passenger_id", "passengers", "passenger_id")]}
#: What a valid row must not be, besides missing and unreadable values: rule and violation.
BROKEN = {
    "routes": [("route_length_km_range", "route_length_km <= 0 or route_length_km > 200"), ("num_stops_range", "num_stops not between 1 and 100"), ("base_fare_php_range", "base_fare_php < 13"),
               ("headway_order", "off_peak_frequency_min < peak_frequency_min")],
    "operators": [("franchise_type_enum", "franchise_type not in ('individual', 'cooperative', 'corporation')"), ("num_units_range", "num_units not between 1 and 100")],
    "stops": [("latitude_range", "latitude not between 6.8 and 7.5"), ("longitude_range", "longitude not between 125 and 126"),
              ("stop_type_enum", "stop_type not in ('terminal', 'market', 'school', 'hospital', 'mall', 'residential')")],
    "vehicles": [("capacity_range", "capacity not between 10 and 30"), ("avg_fuel_cost_daily_php_range", "avg_fuel_cost_daily_php <= 0"), ("year_manufactured_range", "year_manufactured not between 2000 and 2025"),
                 ("plate_number_length", "length(plate_number) not between 5 and 15")],
    "trips": [("passengers_boarded_range", "passengers_boarded not between 1 and 50"), ("revenue_php_range", "revenue_php < 0"), ("load_factor_range", "load_factor not between 0 and 1.5"),
              ("on_time_implies_small_delay", "is_on_time and delay_min > 5")],
    "passengers": [("trips_per_week_range", "trips_per_week not between 0 and 14"), ("avg_fare_paid_php_range", "avg_fare_paid_php <= 0"), ("transfers_required_range", "transfers_required not between 0 and 3")],
    "experiment": [("cluster_id_range", "cluster_id <> 3"), ("simulated_travel_time_min_range", "simulated_travel_time_min <= 0"), ("test_week_range", "test_week not between 1 and 8"),
                   ("group_variant_alignment", "(\"group\" = 'control') <> (route_variant = 'A_current')")],
}
ORDER = {"routes": "route_name", "operators": "operator_name", "stops": "stop_name", "vehicles": "plate_number",
         "trips": "time_period, day_of_week, passengers_boarded, revenue_php, load_factor, is_rainy_day, route_id, vehicle_id",
         "passengers": "survey_date, origin_district, satisfaction_score", "experiment": "test_week, satisfaction_score, simulated_travel_time_min"}


def _columns(e: str) -> list[tuple[str, str]]:
    return [(f'"{n}"' if n == "group" else n, k) for n, k in (c.split(":") for c in COLUMNS[e].split())]


def _cleaned(e: str) -> str:
    out = []
    for n, k in _columns(e):
        v = {"t": f"nullif(trim({n}), '')", "n": f"case when not isnan({n}) then {n} end", "i": n, "d": f"try_cast(nullif(trim({n}), '') as date)", "f": f"try_cast(nullif(trim({n}), '') as boolean)"}[k]
        if k in "df":
            out.append(f"nullif(trim({n}), '') is not null and {v} is null as _bad_{n}")
        if n in DEFAULTS:
            missing = f"nullif(trim({n}), '') is null" if k in "tdf" else f"{v} is null"
            v = f"case when {missing} then {DEFAULTS[n]} else {v} end"
        out.append(f"{v} as {n}")
    for fk, parent, pk in PARENTS.get(e, []):
        out.append(f"exists (select 1 from w_{parent} p where p.{pk} = nullif(trim(l.{fk}), '')) as _known_{fk}")
    data = ", ".join(n for n, _ in _columns(e))
    return f"select {', '.join(out)}, _date, _chunk from (select {data}, min(_date) as _date, min(_chunk) as _chunk from l_{e} group by all) l"


def violations(e: str) -> list[tuple[str, str]]:
    out = [(f"{n}_type".replace('"', ""), f"_bad_{n}") for n, k in _columns(e) if k in "df"]
    out += [(f"{n}_present".replace('"', ""), f"{n} is null" + (f" and not _bad_{n}" if k in "df" else "")) for n, k in _columns(e)]
    return out + BROKEN[e] + [(f"{fk}_known", f"{fk} is not null and not _known_{fk}") for fk, _, _ in PARENTS.get(e, [])]


ENTITIES = ["routes", "operators", "stops", "vehicles", "trips", "passengers", "experiment"]
_CTES: list[tuple[str, str]] = []
for _e in ENTITIES:
    _key = _columns(_e)[0][0]
    _data = ", ".join(n for n, _ in _columns(_e))
    _bad = " or ".join(f"coalesce({p}, false)" for _, p in violations(_e))
    _first = f"select {_data}, _date, _chunk from c_{_e} where not ({_bad}) qualify row_number() over (partition by {_key} order by _date, _chunk, {ORDER[_e]}) = 1"
    _CTES += [(f"l_{_e}", LANDED[_e]), (f"c_{_e}", _cleaned(_e)), (f"f_{_e}", _first)]
    _CTES.append((f"w_{_e}", f"select * from f_{_e}" + (" qualify row_number() over (partition by plate_number order by _date, _chunk, vehicle_id) = 1" if _e == "vehicles" else "")))

_WITH = with_clause("survey", extra=_CTES)
SQL = {f"load_{e}": _WITH + f"select {', '.join(n for n, _ in _columns(e))} from w_{e}" for e in ENTITIES}
SQL["load_quarantine"] = _WITH + "select * from (" + " union all ".join(
    [f"select '{e}' as entity, '{rule}' as rule, count(*) filter (where {p}) as failures from c_{e}" for e in ENTITIES for rule, p in violations(e)]
    + ["select 'vehicles', 'plate_number_unique', (select count(*) from f_vehicles) - (select count(*) from w_vehicles)"]) + ") where failures > 0"
