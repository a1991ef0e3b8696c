"""Stand-in entity views as DuckDB SQL (mirror of routewise.sources.standin)."""

ENTITIES = {
    "routes": """
select n_nationkey as route_id, n_name as route_name, n_name as origin, r_name as destination,
       r_name as district_covered, n_nationkey + 5 as route_length_km,
       n_nationkey % 7 + 3 as num_stops, n_nationkey % 5 + 13 as base_fare_php,
       n_nationkey % 4 + 5 as peak_frequency_min, n_nationkey % 6 + 10 as off_peak_frequency_min,
       n_nationkey % 9 <> 0 as is_active
from nation join region on n_regionkey = r_regionkey""",
    "vehicles": """
select s_suppkey as vehicle_id, s_name as plate_number,
       case when s_suppkey % 4 = 0 then 'modernized_PUV' else 'traditional' end as vehicle_type,
       case when s_suppkey % 4 = 0 then 23 else 16 end as capacity,
       case when s_suppkey % 8 = 0 then 'electric' when s_suppkey % 8 = 4 then 'euro4_diesel'
            else 'diesel' end as fuel_type,
       2000 + s_suppkey % 25 as year_manufactured,
       s_nationkey as route_assigned, s_suppkey // 3 as operator_id,
       cast(abs(s_acctbal) as decimal(12,2)) as avg_fuel_cost_daily_php,
       s_suppkey % 10 <> 0 as is_active
from supplier""",
    "operators": """
select c_custkey as operator_id, c_name as operator_name, c_mktsegment as franchise_type,
       c_custkey % 20 + 1 as num_units, c_acctbal > 0 as is_compliant_puv
from customer""",
    "trips": """
select l_orderkey * 10 + l_linenumber as trip_id, s_nationkey as route_id, l_suppkey as vehicle_id,
       cast(l_shipdate as date) as trip_date,
       case when l_returnflag = 'A' then 'AM_peak'
            when l_returnflag = 'N' and l_linestatus = 'O' then 'PM_peak'
            when l_returnflag = 'N' then 'off_peak' else 'midday' end as time_period,
       dayname(l_shipdate) as day_of_week,
       cast(l_quantity as integer) as passengers_boarded,
       cast(l_extendedprice as decimal(12,2)) as revenue_php,
       30 + 2 * l_linenumber as travel_time_min, 30 as scheduled_time_min,
       2 * l_linenumber as delay_min, 2 * l_linenumber <= 5 as is_on_time,
       l_linestatus = 'F' as is_rainy_day,
       cast(l_quantity * 0.03 as decimal(4,3)) as load_factor
from lineitem join supplier on l_suppkey = s_suppkey""",
    "stops": """
select c_custkey as stop_id, c_name as stop_name, n_name as barangay, r_name as district,
       case c_custkey % 6 when 0 then 'terminal' when 1 then 'market' when 2 then 'school'
            when 3 then 'hospital' when 4 then 'mall' else 'residential' end as stop_type,
       c_acctbal >= 0 as has_shelter, (c_custkey * 37) % 500 as avg_daily_boardings,
       c_nationkey as route_id,
       cast(6.8 + (c_custkey % 700) * 0.001 as decimal(9,6)) as latitude,
       cast(125 + (c_custkey % 997) * 0.001 as decimal(9,6)) as longitude,
       cast(c_nationkey as varchar) || ',' || cast((c_nationkey + 1) % 25 as varchar) as routes_served
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "survey": """
select c_custkey as passenger_id,
       DATE '2024-01-01' + cast(c_custkey % 366 as integer) as survey_date,
       n_name as origin_barangay, r_name as origin_district,
       case c_custkey % 5 when 0 then 'work' when 1 then 'school' when 2 then 'market'
            when 3 then 'hospital' else 'mall' end as destination_type,
       case c_custkey % 3 when 0 then 'daily_commute' when 1 then 'occasional'
            else 'weekend_only' end as trip_purpose,
       c_nationkey as primary_route_used,
       least(coalesce(n_orders, 0), 14) as trips_per_week,
       13 + c_custkey % 20 as avg_fare_paid_php, c_custkey % 4 as transfers_required,
       5 + (c_custkey * 7) % 50 as wait_time_min, 15 + (c_custkey * 11) % 70 as travel_time_min,
       1 + (c_custkey * 3) % 5 as satisfaction_score,
       case c_custkey % 3 when 0 then 'low' when 1 then 'middle' else 'high' end as income_bracket,
       c_custkey % 2 = 0 as prefers_aircon,
       c_custkey % 5 as cluster_id,
       case c_custkey % 5 when 0 then 'Student Commuters' when 1 then 'Market Workers'
            when 2 then 'CBD Workers' when 3 then 'Underserved Riders'
            else 'Occasional Riders' end as cluster_label
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join (select o_custkey, count(*) as n_orders from orders group by o_custkey) o
  on o_custkey = c_custkey""",
    "ab_experiment": """
select event_id as experiment_record_id, 'EXP-001' as experiment_id, user_id as passenger_id,
       3 as cluster_id,
       case when user_id % 2 <> 0 then 'treatment' else 'control' end as "group",
       case when user_id % 2 <> 0 then 'B_express' else 'A_current' end as route_variant,
       1 + event_id % 8 as test_week, value as simulated_travel_time_min,
       cast(26 + event_id % 7 as decimal(6,2)) as simulated_fare_php,
       event_id % 4 as transfers_needed, 1 + event_id % 5 as satisfaction_score,
       event_type in ('purchase', 'click') as would_use_again
from events""",
}

# Staging views on top of the entities (P01-P09), as DuckDB SQL.
STAGING = {
    "stg_trips": """
select *, coalesce(time_period in ('AM_peak', 'PM_peak'), false) as is_peak,
       coalesce(day_of_week in ('Saturday', 'Sunday'), false) as is_weekend,
       coalesce(load_factor > 1.0, false) as is_overcrowded
from trips""",
    "stg_vehicles": """
select *, 2025 - year_manufactured as vehicle_age_years from vehicles""",
    "stg_survey": """
select *, coalesce(cluster_id = 3, false) as is_ab_test_eligible,
       coalesce(transfers_required >= 2 and wait_time_min >= 25 and satisfaction_score <= 2, false)
         as is_likely_underserved
from survey""",
    "stg_ab": """
select *, case when test_week <= 4 then 'ramp_up' else 'main' end as experiment_phase,
       ("group" = 'treatment') as is_treatment
from ab_experiment""",
}

DEPENDS = {
    "stg_trips": ["trips"], "stg_vehicles": ["vehicles"], "stg_survey": ["survey"],
    "stg_ab": ["ab_experiment"],
}


def with_clause(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding the named entities/staging views (dependencies first)
    followed by ``extra`` (name, sql) CTEs in order."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = []
    for n in order:
        body = ENTITIES.get(n) or STAGING[n]
        parts.append(f"{n} as ({body}\n)")
    for n, body in extra or []:
        parts.append(f"{n} as ({body}\n)")
    return "with " + ",\n".join(parts) + "\n"


def rmean(expr: str, n: int) -> str:
    """DuckDB spelling of Postgres ``round(avg(x), n)`` (exact, half-up), as double."""
    return f"cast(round(cast(avg({expr}) as decimal(38,10)), {n}) as double)"


def rratio(num: str, den: str, n: int) -> str:
    """``round(num / nullif(den, 0), n)`` half-up, as double."""
    return f"cast(round(cast(({num})::double / nullif({den}, 0) as decimal(38,9)), {n}) as double)"


def rnum(expr: str, n: int) -> str:
    """Half-up rounding of a double expression, as double."""
    return f"cast(round(cast({expr} as decimal(38,10)), {n}) as double)"
