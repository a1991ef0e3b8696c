"""Oracle SQL for the experiment statistics (statistics without p-values)."""

from .models import AB_RESULTS, PASSENGER_FEATURES
from .standin import rnum, rratio, with_clause

EXP = with_clause("routes", "stg_survey", "stg_ab", extra=[
    ("int_passenger_features", PASSENGER_FEATURES),
    ("exp", """select e.*, c.cluster_label, c.origin_district, c.income_bracket
               from stg_ab e left join int_passenger_features c on e.passenger_id = c.passenger_id
               where e.cluster_id = 3""")])

MOMENTS = """
, long as (select "group", 'satisfaction_score' as metric, cast(satisfaction_score as double) as v from exp
           union all select "group", 'simulated_travel_time_min', cast(simulated_travel_time_min as double) from exp),
mom as (select metric, "group", count(v) as n, avg(v) as mean, var_samp(v) as var
        from long where v is not null group by 1, 2),
a as (select c.metric, c.n as n_c, c.mean as m_c, c.var as v_c, t.n as n_t, t.mean as m_t, t.var as v_t
      from mom c join mom t on c.metric = t.metric and c."group" = 'control' and t."group" = 'treatment')
"""

SE2 = "(v_c / n_c + v_t / n_t)"

SQL = {
    "ab_split_balance": EXP + """
, f as (select passenger_id, "group" from (select *, row_number() over (partition by passenger_id
        order by test_week, experiment_record_id) as rn from exp) where rn = 1),
g as (select "group", count(*) as passengers from f group by 1)
select "group", passengers, """ + rnum('passengers * 100.0 / sum(passengers) over ()', 2) + """ as pct,
       """ + rnum('passengers * 100.0 / sum(passengers) over ()', 2) + """ between 40 and 60 as is_balanced
from g""",
    "ab_ttest_moments": EXP + MOMENTS + f"""
select metric, {rnum('m_c', 4)} as control_mean, {rnum('m_t', 4)} as treatment_mean,
       {rnum('m_t - m_c', 4)} as mean_diff,
       {rnum(f'(m_c - m_t) / sqrt({SE2})', 6)} as t_statistic,
       {rnum(f'{SE2} * {SE2} / (pow(v_c / n_c, 2) / (n_c - 1) + pow(v_t / n_t, 2) / (n_t - 1))', 6)} as welch_df,
       {rnum('case when sqrt((v_c + v_t) / 2) = 0 then 0.0 else (m_t - m_c) / sqrt((v_c + v_t) / 2) end', 4)} as effect_size,
       {rnum(f'm_t - m_c - 1.96 * sqrt({SE2})', 4)} as ci_low_95,
       {rnum(f'm_t - m_c + 1.96 * sqrt({SE2})', 4)} as ci_high_95,
       n_c as n_control, n_t as n_treatment
from a""",
    "ab_chi_square_counts": EXP + """
, cells as (select cast(would_use_again as integer) as val, "group", count(*) as o
            from exp where would_use_again is not null group by 1, 2),
ce as (select *, sum(o) over (partition by val) * sum(o) over (partition by "group") / sum(o) over () as e from cells),
t as (select count(distinct val) as n_vals, count(distinct "group") as n_groups,
             sum(pow(greatest(abs(o - e) - 0.5, 0.0), 2) / e) as chi_yates, sum(pow(abs(o - e), 2) / e) as chi_plain,
             sum(case when "group" = 'control' then o * val end) as yes_c,
             sum(case when "group" = 'treatment' then o * val end) as yes_t,
             coalesce(sum(case when "group" = 'control' then o end), 0) as n_control,
             coalesce(sum(case when "group" = 'treatment' then o end), 0) as n_treatment
      from ce)
select 'would_use_again' as metric,
       """ + rnum("case when (n_vals - 1) * (n_groups - 1) = 0 then 0.0 when (n_vals - 1) * (n_groups - 1) = 1 then chi_yates else chi_plain end", 6) + """ as chi2_statistic,
       cast((n_vals - 1) * (n_groups - 1) as integer) as dof,
       """ + rnum('yes_c / n_control', 4) + """ as control_pct_yes,
       """ + rnum('yes_t / n_treatment', 4) + """ as treatment_pct_yes,
       cast(n_control as bigint) as n_control, cast(n_treatment as bigint) as n_treatment
from t""",
    "ab_weekly_band": EXP + f"""
, g as (select test_week, "group", avg(satisfaction_score) as mean, stddev_samp(satisfaction_score) as std,
               count(satisfaction_score) as n from exp group by 1, 2)
select test_week, "group", {rnum('mean', 4)} as mean, {rnum('std', 4)} as std, n,
       {rnum('std / sqrt(n)', 4)} as se, {rnum('mean - 1.96 * std / sqrt(n)', 4)} as ci_low,
       {rnum('mean + 1.96 * std / sqrt(n)', 4)} as ci_high
from g""",
    "ab_lift_by_origin": with_clause("routes", "stg_survey", "stg_ab", extra=[
        ("int_passenger_features", PASSENGER_FEATURES), ("mart_ab", AB_RESULTS)]) + f"""
, p as (select origin_district, avg(satisfaction_score) filter (where "group" = 'control') as control,
               avg(satisfaction_score) filter (where "group" = 'treatment') as treatment
        from mart_ab group by 1)
select origin_district, {rnum('control', 4)} as control, {rnum('treatment', 4)} as treatment,
       {rnum('treatment - control', 4)} as lift
from p where control is not null and treatment is not null""",
    "ab_retention": EXP + f"""
select "group", cast(sum(cast(would_use_again as integer)) as bigint) as yes, count(would_use_again) as n,
       {rratio('sum(cast(would_use_again as integer)) * 100', 'count(would_use_again)', 2)} as pct_yes
from exp group by 1""",
}


# p-values by Simpson's rule over the density from 0 to the statistic
_STEPS = 4000


def _tail(density: str, upper: str) -> str:
    """1 - 2 * integral of a symmetric density (an expression in x) over [0, upper]."""
    return (f"(select 1 - 2 * sum(({density}) * case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end) * ({upper}) / {_STEPS} / 3 "
            f"from (select i, i * ({upper}) / {_STEPS} as x from range(0, {_STEPS + 1}) r(i)))")


_T, _DF = f"((m_c - m_t) / sqrt({SE2}))", f"({SE2} * {SE2} / (pow(v_c / n_c, 2) / (n_c - 1) + pow(v_t / n_t, 2) / (n_t - 1)))"
_STUDENT = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + x * x / df))"
_NORMAL = "exp(-x * x / 2) / sqrt(2 * pi())"
_COUNTS = SQL["ab_chi_square_counts"][len(EXP):]
_CHI = _COUNTS[:_COUNTS.index("select 'would_use_again'")].strip().removeprefix(",").rstrip()
STATISTICS = EXP + MOMENTS + f""", {_CHI},
s as (select *, {_T} as tv, {_DF} as df, m_t - m_c as diff, sqrt({SE2}) as se, sqrt((v_c + v_t) / 2) as pooled from a),
sp as (select *, {_tail(_STUDENT, 'abs(tv)')} as p from s),
c as (select (n_vals - 1) * (n_groups - 1) as dof, case (n_vals - 1) * (n_groups - 1) when 1 then chi_yates else 0.0 end as x2, yes_c, yes_t, n_control, n_treatment from t),
cp as (select *, case when dof = 0 then 1.0 else {_tail(_NORMAL, 'sqrt(x2)')} end as p from c),
statistics as (
  select metric, {rnum('m_c', 4)} as control_mean, {rnum('m_t', 4)} as treatment_mean, {rnum('diff', 4)} as mean_diff, {rnum('tv', 6)} as t_statistic,
    {rnum('p', 6)} as p_value, p < 0.05 as is_significant, {rnum('case when pooled = 0 then 0.0 else diff / pooled end', 4)} as effect_size,
    {rnum('diff - 1.96 * se', 4)} as ci_low_95, {rnum('diff + 1.96 * se', 4)} as ci_high_95, n_c as n_control, n_t as n_treatment,
    null::double as chi2_statistic, null::int as dof, null::double as control_pct_yes, null::double as treatment_pct_yes from sp
  union all
  select 'would_use_again', null, null, null, null, {rnum('p', 6)}, p < 0.05, null, null, null, n_control::bigint, n_treatment::bigint,
    {rnum('x2', 6)}, dof::int, {rnum('yes_c / n_control', 4)}, {rnum('yes_t / n_treatment', 4)} from cp)
"""
SQL["ab_test_statistics"] = STATISTICS + "select * from statistics"
SQL["ab_ci_table"] = STATISTICS + "select metric, mean_diff, ci_low_95, ci_high_95, is_significant from statistics where ci_low_95 is not null"
SQL["ab_verdict"] = STATISTICS + """
select metric, p_value, effect_size, is_significant,
  case when abs(effect_size) < 0.2 then 'negligible' when abs(effect_size) < 0.5 then 'small' when abs(effect_size) < 0.8 then 'medium' else 'large' end as effect_label,
  case when is_significant then printf('Significant improvement (p=%.4f, d=%.3f): recommend route adoption.', p_value, effect_size)
       else printf('No significant improvement at alpha=%.2f (p=%.4f): extend trial or adjust design.', 0.05::double, p_value) end as recommendation
from statistics where metric = 'satisfaction_score'"""
SQL["ab_lift_by_income"] = EXP + f"""
, p as (select income_bracket, avg(satisfaction_score) filter (where "group" = 'control') as control,
               avg(satisfaction_score) filter (where "group" = 'treatment') as treatment from exp group by 1)
select income_bracket, {rnum('control', 4)} as control, {rnum('treatment', 4)} as treatment, {rnum('treatment - control', 4)} as lift
from p where control is not null and treatment is not null"""
SQL["ab_assignment"] = with_clause("stg_survey") + """
select passenger_id, case when row_number() over (order by md5(passenger_id || ':42'), passenger_id) <= (count(*) over ()) // 2
                          then 'treatment' else 'control' end as "group"
from (select distinct passenger_id from stg_survey where cluster_id = 3)"""
SQL["ab_verdict_detail"] = STATISTICS + """
select metric, control_mean, treatment_mean, mean_diff, ci_low_95, ci_high_95, p_value, is_significant,
  case when abs(effect_size) < 0.2 then 'negligible' when abs(effect_size) < 0.5 then 'small' when abs(effect_size) < 0.8 then 'medium' else 'large' end as effect_label,
  case metric when 'simulated_travel_time_min' then mean_diff < 0 else mean_diff > 0 end as favours_treatment
from statistics where metric in ('satisfaction_score', 'simulated_travel_time_min')"""
SQL["ab_statistics_presented"] = STATISTICS + f"""
select case metric when 'satisfaction_score' then 'Satisfaction Score' when 'simulated_travel_time_min' then 'Travel Time (min)' else 'Would Use Again' end as metric,
  case metric when 'would_use_again' then 'Chi-Square' else 'Welch''s t-test' end as test,
  case metric when 'would_use_again' then {rnum('control_pct_yes * 100', 1)} else {rnum('control_mean', 3)} end as control,
  case metric when 'would_use_again' then {rnum('treatment_pct_yes * 100', 1)} else {rnum('treatment_mean', 3)} end as treatment,
  {rnum('coalesce(chi2_statistic, t_statistic)', 3)} as statistic, {rnum('p_value', 4)} as p_value, case when is_significant then 'Yes' else 'No' end as significant,
  case when metric <> 'would_use_again' then case when abs(effect_size) < 0.2 then 'negligible' when abs(effect_size) < 0.5 then 'small' when abs(effect_size) < 0.8 then 'medium' else 'large' end end as effect_label
from statistics"""
