"""Known-answer tests for the experiment statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import Row

from routewise.functions.stats import betainc_reg, chi2_sf, t_sf_two_sided
from routewise.plans import experiment as X


def test_chi2_critical_values():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(0.0, 0) == 1.0


def test_t_critical_values():
    assert t_sf_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_sf_two_sided(12.706204736174703, 1) == pytest.approx(0.05, abs=1e-12)
    assert t_sf_two_sided(0.0, 7) == pytest.approx(1.0)
    # large df -> normal
    assert t_sf_two_sided(1.959963984540054, 1e6) == pytest.approx(0.05, abs=1e-6)


def test_betainc_symmetry():
    for a, b, x in [(2.0, 3.0, 0.3), (0.5, 7.5, 0.8), (10.0, 0.5, 0.95)]:
        assert betainc_reg(a, b, x) + betainc_reg(b, a, 1 - x) == pytest.approx(1.0, abs=1e-12)


def _ab(spark, c_scores, t_scores, c_again, t_again):
    rows = [Row(group="control", satisfaction_score=s, simulated_travel_time_min=50.0 + s,
                would_use_again=a, test_week=1, experiment_record_id=i, passenger_id=i)
            for i, (s, a) in enumerate(zip(c_scores, c_again))]
    rows += [Row(group="treatment", satisfaction_score=s, simulated_travel_time_min=30.0 + s,
                 would_use_again=a, test_week=1, experiment_record_id=100 + i, passenger_id=100 + i)
             for i, (s, a) in enumerate(zip(t_scores, t_again))]
    return spark.createDataFrame(rows)


def test_welch_t_matches_numpy(spark):
    c = [2, 1, 3, 2, 2, 3, 1, 2]
    t = [4, 3, 5, 4, 3, 4, 5]
    ab = _ab(spark, c, t, [True] * 8, [True] * 7)
    r = {x.metric: x for x in X.ttests(ab).collect()}["satisfaction_score"]
    a, b = np.array(c, float), np.array(t, float)
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    tt = (a.mean() - b.mean()) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    assert r.t_statistic == pytest.approx(round(tt, 6))
    assert r.p_value == pytest.approx(round(t_sf_two_sided(tt, df), 6))
    d = (b.mean() - a.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert r.effect_size == pytest.approx(round(d, 4))
    assert r.ci_low_95 == pytest.approx(round(b.mean() - a.mean() - 1.96 * math.sqrt(va + vb), 4))
    assert r.n_control == 8 and r.n_treatment == 7


def test_chi_square_yates(spark):
    c_again = [True] * 9 + [False] * 11
    t_again = [True] * 16 + [False] * 4
    ab = _ab(spark, [3] * 20, [3] * 20, c_again, t_again)
    r = X.chi_square(ab).collect()[0]
    obs = np.array([[11, 4], [9, 16]], float)  # rows: value 0/1, cols: control/treatment
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    stat = (np.maximum(np.abs(obs - exp) - 0.5, 0) ** 2 / exp).sum()
    assert r.dof == 1
    assert r.chi2_statistic == pytest.approx(round(stat, 6))
    assert r.p_value == pytest.approx(round(math.erfc(math.sqrt(stat / 2)), 6))
    assert r.control_pct_yes == pytest.approx(0.45)


def test_chi_square_single_value_table(spark):
    ab = _ab(spark, [3] * 5, [3] * 5, [True] * 5, [True] * 5)
    r = X.chi_square(ab).collect()[0]
    assert r.dof == 0 and r.chi2_statistic == 0.0 and r.p_value == 1.0


def test_exact_half_assignment(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "passenger_id")
    a = X.assign_groups(df, partitions=5)
    counts = {r.group: r["count"] for r in a.groupBy("group").count().collect()}
    assert counts == {"treatment": 500, "control": 501}
    again = X.assign_groups(df.repartition(3), partitions=7)
    assert a.join(again, ["passenger_id", "group"]).count() == 1001
