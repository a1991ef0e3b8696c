"""A/B experiment statistics (T01-T16) as distributed aggregations.

Every test reduces the experiment rows to (metric, group) moments in one
pass (metrics unpivoted, partial aggregation map-side); t statistic,
Welch-Satterthwaite df, Cohen's d and the CI are Column expressions on those
few rows; only the p-values go through a pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.stats import chi2_pvalue, t_pvalue
from ..session import ensure_checkpoint_dir
from ..sources.standin import Entities
from . import intermediate as I
from . import staging as S

T_METRICS = ["satisfaction_score", "simulated_travel_time_min"]
CHI_METRIC = "would_use_again"


def experiment_rows(E: Entities) -> DataFrame:
    """Experiment rows of cluster 3 as generated; the statistics need no more."""
    return S.stg_ab_experiment(E).filter(F.col("cluster_id") == K.UNDERSERVED_CLUSTER)


def experiment_data(E: Entities, features: DataFrame | None = None) -> DataFrame:
    """Experiment rows left-joined to the passenger profile (label, origin,
    income), for figures by segment."""
    f = features if features is not None else I.int_passenger_features(E)
    prof = f.select("passenger_id", "cluster_label", "origin_district", "income_bracket")
    return experiment_rows(E).join(prof, "passenger_id", "left")


def split_balance(ab: DataFrame) -> DataFrame:
    """Distinct passengers per group and share; flag outside 40-60 %.
    (A passenger's first-seen group, as ``drop_duplicates`` keeps.)"""
    first = ab.groupBy("passenger_id").agg(
        F.min_by("group", F.struct("test_week", "experiment_record_id")).alias("group"))
    g = first.groupBy("group").agg(F.count(F.lit(1)).alias("passengers"))
    g = g.withColumn("pct", F.round(F.col("passengers") * 100.0 / F.sum("passengers").over(Window.partitionBy()), 2))
    lo, hi = K.SPLIT_BALANCE_PCT
    return g.withColumn("is_balanced", (F.col("pct") >= lo) & (F.col("pct") <= hi))


def _arms(ab: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric with both arms' n, mean and sample variance, from
    a single aggregation over the unpivoted rows (no join of the arms)."""
    long = ab.select("group", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
        .alias("mv")).select("group", "mv.metric", "mv.v").filter(F.col("v").isNotNull())
    aggs = []
    for g, sfx in (("control", "c"), ("treatment", "t")):
        v = F.when(F.col("group") == g, F.col("v"))
        aggs += [F.count(v).alias(f"n_{sfx}"), F.avg(v).alias(f"m_{sfx}"), F.var_samp(v).alias(f"v_{sfx}")]
    return long.groupBy("metric").agg(*aggs)


def ttest_moments(ab: DataFrame, metrics: list[str] = T_METRICS) -> DataFrame:
    """T03-T06 without the p-value: Welch t (control - treatment),
    Welch-Satterthwaite df, Cohen's d (treatment - control, pooled
    sqrt((s1^2+s2^2)/2), zero -> 0) and the 1.96 CI of the difference."""
    a = _arms(ab, metrics)
    se2 = F.col("v_c") / F.col("n_c") + F.col("v_t") / F.col("n_t")
    se = F.sqrt(se2)
    diff = F.col("m_t") - F.col("m_c")
    pooled = F.sqrt((F.col("v_c") + F.col("v_t")) / 2)
    wdf = se2 * se2 / ((F.col("v_c") / F.col("n_c")) ** 2 / (F.col("n_c") - 1)
                       + (F.col("v_t") / F.col("n_t")) ** 2 / (F.col("n_t") - 1))
    return a.select(
        "metric",
        F.round("m_c", 4).alias("control_mean"), F.round("m_t", 4).alias("treatment_mean"),
        F.round(diff, 4).alias("mean_diff"),
        F.round((F.col("m_c") - F.col("m_t")) / se, 6).alias("t_statistic"),
        F.round(wdf, 6).alias("welch_df"),
        F.round(F.when(pooled == 0, F.lit(0.0)).otherwise(diff / pooled), 4).alias("effect_size"),
        F.round(diff - K.Z_95 * se, 4).alias("ci_low_95"),
        F.round(diff + K.Z_95 * se, 4).alias("ci_high_95"),
        F.col("n_c").alias("n_control"), F.col("n_t").alias("n_treatment"),
        ((F.col("m_c") - F.col("m_t")) / se).alias("_t"), wdf.alias("_df"))


def ttests(ab: DataFrame, metrics: list[str] = T_METRICS) -> DataFrame:
    """The t-test result rows with p-value and significance
    (on the unrounded p)."""
    m = ttest_moments(ab, metrics).withColumn("_p", t_pvalue(F.col("_t"), F.col("_df")))
    return m.select(
        "metric", "control_mean", "treatment_mean", "mean_diff", "t_statistic",
        F.round("_p", 6).alias("p_value"), (F.col("_p") < K.ALPHA).alias("is_significant"),
        "effect_size", "ci_low_95", "ci_high_95", "n_control", "n_treatment")


def chi_square_counts(ab: DataFrame, metric: str = CHI_METRIC) -> DataFrame:
    """T07 without the p-value, from one aggregation: the 2x2 crosstab
    (A14) of value x group as four conditional counts; margins, expected
    counts and the Yates-corrected statistic are column expressions.  Like a
    crosstab, only values and groups that occur form the table, so a single
    observed value gives a 1x2 table: dof 0, statistic 0."""
    v = F.col(metric).cast("int")
    is_c, is_t = F.col("group") == "control", F.col("group") == "treatment"
    nn = F.col(metric).isNotNull()
    cells = {"c0": is_c & (v == 0), "c1": is_c & (v == 1), "t0": is_t & (v == 0), "t1": is_t & (v == 1)}
    a = ab.agg(*[C.count_if(cond & nn).alias(k) for k, cond in cells.items()])
    o = {k: F.col(k).cast("double") for k in cells}
    row0, row1 = o["c0"] + o["t0"], o["c1"] + o["t1"]
    colc, colt = o["c0"] + o["c1"], o["t0"] + o["t1"]
    n = row0 + row1
    n_vals = (row0 > 0).cast("int") + (row1 > 0).cast("int")
    n_groups = (colc > 0).cast("int") + (colt > 0).cast("int")
    dof = (n_vals - 1) * (n_groups - 1)

    def term(obs, r, c):
        e = r * c / n
        return F.pow(F.greatest(F.abs(obs - e) - 0.5, F.lit(0.0)), 2) / e

    yates = (term(o["c0"], row0, colc) + term(o["t0"], row0, colt)
             + term(o["c1"], row1, colc) + term(o["t1"], row1, colt))
    stat = F.when(dof == 1, yates).otherwise(F.lit(0.0))
    return a.select(
        F.lit(metric).alias("metric"), F.round(stat, 6).alias("chi2_statistic"),
        dof.cast("int").alias("dof"),
        F.round(o["c1"] / colc, 4).alias("control_pct_yes"),
        F.round(o["t1"] / colt, 4).alias("treatment_pct_yes"),
        (F.col("c0") + F.col("c1")).alias("n_control"), (F.col("t0") + F.col("t1")).alias("n_treatment"),
        stat.alias("_x"))


def chi_square(ab: DataFrame, metric: str = CHI_METRIC) -> DataFrame:
    """With p-value and significance."""
    c = chi_square_counts(ab, metric).withColumn("_p", chi2_pvalue(F.col("_x"), F.col("dof")))
    return c.select("metric", "chi2_statistic", F.round("_p", 6).alias("p_value"), "dof",
                    (F.col("_p") < K.ALPHA).alias("is_significant"), "control_pct_yes",
                    "treatment_pct_yes", "n_control", "n_treatment")


def statistics_table(ab: DataFrame) -> DataFrame:
    """One row per metric; t-test and chi-square columns unioned,
    missing ones NULL."""
    return ttests(ab).unionByName(chi_square(ab), allowMissingColumns=True)


def weekly_band(ab: DataFrame, metric: str = "satisfaction_score") -> DataFrame:
    """Weekly mean, std, n, SE and 1.96 CI band per group."""
    g = ab.groupBy("test_week", "group").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))
    se = F.col("std") / F.sqrt("n")
    return g.select("test_week", "group", F.round("mean", 4).alias("mean"),
                    F.round("std", 4).alias("std"), "n", F.round(se, 4).alias("se"),
                    F.round(F.col("mean") - K.Z_95 * se, 4).alias("ci_low"),
                    F.round(F.col("mean") + K.Z_95 * se, 4).alias("ci_high"))


def lift_by(ab: DataFrame, by: str = "origin_district", metric: str = "satisfaction_score") -> DataFrame:
    """Treatment - control mean per segment; segments missing an arm
    are dropped; descending."""
    p = ab.groupBy(by).pivot("group", K.AB_GROUPS).agg(F.avg(metric))
    return (p.filter(F.col("control").isNotNull() & F.col("treatment").isNotNull())
             .select(by, F.round("control", 4).alias("control"),
                     F.round("treatment", 4).alias("treatment"),
                     F.round(F.col("treatment") - F.col("control"), 4).alias("lift"))
             .orderBy(F.desc("lift"), by))


def retention(ab: DataFrame) -> DataFrame:
    """Would-use-again yes count, n and percentage per group."""
    return ab.groupBy("group").agg(
        F.sum(F.col("would_use_again").cast("int")).alias("yes"),
        F.count("would_use_again").alias("n")).withColumn(
        "pct_yes", C.safe_ratio(F.col("yes") * 100, "n", 2))


def verdict(stats: DataFrame, primary: str = "satisfaction_score") -> DataFrame:
    """Effect label and recommendation from the primary metric."""
    s = stats.filter(F.col("metric") == primary)
    return s.select(
        "metric", "p_value", "effect_size", "is_significant",
        C.effect_label("effect_size").alias("effect_label"),
        F.when(F.col("is_significant"), F.format_string(
            "Significant improvement (p=%.4f, d=%.3f): recommend route adoption.",
            F.col("p_value"), F.col("effect_size")))
         .otherwise(F.format_string(
            "No significant improvement at alpha=%.2f (p=%.4f): extend trial or adjust design.",
            F.lit(K.ALPHA), F.col("p_value"))).alias("recommendation"))


METRIC_LABELS = {"satisfaction_score": "Satisfaction Score", "simulated_travel_time_min": "Travel Time (min)", "would_use_again": "Would Use Again"}


def presentation(stats: DataFrame) -> DataFrame:
    """The statistics as they are shown: one row per metric with its test, both arms
    (means, or percent of yes), the statistic, p, and the size of the effect of means."""
    share = F.col("metric") == CHI_METRIC
    arm = lambda g: F.when(share, F.round(F.col(f"{g}_pct_yes") * 100, 1)).otherwise(F.round(f"{g}_mean", 3))
    return stats.select(
        C.map_value("metric", METRIC_LABELS).alias("metric"), F.when(share, "Chi-Square").otherwise("Welch's t-test").alias("test"), arm("control").alias("control"), arm("treatment").alias("treatment"),
        F.round(F.coalesce("chi2_statistic", "t_statistic"), 3).alias("statistic"), F.round("p_value", 4).alias("p_value"), F.when(F.col("is_significant"), "Yes").otherwise("No").alias("significant"),
        F.when(~share, C.effect_label("effect_size")).alias("effect_label"))


def verdict_detail(stats: DataFrame) -> DataFrame:
    """The compared means behind the verdict, for the score and the travel time."""
    return stats.filter(F.col("metric").isin(T_METRICS)).select(
        "metric", "control_mean", "treatment_mean", "mean_diff", "ci_low_95", "ci_high_95", "p_value", "is_significant", C.effect_label("effect_size").alias("effect_label"),
        F.when(F.col("metric") == "simulated_travel_time_min", F.col("mean_diff") < 0).otherwise(F.col("mean_diff") > 0).alias("favours_treatment"))


def ci_table(stats: DataFrame) -> DataFrame:
    """The CI presentation shape (t-test metrics only)."""
    return stats.filter(F.col("ci_low_95").isNotNull()).select(
        "metric", "mean_diff", "ci_low_95", "ci_high_95", "is_significant")


def assign_groups(passengers: DataFrame, key: str = "passenger_id", seed: int = K.RANDOM_STATE,
                  partitions: int | None = None) -> DataFrame:
    """Exact 50/50 assignment fixed per passenger, without a global
    single-partition window.

    Rows are range-partitioned by a seeded hash (distributed sort); each
    partition numbers its rows locally; partition offsets are a prefix sum of
    per-partition counts (one row per partition reaches the driver).  The
    first floor(n/2) positions of the global hash order are treatment."""
    ensure_checkpoint_dir(passengers.sparkSession)
    ids = passengers.select(key).distinct().withColumn("_h", F.md5(F.concat_ws(":", key, F.lit(seed))))
    n_parts = partitions or int(passengers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (ids.repartitionByRange(n_parts, "_h", key).sortWithinPartitions("_h", key)
                 .withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)  # pin partition ids for the two uses below
    counts = ranged.groupBy("_pid").count().orderBy("_pid").collect()
    offs, run = [], 0
    for r in counts:
        offs.append((r["_pid"], run))
        run += r["count"]
    half = run // 2
    off_df = passengers.sparkSession.createDataFrame(offs, "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy("_h", key)
    pos = ranged.join(F.broadcast(off_df), "_pid").withColumn(
        "_pos", F.col("_off") + F.row_number().over(w) - 1)
    return pos.select(key, F.when(F.col("_pos") < half, "treatment").otherwise("control").alias("group"))
