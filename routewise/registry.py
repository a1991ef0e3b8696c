"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import clustering as CL
from .operators import quality as QO
from .operators import ranking as R
from .operators import reshape as RS
from .operators import validation as V
from .plans import analyses as A
from .plans import audits as AU
from .plans import dashboards as D
from .plans import experiment as X
from .plans import intermediate as I
from .plans import marts as M
from .plans import quality_suite as Q
from .plans import segmentation as G
from .plans import staging as S
from .session import scratch_path
from .sources import landing as L
from .sources.constraints import SPECS, ancestors, load
from .sources.deliveries import landed
from .sources.keyed import load_in_deliveries
from .sources.months import recent_by_month, write_by_month
from .sources.standin import Entities
from .sources.tables import query_parquet
from .streaming.incremental import run_trip_ingest


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _ents(fn):
    return lambda spark, sf_dir: fn(Entities(spark, sf_dir))


REGISTRY.update({
    "int_daily_ridership": _ents(I.int_daily_ridership),
    "int_route_performance": _ents(I.int_route_performance),
    "mart_route_summary": _ents(M.mart_route_summary),
    "mart_district_ridership": _ents(M.mart_district_ridership),
    "int_passenger_features": _ents(I.int_passenger_features),
    "mart_commuter_clusters": _ents(M.mart_commuter_clusters),
    "mart_ab_test_results": _ents(M.mart_ab_test_results),
    "route_efficiency": _ents(A.route_efficiency),
    "cluster_profile": _ents(A.cluster_profile),
})


# -- dashboard queries ---------------------------------------------------------


def _q(build):
    """Wrap ``build(E)`` as a registered query."""
    return lambda spark, sf_dir: build(Entities(spark, sf_dir))


_summary = M.mart_route_summary
_district = M.mart_district_ridership
_clusters = M.mart_commuter_clusters
_ab = M.mart_ab_test_results

REGISTRY.update({
    "route_summary_recent": _q(lambda E: D.recent(_summary(E))),
    "district_ridership_recent": _q(lambda E: D.recent(_district(E))),
    "home_kpis": _q(lambda E: D.home_kpis(_clusters(E))),
    "top_routes_by_riders": _q(lambda E: D.top_routes(D.recent(_summary(E)), 12)),
    "top5_route_series": _q(lambda E: D.top_route_series(D.recent(_summary(E)), 5)),
    "boardings_by_district": _q(lambda E: D.boardings_by_district(D.recent(_district(E)))),
    "cluster_kpis": _q(lambda E: D.cluster_kpis(_clusters(E), purposes=["daily_commute", "occasional"])),
    "cluster_counts": _q(lambda E: D.cluster_counts(_clusters(E))),
    "cluster_comparison": _q(lambda E: D.cluster_comparison(_clusters(E), 0, 3)),
    "cluster_cards": _q(lambda E: D.cluster_cards(_clusters(E))),
    "cluster_top_districts": _q(lambda E: D.cluster_top_districts(_clusters(E), 5)),
    "cluster_deviation": _q(lambda E: D.cluster_deviation(_clusters(E))),
    "cluster_radar": _q(lambda E: D.cluster_radar(_clusters(E))),
    "trend_kpis": _q(lambda E: D.trend_kpis(_summary(E))),
    "route_rolling_series": _q(lambda E: D.route_rolling_series(_summary(E), 3)),
    "revenue_series": _q(lambda E: D.revenue_series(_summary(E), 3)),
    "route_weekday_heatmap": _q(lambda E: D.route_weekday_heatmap(_summary(E))),
    "district_series": _q(lambda E: D.district_series(_district(E))),
    "top_bottom_routes": _q(lambda E: D.top_bottom_routes(_summary(E), S.stg_routes(E), 5)),
    "district_satisfaction_map": _q(lambda E: D.district_satisfaction_map(
        S.stg_passenger_survey(E), S.stg_stops(E))),
    "route_stop_stats": _q(lambda E: D.route_stop_stats(S.stg_stops(E), S.stg_routes(E))),
    "stop_table": _q(lambda E: D.stop_table(S.stg_stops(E))),
    "bi_daily_riders_by_route": _q(lambda E: D.bi_daily_riders_by_route(_summary(E))),
    "bi_load_by_route": _q(lambda E: D.bi_mean_by_route(_summary(E), "avg_load_factor", 3, "avg_load_factor")),
    "bi_revenue_per_km_by_route": _q(lambda E: D.bi_mean_by_route(
        I.int_daily_ridership(E), "revenue_per_km_php", 2, "avg_revenue_per_km")),
    "bi_weekly_on_time": _q(lambda E: D.bi_weekly_on_time(_summary(E))),
    "bi_peak_offpeak": _q(lambda E: D.bi_peak_offpeak(I.int_daily_ridership(E))),
    "bi_rain_delay_box": _q(lambda E: D.bi_rain_delay_box(_summary(E))),
    "bi_district_daily": _q(lambda E: D.bi_district_daily(_district(E))),
    "bi_district_weekday": _q(lambda E: D.bi_district_weekday(_district(E))),
    "bi_district_service": _q(lambda E: D.bi_district_service(_district(E))),
    "bi_monthly_transfers": _q(lambda E: D.bi_monthly_transfers(S.stg_passenger_survey(E))),
    "bi_ab_group_means": _q(lambda E: D.bi_ab_group_means(_ab(E))),
    "bi_ab_reuse_counts": _q(lambda E: D.bi_ab_reuse_counts(_ab(E))),
    "bi_ab_weekly_score": _q(lambda E: D.bi_ab_weekly_score(_ab(E))),
    "filter_options_district": _q(lambda E: D.option_counts(_clusters(E), "origin_district")),
    "bounds_trip_date": _q(lambda E: D.bounds(_summary(E), "trip_date")),
    "bounds_test_week": _q(lambda E: D.bounds(_ab(E), "test_week")),
    "fleet_per_route": _q(lambda E: D.fleet_per_route(S.stg_vehicles(E))),
})


# The dashboards' filters in use: a route set with a date range, stop types with
# districts, and the option lists of the selectors.
_SELECTED = {"route_ids": [1, 4, 9, 16], "start": "1995-01-01", "end": "1996-12-31"}

REGISTRY.update({
    "trend_kpis_filtered": _q(lambda E: D.trend_kpis(_summary(E), **_SELECTED)),
    "route_weekday_heatmap_filtered": _q(lambda E: D.route_weekday_heatmap(_summary(E), **_SELECTED)),
    "district_series_filtered": _q(lambda E: D.district_series(_district(E), "1995-01-01", "1996-12-31")),
    "stop_table_filtered": _q(lambda E: D.stop_table(S.stg_stops(E), ["terminal", "market"], ["ASIA", "EUROPE"])),
    "filter_options_purpose": _q(lambda E: D.option_counts(_clusters(E), "trip_purpose")),
    "filter_options_income": _q(lambda E: D.option_counts(_clusters(E), "income_bracket")),
    "filter_options_stop_type": _q(lambda E: D.option_counts(S.stg_stops(E), "stop_type")),
    "cluster_by_income": _q(lambda E: D.cluster_split(_clusters(E), "income_bracket")),
    "cluster_by_purpose": _q(lambda E: D.cluster_split(_clusters(E), "trip_purpose")),
})


# -- experiment statistics ---------------------------------------------------


def _exp(E):
    return X.experiment_rows(E)


REGISTRY.update({
    "ab_split_balance": _q(lambda E: X.split_balance(_exp(E))),
    "ab_ttest_moments": _q(lambda E: X.ttest_moments(_exp(E)).drop("_t", "_df")),
    "ab_chi_square_counts": _q(lambda E: X.chi_square_counts(_exp(E)).drop("_x")),
    "ab_test_statistics": _q(lambda E: X.statistics_table(_exp(E))),
    "ab_weekly_band": _q(lambda E: X.weekly_band(_exp(E))),
    "ab_lift_by_origin": _q(lambda E: X.lift_by(_ab(E), "origin_district")),
    "ab_lift_by_income": _q(lambda E: X.lift_by(X.experiment_data(E), "income_bracket")),
    "ab_retention": _q(lambda E: X.retention(_exp(E))),
    "ab_verdict": _q(lambda E: X.verdict(X.statistics_table(_exp(E)))),
    "ab_assignment": _q(lambda E: X.assign_groups(S.stg_passenger_survey(E).filter("cluster_id = 3"))),
})


# -- data quality --------------------------------------------------------------

REGISTRY.update({
    "dq_staging_tests": _q(Q.staging_tests),
    "dq_intermediate_tests": _q(Q.intermediate_tests),
    "dq_mart_tests": _q(Q.mart_tests),
    "dq_stage_gates": _q(Q.stage_gates),
    "dq_business_rules": _q(Q.business_rules),
    "staging_row_counts": _q(Q.staging_row_counts),
    "mart_row_counts": _q(Q.mart_row_counts),
    "route_coverage": _q(Q.route_coverage),
    "survey_null_profile": _q(Q.survey_null_profile),
})


# -- landing ingest --------------------------------------------------------------


def _landed(E):
    return L.clean_trips(L.drop_full_duplicates(L.landing_trips(E)))


def _rerun(E, cutoff="1997-01-01"):
    landing = L.landing_trips(E)
    first, _ = L.ingest_trips(landing.filter(F.col("_date") < F.lit(cutoff).cast("date")))
    new, _ = L.ingest_trips(landing, target=first)
    return new


def _range_checks(E):
    sv = S.stg_passenger_survey(E).agg(QO.out_of_range(S.stg_passenger_survey(E), "satisfaction_score", 1, 5)
                                       .alias("failures")).select(F.lit("satisfaction_score").alias("check"), "failures")
    lt = _landed(E).agg(QO.out_of_range(_landed(E), "load_factor", 0, 1.5).alias("failures")).select(
        F.lit("load_factor").alias("check"), "failures")
    return sv.unionByName(lt)


def _ingested_summary(E):
    """M04 over the trips that the ingest loads: repeated trip keys count once."""
    trips = S.stg_trips(E, L.ingest_trips(L.landing_trips(E))[0])
    return _summary(E, route_perf=I.int_route_performance(E, trips))


def _fresh(E, name):
    """A folder of its own in the shared checkpoint folder."""
    return scratch_path(E.spark, f"{name}-{uuid.uuid4().hex}")


#: Landing dates that split the trips into deliveries.
_DELIVERIES = ["1996-06-01", "1997-06-01"]


def _deliveries(E):
    """S05 into a keyed table, delivery by delivery."""
    return load_in_deliveries(L.landing_trips(E), _fresh(E, "deliveries"), "trip_id", L.TRIP_ORDER, lambda df: L.valid_trips(df)[0], _DELIVERIES).drop(*L.LINEAGE)


def _streamed(E):
    """The same deliveries as files, each followed by a run of the stream."""
    root = _fresh(E, "stream")
    trips = L.landing_trips(E)
    bounds = ["0001-01-01", *_DELIVERIES, "9999-01-01"]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = trips.where(f"_date >= date'{lo}' and _date < date'{hi}'")
        if not part.isEmpty():
            L.write_landing(part, f"{root}/landing", "trips")
            out = run_trip_ingest(E.spark, f"{root}/landing", f"{root}/trips", f"{root}/state")
    return out.drop(*L.LINEAGE)


REGISTRY.update({
    "ingest_trips_deliveries": _q(_deliveries),
    "ingest_trips_streamed": _q(_streamed),
    "mart_route_summary_ingested": _q(_ingested_summary),
    "landing_trip_validation": _q(lambda E: V.rule_failures(_landed(E), V.trip_rules())),
    "ingest_trips": _q(lambda E: L.ingest_trips(L.landing_trips(E))[0]),
    "ingest_trips_rerun": _q(_rerun),
    "landing_receipt": _q(lambda E: L.ingest_receipt(L.landing_trips(E), "trips")),
    "experiment_orphans": _q(lambda E: L.orphan_report(
        S.stg_ab_experiment(E), "passenger_id", S.stg_passenger_survey(E), "passenger_id", 10)),
    "experiment_fk_filtered": _q(lambda E: L.drop_fk_orphans(
        S.stg_ab_experiment(E).select("experiment_record_id", "passenger_id", "group"),
        "passenger_id", S.stg_passenger_survey(E), "passenger_id")),
    "landing_null_profile": _q(lambda E: QO.null_profile(_landed(E))),
    "ingest_range_checks": _q(_range_checks),
})


# -- all seven landing entities, by the constraint graph -----------------------------


def _loaded(name):
    def query(E):
        rows = load(landed(E, ancestors(SPECS, name) | {name}), checked=_fresh(E, f"load-{name}"))[name][0]
        return rows.drop(*L.LINEAGE)

    return _q(query)


def _quarantine(E):
    """Quarantined rows by entity and broken rule."""
    parts = [rejected.select(F.lit(n).alias("entity"), F.explode("failed_rules").alias("rule")).groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("failures"))
             for n, (_, rejected) in load(landed(E), root=_fresh(E, "entities")).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


REGISTRY.update({f"load_{name}": _loaded(name) for name in SPECS})
REGISTRY["load_quarantine"] = _q(_quarantine)


# -- segmentation --------------------------------------------------------------

_seg = G.Segmentation


def _feature_matrix_view(E):
    fm = G.feature_matrix(E)
    return fm.withColumns({c: F.round(c, 6) for c in G.SCALED})


def _given_label_centroids(E):
    fm = G.feature_matrix(E, None).join(
        S.stg_passenger_survey(E).select("passenger_id", "cluster_id"), "passenger_id")
    c = G.centroids(fm, "cluster_id").withColumns(G.prototype_score_columns())
    return c.select("cluster_id", "n", *[F.round(x, 6).alias(x) for x in G.SCALED],
                    *[F.round(f"score_{i}", 6).alias(f"score_{i}") for i in range(5)])


def _given_label_quality(E):
    labels = S.stg_passenger_survey(E).select("passenger_id", "cluster_id")
    return G.quality(G.feature_matrix(E).join(labels, "passenger_id"))


def _given_label_remap(E):
    """K07 on the given labels: raw cluster, semantic id."""
    fm = G.feature_matrix(E).join(S.stg_passenger_survey(E).select("passenger_id", F.col("cluster_id").alias("raw_cluster")), "passenger_id")
    scored = G.centroids(fm).withColumns(G.prototype_score_columns()).collect()  # five rows
    return E.spark.createDataFrame(sorted(CL.remap_clusters(scored, K.REMAP_ORDER).items()), "raw_cluster long, cluster_id int")


def _segmented_survey(E):
    return G.write_back(E.survey(), _seg(E).assignments())


REGISTRY.update({
    "passenger_feature_matrix": _q(_feature_matrix_view),
    "given_label_centroids": _q(_given_label_centroids),
    "given_label_quality": _q(_given_label_quality),
    "given_label_remap": _q(_given_label_remap),
    "kmeans_elbow": _q(lambda E: _seg(E).elbow()),
    "kmeans_silhouette": _q(lambda E: _seg(E).silhouette()),
    "kmeans_assignments": _q(lambda E: _seg(E).assignments()),
    "segment_distribution": _q(lambda E: G.distribution(_seg(E).assignments())),
    "segmented_cluster_profile": _q(lambda E: A.cluster_profile(
        E, M.mart_commuter_clusters(E, features=I.int_passenger_features(E, _segmented_survey(E))))),
})

def _given_label_silhouette(E):
    """K02 over all rows, for the given labels."""
    labels = S.stg_passenger_survey(E).select("passenger_id", "cluster_id")
    rows = G.feature_matrix(E).join(labels, "passenger_id")
    s = CL.silhouette(rows, "passenger_id", G.SCALED, ["cluster_id"]).join(labels, "passenger_id")
    return s.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("passengers"), F.round(F.avg("s"), 6).alias("silhouette_score"))


def _density_clusters(E):
    """Rows by density cluster, noise (ids below 0) left out; with five neighbours, as
    the given rows are too sparse for any cluster of fifteen."""
    return G.dbscan_labels(E, min_samples=5).where("dbscan_label >= 0").groupBy("dbscan_label").agg(F.count(F.lit(1)).alias("passengers"), F.count_if("is_core").alias("core_passengers"))


REGISTRY.update({
    "dbscan_cluster_sizes": _q(_density_clusters),
    "given_label_silhouette": _q(_given_label_silhouette),
    "dbscan_validation": _q(G.dbscan_validation),
})


# -- audits, pages, histograms ---------------------------------------------------

REGISTRY.update({
    "trip_audit": _q(AU.trip_audit),
    "events_by_period": _q(AU.events_by_period),
    "survey_validation": _q(AU.survey_validation),
    "ab_validation": _q(AU.ab_validation),
    "ab_results_page": _q(lambda E: AU.ab_results_page(_ab(E), (2, 6), ["control", "treatment"], 500)),
    "route_preview": _q(lambda E: AU.route_preview(_summary(E), 500)),
    "ab_score_histogram": _q(lambda E: AU.score_histogram(_ab(E))),
    "ab_transfer_histogram": _q(lambda E: AU.transfer_histogram(_ab(E))),
    "ab_reuse_crosstab": _q(lambda E: AU.reuse_crosstab(_exp(E))),
    "ab_ci_table": _q(lambda E: X.ci_table(X.statistics_table(_exp(E)))),
    "cluster_sample": _q(lambda E: R.seeded_sample(_clusters(E), 2000, "passenger_id", 42)),
    "recommended_k": _q(lambda E: R.argmax(_seg(E).silhouette(), "k", "silhouette_score")),
})


# -- A16 on the experiment, S12 by partitions ---------------------------------------


def _recent_months(E):
    """S12 from a mart in partitions by month."""
    path = _fresh(E, "summary-by-month")
    write_by_month(_summary(E), path, "trip_date", ["route_id"])
    return recent_by_month(E.spark, path, "trip_date", K.RECENT_DAYS)


REGISTRY.update({
    "ab_travel_box": _q(lambda E: RS.box(_ab(E), ["group"], "simulated_travel_time_min", exact=True)),
    "ab_travel_box_sketch": _q(lambda E: RS.box(_exp(E), ["group"], "simulated_travel_time_min")),
    "ab_fare_violin": _q(lambda E: RS.violin(_ab(E), ["group"], "simulated_fare_php")),
    "route_summary_recent_months": _q(_recent_months),
    "trip_time_audit": _q(AU.trip_time_audit),
    "ab_statistics_presented": _q(lambda E: X.presentation(X.statistics_table(_exp(E)))),
    "bi_ab_significance": _q(lambda E: D.bi_ab_significance(_ab(E))),
    "bi_daily_riders_limited": _q(lambda E: D.bi_daily_riders_by_route(_summary(E), 1000)),
    "cluster_kpis_filtered": _q(lambda E: D.cluster_kpis(_clusters(E), cluster_ids=[0, 3], districts=["ASIA", "EUROPE"], purposes=["daily_commute", "weekend_only"], incomes=["low", "high"])),
    "ab_verdict_detail": _q(lambda E: X.verdict_detail(X.statistics_table(_exp(E)))),
})


# -- S22: SQL over a parquet path ----------------------------------------------


def _sql_route_volume(spark, sf_dir):
    """The SQL API straight over parquet files: trips per supplier
    nation (route) and ship year, no view registration needed."""
    return spark.sql(f"""
        SELECT s.s_nationkey AS route_id, year(l.l_shipdate) AS ship_year,
               count(*) AS trips, CAST(sum(l.l_quantity) AS BIGINT) AS riders
        FROM parquet.`{sf_dir.rstrip('/')}/lineitem.parquet` l
        JOIN parquet.`{sf_dir.rstrip('/')}/supplier.parquet` s ON l.l_suppkey = s.s_suppkey
        GROUP BY s.s_nationkey, year(l.l_shipdate)""")


REGISTRY.update({
    "sql_parquet_route_volume": _sql_route_volume,
    "sql_parquet_regions": lambda spark, sf_dir: query_parquet(
        spark, f"{sf_dir.rstrip('/')}/region.parquet", "r_regionkey >= 0"),
})


REGISTRY.update({
    "ingest_passengers": _q(lambda E: L.ingest_ordered(E)["passengers"]),
    "ingest_experiment": _q(lambda E: L.ingest_ordered(E)["experiment"]),
})
