"""End-to-end run: landing -> ingest -> staging/marts -> quality gates ->
features/segmentation -> write-back -> marts with labels -> statistics ->
exports.  Every stage hands off through Parquet on shared storage (re-read
downstream), which cuts lineage and makes each stage restartable after an
executor loss."""

from __future__ import annotations

import logging
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import KEY_KINDS, Watch, assert_gate, run_tests
from ..sources import landing as L
from ..sources import sinks as K
from ..sources.constraints import SPECS, load
from ..sources.deliveries import landed
from ..sources.loaded import LoadedEntities
from ..sources.months import MONTH, read_months, write_by_month
from ..sources.standin import Entities
from . import experiment as X
from . import intermediate as I
from . import marts as M
from . import quality_suite as Q
from . import segmentation as G
from . import staging as S

log = logging.getLogger(__name__)


def run(spark: SparkSession, sf_dir: str, out: str, segment: bool = True,
        timings: dict | None = None) -> dict[str, str]:
    t = timings if timings is not None else {}
    out = out.rstrip("/")
    source = Entities(spark, sf_dir)
    E = LoadedEntities(spark, sf_dir, out)
    paths: dict[str, str] = {}

    def gate(df: DataFrame) -> None:
        """Q16: stop at a gate that doesn't pass."""
        assert_gate(df, "passed", "stage gate")

    def tested(name: str, results: DataFrame) -> None:
        """Q16: keep a layer's test results and stop at a failure."""
        K.write_table(results, f"{out}/quality/{name}")
        assert_gate(rd(f"{out}/quality/{name}"), "failures = 0", f"{name} failed")

    def step(name, fn):
        t0 = time.time()
        r = fn()
        t[name] = round(time.time() - t0, 3)
        return r

    def rd(p) -> DataFrame:
        return spark.read.parquet(p)

    # 1. landing files (S02), then parents before children (C11): dedupe, cleaning, rules,
    # orphan filter, first writers; a table for each entity and one of its quarantined rows
    def land():
        landings = {}
        for name, df in landed(source).items():
            L.write_landing(df, f"{out}/landing", name, mode="overwrite", replace_days_only=False)
            landings[name] = L.read_landing(spark, f"{out}/landing", name, SPECS[name].landing_schema())
        gate(Q.outputs_present("landed_files", K.inventory(spark, {n: f"{out}/landing/{n}" for n in landings}), list(landings)))
        K.write_table(reduce(DataFrame.unionByName, [L.receipt_of_files(spark, f"{out}/landing", n) for n in landings]), f"{out}/quality/receipts")
        for name, df in landings.items():
            if df.isEmpty():  # C07: continue without files, as the original does
                log.warning("no landed %s under %s", name, f"{out}/landing")
        load(landings, root=out)
    step("ingest", land)
    for raw, name in (("raw_trips", "trips"), ("raw_passengers", "passengers"), ("raw_ab_experiment", "experiment")):
        paths[raw] = f"{out}/raw/{name}"

    # 2. staging tests, one scan a model, gate what is built on the loaded tables
    step("staging_tests", lambda: tested("staging_tests", Q.staging_tests(E)))

    watched: dict[str, Watch] = {}
    marts: dict[str, DataFrame] = {}

    def deliver(name: str, df: DataFrame, order: list[str]) -> None:
        """Write a mart, by month if it has days; its row tests and its rows are observed on
        the way."""
        w = watched[name] = Watch(name, Q.MART_TESTS[name])
        paths[name] = f"{out}/marts/{name[5:]}"
        if order[0] == "trip_date":
            write_by_month(w.on(df), paths[name], order[0], order[1:])
            marts[name] = read_months(spark, paths[name]).drop(MONTH)
        else:
            K.write_table(w.on(df), paths[name], order)
            marts[name] = rd(paths[name])

    # 3. marts from the loaded trips; intermediate M01/M02 feed two marts
    def trip_marts():
        trips = S.stg_trips(E)
        K.write_table(I.int_daily_ridership(E, trips), f"{out}/intermediate/daily_ridership", ["trip_date", "route_id"])
        K.write_table(I.int_route_performance(E, trips), f"{out}/intermediate/route_performance", ["trip_date", "route_id"])
        daily, perf = rd(f"{out}/intermediate/daily_ridership"), rd(f"{out}/intermediate/route_performance")
        tested("intermediate_tests", Q.intermediate_tests(E, {"int_daily_ridership": daily, "int_route_performance": perf}))
        deliver("mart_route_summary", M.mart_route_summary(E, True, perf), ["trip_date", "route_id"])
        deliver("mart_district_ridership", M.mart_district_ridership(E, True, daily), ["trip_date", "district"])
    step("marts", trip_marts)

    # 4. segmentation and keyed write-back (J09) into a new survey version
    def seg():
        if not segment:  # the given labels
            labels = source.survey().select("passenger_id", "cluster_id", "cluster_label")
            K.write_table(G.write_back(E.survey(), labels), f"{out}/raw/survey_v2", ["passenger_id"])
            return
        K.write_table(G.feature_matrix(E), f"{out}/science/passenger_features", ["passenger_id"])
        matrix = rd(f"{out}/science/passenger_features")
        gate(Q.not_empty("passenger_features", matrix))
        s = G.Segmentation(E, matrix=matrix)
        K.write_table(s.assignments(), f"{out}/science/cluster_assignments", ["passenger_id"])
        K.write_table(s.elbow(), f"{out}/science/elbow_scores")
        K.write_table(s.silhouette(), f"{out}/science/silhouette_scores")
        K.write_table(s.centers_frame(), f"{out}/models/kmeans_centers")
        s.save(f"{out}/models/segmentation")
        K.write_table(G.write_back(E.survey(), rd(f"{out}/science/cluster_assignments")),
                      f"{out}/raw/survey_v2", ["passenger_id"])
        gate(Q.clusters_agree(rd(f"{out}/science/cluster_assignments"), rd(f"{out}/raw/survey_v2")))
        K.write_table(G.dbscan_validation(E, matrix=matrix), f"{out}/science/dbscan_validation")
        paths["cluster_assignments"] = f"{out}/science/cluster_assignments"
    step("segmentation", seg)
    survey = rd(f"{out}/raw/survey_v2")

    # 5. features (materialised, M03) and label-dependent marts; then the tests of all marts:
    # row tests as observed, key tests by one scan of the written keys
    def label_marts():
        K.write_table(I.int_passenger_features(E, survey), f"{out}/intermediate/passenger_features",
                      ["passenger_id"])
        feats = rd(f"{out}/intermediate/passenger_features")
        gate(Q.not_empty("int_passenger_features", feats))
        deliver("mart_commuter_clusters", M.mart_commuter_clusters(E, True, feats), ["cluster_id", "passenger_id"])
        deliver("mart_ab_test_results", M.mart_ab_test_results(E, True, feats), ["test_week", "group", "passenger_id"])
    step("label_marts", label_marts)

    def quality():
        results = [w.failures(spark) for w in watched.values()]
        results += [run_tests(n, marts[n], [x for x in ts if x.kind in KEY_KINDS], marts) for n, ts in Q.MART_TESTS.items()]
        tested("mart_tests", reduce(DataFrame.unionByName, results))
        tested("business_rules", Q.business_rules(E, marts))
        for g in (Q.rows_observed("mart_rows", {n: w.rows for n, w in watched.items()}, spark),
                  Q.labels_in_mart(marts["mart_commuter_clusters"]), Q.ab_mart_contents(marts["mart_ab_test_results"])):
            gate(g)
    step("quality", quality)

    # 6. experiment statistics
    def stats():
        K.write_table(X.statistics_table(X.experiment_rows(E)), f"{out}/science/ab_test_statistics")
        gate(Q.enough_tests(rd(f"{out}/science/ab_test_statistics")))
        if segment:
            science = {n: f"{out}/science/{n}" for n in ("passenger_features", "cluster_assignments", "ab_test_statistics", "elbow_scores", "silhouette_scores")}
            gate(Q.outputs_present("science_outputs", K.inventory(spark, science), list(science)))
    step("statistics", stats)
    paths["ab_test_statistics"] = f"{out}/science/ab_test_statistics"

    # 7. exports (S10-S13), inventory (S18), manifest
    def exports():
        ex = f"{out}/exports"
        K.export_commuter_clusters(rd(paths["mart_commuter_clusters"]), f"{ex}/mart_commuter_clusters")
        K.export_ab_results(rd(paths["mart_ab_test_results"]), f"{ex}/mart_ab_test_results")
        K.export_recent(spark, paths["mart_route_summary"], f"{ex}/mart_route_summary_recent", "route_id")
        K.export_recent(spark, paths["mart_district_ridership"], f"{ex}/mart_district_ridership_recent",
                        "district")
        names = ["mart_commuter_clusters", "mart_ab_test_results", "mart_route_summary_recent",
                 "mart_district_ridership_recent"]
        for n in names:
            paths[f"export_{n}"] = f"{ex}/{n}"
        K.write_manifest(spark, f"{ex}/manifest", {n: f"{ex}/{n}" for n in names})
        # CSV of a filtered frame (the underserved segment)
        K.export_csv(rd(paths["mart_commuter_clusters"]).filter("cluster_id = 3"), f"{ex}/underserved_csv")
        # Inventory of every output, written next to the exports
        K.write_table(K.inventory(spark, {k: v for k, v in paths.items()}), f"{ex}/inventory")
    step("exports", exports)

    # Catalog entries with table comments for the marts
    for name, comment in [("mart_route_summary", "daily route performance KPIs, one row per route per day"),
                          ("mart_district_ridership", "daily ridership and service quality by district"),
                          ("mart_commuter_clusters", "passengers with segment assignments"),
                          ("mart_ab_test_results", "experiment rows of the underserved segment")]:
        K.register_table(spark, name, paths[name], comment)
    return paths
