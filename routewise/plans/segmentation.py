"""Feature engineering and segmentation."""

from __future__ import annotations

import operator
from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import clustering as CL
from ..operators.ranking import seeded_sample
from ..operators.scaling import PopulationScaler
from ..sources.standin import Entities
from . import intermediate as I

META = ["passenger_id", "origin_barangay", "origin_district", "destination_type",
        "trip_purpose", "primary_route_used", "income_bracket", "prefers_aircon"]
SCALED = [f"{c}_scaled" for c in K.FEATURE_COLS]


def load_features(E: Entities, survey: DataFrame | None = None) -> DataFrame:
    """the 14 feature-table columns."""
    f = I.int_passenger_features(E, survey)
    return f.select(*META, "trips_per_week", "avg_fare_paid_php", "transfers_required",
                    "wait_time_min", "travel_time_min", "satisfaction_score")


def encode(df: DataFrame) -> DataFrame:
    """income 0/1/2, case-insensitive, unknown or NULL -> 1."""
    code = C.map_value(F.lower("income_bracket"), K.INCOME_CODE_ML)
    return df.withColumn("income_bracket_encoded", F.coalesce(code, F.lit(K.INCOME_CODE_ML_DEFAULT)))


def feature_matrix(E: Entities, survey: DataFrame | None = None) -> DataFrame:
    """F05 (S14 shape): meta + raw features + population-standardised copies."""
    df = encode(load_features(E, survey))
    df = CL.impute_median(df, K.FEATURE_COLS)
    return CL.standardize(df, K.FEATURE_COLS)


def prototype_score_columns() -> dict[str, F.Column]:
    """How well a centroid (scaled means) fits each semantic id."""
    g = lambda n: F.col(f"{n}_scaled")
    return {"score_0": g("trips_per_week") - g("avg_fare_paid_php"),
            "score_1": g("transfers_required") + g("wait_time_min"),
            "score_2": g("avg_fare_paid_php") + g("satisfaction_score"),
            "score_3": -g("satisfaction_score") + g("transfers_required"),
            "score_4": -g("trips_per_week") - g("transfers_required")}


def centroids(labelled: DataFrame, label: str = "raw_cluster") -> DataFrame:
    """Mean scaled features per cluster (one partial aggregation)."""
    return labelled.groupBy(label).agg(*[F.avg(c).alias(c) for c in SCALED],
                                       F.count(F.lit(1)).alias("n"))


class Segmentation:
    """Segmentation of the survey: diagnostics over K, final model, semantic remap and
    labels.  Each part is fitted when it is first asked for: labels need the final
    model only."""

    def __init__(self, E: Entities, survey: DataFrame | None = None,
                 k_range=K.K_RANGE, diag_restarts: int = K.DIAG_RESTARTS,
                 final_restarts: int = K.FINAL_RESTARTS, seed: int = K.RANDOM_STATE, matrix: DataFrame | None = None):
        # every fit reads the same rows: a written matrix, or one in the checkpoint folder
        self.X = feature_matrix(E, survey).checkpoint() if matrix is None else matrix
        self.k_range, self.seed = list(k_range), seed
        self.diag_restarts, self.final_restarts = diag_restarts, final_restarts

    @cached_property
    def diagnostics(self) -> dict[int, CL.Fit]:
        """The best fit of each k."""
        return CL.best_fits(self.X, SCALED, self.k_range, [self.seed + r for r in range(self.diag_restarts)], K.DIAG_MAX_ITER)

    @cached_property
    def final(self) -> CL.Fit:
        """The best of the final model's restarts."""
        return CL.best_fits(self.X, SCALED, [K.OPTIMAL_K], [self.seed + r for r in range(self.final_restarts)], K.FINAL_MAX_ITER)[K.OPTIMAL_K]

    def elbow(self) -> DataFrame:
        rows = [(k, f.cost, f.seed) for k, f in self.diagnostics.items()]
        return self.X.sparkSession.createDataFrame(rows, "k int, wss double, seed int")

    # Silhouette of a named sample; quality() covers all rows
    def silhouette(self, sample_size: int = K.SILHOUETTE_SAMPLE) -> DataFrame:
        sample = seeded_sample(self.X, sample_size, "passenger_id", self.seed)
        sample = sample.withColumns({f"k{k}": CL.nearest(SCALED, f.centers) for k, f in self.diagnostics.items()})
        s = CL.silhouette(sample, "passenger_id", SCALED, [f"k{k}" for k in self.diagnostics])
        return (s.groupBy("labeling").agg(F.avg("s").alias("silhouette_score"))
                 .select(F.expr("cast(substring(labeling, 2) as int)").alias("k"), "silhouette_score"))

    def recommended_k(self) -> int:
        """Argmax silhouette (first k on ties); logged, not used."""
        rows = sorted(self.silhouette().collect(), key=lambda r: (-r.silhouette_score, r.k))
        return rows[0].k

    # K04-K08
    def raw_labels(self) -> DataFrame:
        return self.X.withColumn("raw_cluster", CL.nearest(SCALED, self.final.centers))

    @cached_property
    def mapping(self) -> dict[int, int]:
        scored = centroids(self.raw_labels()).withColumns(prototype_score_columns())
        return CL.remap_clusters(scored.collect(), K.REMAP_ORDER)  # a row for each cluster

    @cached_property
    def model(self) -> PipelineModel:
        """Scaler, vectors and final K-Means as one model over the raw features."""
        scaler = PopulationScaler(K.FEATURE_COLS).fit(self.X)
        return PipelineModel([scaler, VectorAssembler(inputCols=SCALED, outputCol="features"), CL.mllib_model(self.X.sparkSession, self.final)])

    def save(self, path: str) -> str:
        """Write the model; ``apply_model`` labels with it in another session."""
        self.model.write().overwrite().save(path)
        return path

    def centers_frame(self) -> DataFrame:
        """S21 (re-aimed): the fitted centres as a small table."""
        rows = [(i, *c) for i, c in enumerate(self.final.centers)]
        return self.X.sparkSession.createDataFrame(
            rows, "raw_cluster int, " + ", ".join(f"{c} double" for c in SCALED))

    def assignments(self) -> DataFrame:
        """S15 shape: passenger_id, cluster_id, cluster_label."""
        out = self.raw_labels().withColumn("cluster_id", C.map_value("raw_cluster", self.mapping))
        return out.select("passenger_id", "cluster_id", C.cluster_label("cluster_id").alias("cluster_label"))


def apply_model(path: str, features: DataFrame) -> DataFrame:
    """features with raw_cluster by a saved model."""
    raw = features.drop(*SCALED, "features")
    return PipelineModel.load(path).transform(raw).withColumnRenamed("prediction", "raw_cluster").drop("features")


def quality(labelled: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Cluster quality over all rows: per cluster its size, within-cluster sum of squares
    and between-cluster part (size times squared distance of its centroid from the mean
    of all rows).  Two aggregations with map-side combining."""
    total = labelled.agg(*[F.avg(c).alias(f"t_{c}") for c in SCALED])
    per = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in SCALED],
                                      *[F.var_pop(c).alias(f"v_{c}") for c in SCALED])
    add = lambda xs: reduce(operator.add, xs)
    return per.crossJoin(F.broadcast(total)).select(  # one row
        label, "n", F.round(F.col("n") * add([F.col(f"v_{c}") for c in SCALED]), 4).alias("within_ss"),
        F.round(F.col("n") * add([F.pow(F.col(f"m_{c}") - F.col(f"t_{c}"), F.lit(2)) for c in SCALED]), 4).alias("between_ss"))


def distribution(assign: DataFrame) -> DataFrame:
    """Passengers per cluster."""
    return assign.groupBy("cluster_id", "cluster_label").agg(F.count(F.lit(1)).alias("passengers"))


def write_back(survey: DataFrame, assign: DataFrame) -> DataFrame:
    """Keyed update of the survey - left join on the key and take
    the new cluster id/label where present (a new survey version; the table
    being read is never overwritten in place)."""
    a = assign.select("passenger_id", F.col("cluster_id").alias("_new_id"),
                      F.col("cluster_label").alias("_new_label"))
    return (survey.join(a, "passenger_id", "left")
                  .withColumn("cluster_id", F.coalesce("_new_id", "cluster_id"))
                  .withColumn("cluster_label", F.coalesce("_new_label", "cluster_label"))
                  .drop("_new_id", "_new_label"))


def dbscan_labels(E: Entities, survey: DataFrame | None = None, matrix: DataFrame | None = None, min_samples: int = K.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """DBSCAN (eps 1.2, min 15, self included) on the scaled features."""
    from ..operators.dbscan import dbscan
    fm = feature_matrix(E, survey) if matrix is None else matrix
    return dbscan(fm, "passenger_id", SCALED, K.DBSCAN_EPS, min_samples)


def dbscan_validation(E: Entities, survey: DataFrame | None = None, matrix: DataFrame | None = None) -> DataFrame:
    """K09 summary: cluster count, noise count and share."""
    from ..operators.dbscan import summary
    return summary(dbscan_labels(E, survey, matrix))
