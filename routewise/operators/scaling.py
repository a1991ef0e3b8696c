"""A scaler with population deviations as an ML pipeline stage, which can be saved."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "of the scaled columns' names", TypeConverters.toString)


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / deviation of each column; deviation 1 where the column is constant."""

    means = Param(Params._dummy(), "means", "of the columns", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population standard deviations", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, suffix = self.getOrDefault(self.inputCols), self.getOrDefault(self.suffix)
        return dataset.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, self.getOrDefault(self.means), self.getOrDefault(self.deviations))})


class PopulationScaler(Estimator, _Columns):
    """F04.  (MLlib's StandardScaler divides by the sample deviation.)"""

    def __init__(self, inputCols: list[str], suffix: str = "_scaled"):
        super().__init__()
        self._set(inputCols=inputCols, suffix=suffix)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getOrDefault(self.inputCols)
        stats = dataset.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        model = PopulationScalerModel()
        model._set(inputCols=cols, suffix=self.getOrDefault(self.suffix), means=[float(stats[f"m_{c}"] or 0.0) for c in cols], deviations=[float(stats[f"s_{c}"] or 1.0) for c in cols])
        return model
