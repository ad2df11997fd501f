"""The quality model: twelve features to the probability of an important message."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.functions import features as R


def numeric(rows: DataFrame, log_counts: bool = False) -> DataFrame:
    """Flags as 0 and 1. log_counts: followers and statuses are raw counts, as in the training file, and become logarithms."""
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in R.NAMES}
    if log_counts:
        cols |= {c: R.log_count(F.col(c)) for c in ("Followers", "Statuses")}
    return rows.withColumns(cols)


def fit(rows: DataFrame, label: str = "Importance", reg: float = 0.01) -> PipelineModel:
    """rows: R.NAMES as numbers, label 0 or 1."""
    stages = [VectorAssembler(inputCols=R.NAMES, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=reg, maxIter=50)]
    return Pipeline(stages=stages).fit(rows.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with score = P(important)."""
    out = model.transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
