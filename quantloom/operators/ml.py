"""Price prediction by a random forest on the price features, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .indicators import ML_FEATURES, ml_features


def dataset(bars: DataFrame) -> DataFrame:
    """Complete feature rows with the next close as label and the row's place in its symbol's history (0 to 1)."""
    w = W.partitionBy("symbol").orderBy("date")
    df = ml_features(bars).withColumn("label", F.lead("close").over(w))
    return df.dropna(subset=list(ML_FEATURES)).withColumn("place", F.percent_rank().over(w))


def train(data: DataFrame, share: float = 0.8, trees: int = 100, depth: int = 10, seed: int = 42) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Model fitted on each symbol's first ``share`` of rows (the scaler too), and both parts."""
    known = data.where("label is not null")
    early, late = known.where(F.col("place") <= share), known.where(F.col("place") > share)
    stages = [VectorAssembler(inputCols=list(ML_FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512)]
    return Pipeline(stages=stages).fit(early), early, late


def save(model: PipelineModel, path: str) -> None:
    """The scaler and the forest with their parameters, as Spark ML writes them; an existing folder is refused."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate(model: PipelineModel, data: DataFrame) -> dict[str, float]:
    scored = model.transform(data)
    return {m: RegressionEvaluator(labelCol="label", metricName=m).evaluate(scored) for m in ("mse", "mae", "r2")}


def predict(model: PipelineModel, data: DataFrame) -> DataFrame:
    """One-step prediction from each symbol's last complete row."""
    last = data.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("_k = 1")
    return model.transform(last).select("symbol", "date", "close", "prediction")


def importance(model: PipelineModel) -> list[tuple[str, float]]:
    return list(zip(ML_FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


__all__ = ["dataset", "evaluate", "importance", "load", "predict", "save", "train"]
