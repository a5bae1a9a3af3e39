"""Classifying candidates: a forest of random trees, weighted by class."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, names: list[str], values: str = "features") -> DataFrame:
    """An array of features as columns."""
    return rows.select("*", *[F.get(values, F.lit(k)).alias(n) for k, n in enumerate(names)]).drop(values)


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 220, depth: int = 20, seed: int = 7) -> PipelineModel:
    """Both classes weigh the same in all. A row with a null feature is left out. Leaves hold two rows at least."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # two classes
    weight = F.lit(0.0)
    for k, n in counts.items():
        weight = F.when(F.col(label) == k, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), forest]).fit(rows.withColumn("_weight", weight))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds prob, the probability of class 1."""
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")
