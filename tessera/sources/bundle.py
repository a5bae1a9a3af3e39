"""Model bundles: a fitted forest, what it was fitted for, and its report, in one folder of any store Spark writes to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tessera.operators.detectors import FEATURES, Calibration


@dataclass
class Meta:
    """What detection needs to know of the training raster."""

    pixel_size: float
    calibration: Calibration
    bands: list[int] = field(default_factory=lambda: [1, 2, 3])
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    crs: str | None = None

    @classmethod
    def from_dict(cls, told: dict) -> Meta:
        return cls(**told | {"calibration": Calibration(**told["calibration"])})


def _write(spark: SparkSession, path: str, told: dict) -> None:
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save(spark: SparkSession, model: PipelineModel, meta: Meta, report: dict, path: str) -> None:
    """Replaces what is there."""
    model.write().overwrite().save(f"{path}/model")
    _write(spark, f"{path}/meta", asdict(meta))
    _write(spark, f"{path}/report", report)


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, Meta, dict]:
    meta = Meta.from_dict(_read(spark, f"{path}/meta"))
    if meta.features != FEATURES:
        raise ValueError("the bundle was fitted on other features")
    return PipelineModel.load(f"{path}/model"), meta, _read(spark, f"{path}/report")
