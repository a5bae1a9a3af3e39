"""Statistics by tile: percentiles, robust rescaling, Otsu thresholds, and reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from tessera.operators import kernels as K


def finite(c: Column) -> Column:
    return ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def percentiles(df: DataFrame, by: str, value: Column, shares: list[float], name: str) -> DataFrame:
    v = value.cast("double")
    return df.where(finite(v)).groupBy(by).agg(F.percentile(v, F.array(*map(F.lit, shares))).alias(name))


def _grouped(df: DataFrame, adds: dict[str, DataType], by: str, f: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """df with the columns that f makes of each group; one exchange, and a group (a tile of fixed size) in one task."""
    kept = [x for x in df.schema.fields if x.name not in adds]

    def run(table: pa.Table) -> pa.Table:
        out, made = table.select([x.name for x in kept]), f(table)
        for n in adds:
            out = out.append_column(n, pa.array(made[n]))
        return out

    return df.groupBy(by).applyInArrow(run, StructType([*kept, *[StructField(n, t) for n, t in adds.items()]]))


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table[name].cast(pa.float64()).to_numpy().astype(float)


def rescale(df: DataFrame, by: str, values: dict[str, Column], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds a column for each value: stretched between its percentiles in the tile, clipped to 0 and 1; 0 where there is no
    range or no number."""
    rows, names = df.withColumns({k: c.cast("double") for k, c in values.items()}), list(values)
    return _grouped(rows, {k: DoubleType() for k in names}, by, lambda t: {k: K.rescale(_values(t, k), low, high) for k in names})


def _indexed(df: DataFrame, by: str, kind: str, bands: tuple[str, ...]) -> DataFrame:
    return _grouped(df, {"veg": DoubleType()}, by, lambda t: {"veg": K.vegetation(kind, *(_values(t, b) for b in bands))})


def veg_index_rgb(df: DataFrame, by: str = "tile_id") -> DataFrame:
    return _indexed(df, by, "rgb", ("red", "green", "blue"))


def veg_index_nir(df: DataFrame, by: str = "tile_id") -> DataFrame:
    return _indexed(df, by, "nir", ("red", "green", "blue", "nir"))


def veg_index_young(df: DataFrame, by: str = "tile_id") -> DataFrame:
    return _indexed(df, by, "young", ("red", "green", "blue"))


def otsu(df: DataFrame, by: str, value: str, bins: int = 256) -> DataFrame:
    """Threshold by tile: the bin centre that separates two classes best, the lowest of equals; a constant is its own threshold."""
    schema = StructType([df.schema[by], StructField("otsu", DoubleType())])
    return df.select(by, value).where(finite(F.col(value))).groupBy(by).applyInArrow(lambda t: t.select([by]).slice(0, 1).append_column("otsu", pa.array([K.otsu(_values(t, value), bins)])), schema)


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support by class, from the confusion matrix; 0 where undefined."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by = cells.select(F.explode(F.array("t", "p")).alias("label"), "t", "p", "n").distinct()
    sums = by.groupBy("label").agg(*[F.sum(F.when(w, F.col("n")).otherwise(0)).alias(k) for k, w in (("tp", (F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))), ("support", F.col("t") == F.col("label")), ("predicted", F.col("p") == F.col("label")))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = sums.withColumns({"precision": zero(F.try_divide("tp", "predicted")), "recall": zero(F.try_divide("tp", "support"))})
    return sums.select("label", "precision", "recall", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """One row more than classes have figures: accuracy, and the plain and the weighted mean of each figure."""
    n = F.sum("support")
    mean = lambda c: F.avg(c).alias(f"macro_{c}")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}")
    return report.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"), *[f(c) for f in (mean, weighted) for c in ("precision", "recall", "f1")], n.alias("support"))
