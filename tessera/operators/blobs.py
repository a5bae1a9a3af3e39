"""Bright round spots of tiles by the Laplacian of Gaussian over several scales."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.operators.kernels import correlate

ROOT2 = math.sqrt(2.0)


def scales(least_radius: float | None, most_radius: float | None, steps: int = 8) -> list[float]:
    """Sigmas in equal steps for circles between two radii (3 and 18 pixels where unknown)."""
    # The smallest sigma and the least span of sigmas.
    low = max(1.2, (least_radius or 3.0) / ROOT2)
    high = max(low + 1.0, (most_radius or 18.0) / ROOT2)
    return [low + (high - low) * k / (steps - 1) for k in range(steps)]


def response(image: np.ndarray, sigma: float) -> np.ndarray:
    """Minus sigma squared times the Laplacian of the Gaussian-blurred image; kernels end at four sigmas."""
    x = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    blur = np.exp(-0.5 * (x / sigma) ** 2)
    blur /= blur.sum()
    bend = blur * (x * x / sigma**4 - 1 / sigma**2)
    return -(sigma**2) * (correlate(correlate(image, bend, 0), blur, 1) + correlate(correlate(image, blur, 0), bend, 1))


def peaks(stack: np.ndarray, threshold: float) -> np.ndarray:
    """Places (scale, row, column) above the threshold that no value of the 3 x 3 x 3 cube around them exceeds."""
    most = np.pad(stack, 1, constant_values=-np.inf)
    for axis in range(3):
        n = most.shape[axis]
        part = [most.take(np.arange(k, n - 2 + k), axis=axis) for k in range(3)]
        most = np.maximum(np.maximum(*part[:2]), part[2])
    return np.argwhere((stack == most) & (stack > threshold))


def overlap(r: float, others: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Shared area of a circle of radius r and each other one, over the area of the smaller."""
    small, large, d = np.minimum(r, others), np.maximum(r, others), np.maximum(distance, 1e-12)
    one = np.arccos(np.clip((d * d + small**2 - large**2) / (2 * d * small), -1, 1))
    two = np.arccos(np.clip((d * d + large**2 - small**2) / (2 * d * large), -1, 1))
    kite = 0.5 * np.sqrt(np.maximum((small + large - d) * (d + small - large) * (d - small + large) * (d + small + large), 0))
    lens = (small**2 * one + large**2 * two - kite) / (np.pi * small**2)
    return np.where(distance >= small + large, 0.0, np.where(distance <= large - small, 1.0, lens))


def find(image: np.ndarray, sigmas: list[float], threshold: float = 0.035, most_overlap: float = 0.55) -> np.ndarray:
    """Row, column, radius and response of the blobs of an image. A blob is compared with kept ones that may reach it: those
    in the squares, of the largest diameter, around it."""
    stack = np.stack([response(image, s) for s in sigmas])
    found = peaks(stack, threshold)
    strength = stack[tuple(found.T)]
    order = np.lexsort((found[:, 2], found[:, 1], -strength, -found[:, 0]))
    side = 2 * ROOT2 * max(sigmas)
    kept: dict[tuple[int, int], list] = {}
    out = []
    for (k, y, x), s in zip(found[order].tolist(), strength[order].tolist(), strict=True):
        r, cell = sigmas[k] * ROOT2, (int(y // side), int(x // side))
        near = np.array([b for i in (-1, 0, 1) for j in (-1, 0, 1) for b in kept.get((cell[0] + i, cell[1] + j), ())]).reshape(-1, 3)
        if not (overlap(r, near[:, 2], np.hypot(near[:, 0] - y, near[:, 1] - x)) > most_overlap).any():
            kept.setdefault(cell, []).append((y, x, r))
            out.append((y, x, r, s))
    return np.array(out).reshape(-1, 4)


def log_blobs(pixels: DataFrame, by: str, value: str, sigmas: list[float], threshold: float = 0.035, most_overlap: float = 0.55) -> DataFrame:
    """by, prow, pcol, radius (sigma times the root of 2) and response of each blob.

    Of circles that overlap by more than the share given, the larger one stays (of equal ones that with the
    higher response, then the first place). Missing pixels of a tile's rectangle, and null or NaN values, are
    0; of repeated pixels the largest value counts. One task holds one tile at all scales: by is to be a tile
    of fixed size. A table without rows gives none."""
    rows = pixels.select(by, F.col("prow").cast("int").alias("prow"), F.col("pcol").cast("int").alias("pcol"), F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    schema = StructType([rows.schema[by], StructField("prow", IntegerType()), StructField("pcol", IntegerType()), StructField("radius", DoubleType()), StructField("response", DoubleType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row, col = table["prow"].to_numpy(), table["pcol"].to_numpy()
        top, left = int(row.min()), int(col.min())
        image = np.full((int(row.max()) - top + 1, int(col.max()) - left + 1), -np.inf)
        np.maximum.at(image, (row - top, col - left), table["v"].to_numpy())
        image[np.isneginf(image)] = 0.0
        found = find(image, sigmas, threshold, most_overlap)
        columns = [pa.array([key[0].as_py()] * len(found), table.schema.field(by).type), pa.array(found[:, 0].astype(np.int32) + top, pa.int32()), pa.array(found[:, 1].astype(np.int32) + left, pa.int32()), pa.array(found[:, 2]), pa.array(found[:, 3])]
        return pa.Table.from_arrays(columns, names=schema.names)

    return rows.groupBy(by).applyInArrow(run, schema)
