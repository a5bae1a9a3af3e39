"""Neighbourhood operators on pixels (by, prow, pcol, value): each image (a tile, by) is one task's work, in one pass.

For a raster of any size, tiles.expand_halo() gives every tile the pixels around it that its own results depend
on; results of pixels that a tile doesn't own are left out by the caller."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tessera.operators import kernels as K
from tessera.operators.tiles import Tile, map_tiles


def _present(t: Tile) -> np.ndarray:
    out = np.zeros(t.shape, bool)
    out[t.at] = True
    return out


def _masked(df: DataFrame, by: str, mask: str, f) -> DataFrame:
    """mask replaced by f(tile). The order of columns is kept."""
    return map_tiles(df, by, lambda t: {mask: f(t)}, {mask: BooleanType()}).select(df.columns)


def erode(df: DataFrame, by: str, mask: str, radius: int) -> DataFrame:
    """Outside the image counts as inside the mask: absent neighbours don't take part."""
    return _masked(df, by, mask, lambda t: K.erode(t.mask(mask, True), radius))


def dilate(df: DataFrame, by: str, mask: str, radius: int) -> DataFrame:
    return _masked(df, by, mask, lambda t: K.dilate(t.mask(mask), radius))


def opening(df: DataFrame, by: str, mask: str, radius: int) -> DataFrame:
    return _masked(df, by, mask, lambda t: K.dilate(K.erode(t.mask(mask, True), radius) & _present(t), radius))


def closing(df: DataFrame, by: str, mask: str, radius: int) -> DataFrame:
    return _masked(df, by, mask, lambda t: K.erode(K.dilate(t.mask(mask), radius) | ~_present(t), radius))


def gaussian(df: DataFrame, by: str, value: str, sigma: float) -> DataFrame:
    """Separable blur cut at four sigmas, with half-sample symmetric edges; missing pixels count as 0."""
    return map_tiles(df, by, lambda t: {value: K.gaussian(t.image(value), sigma)}, {value: DoubleType()}).select(df.columns)


def label(df: DataFrame, by: str, mask: str) -> DataFrame:
    """4-connected components of the mask, within each image: masked pixels with label, the smallest place in the component
    (prow * 2^31 + pcol). One task holds one image, so its size is what bounds memory: by is to be a tile of fixed size.
    Repeated pixels each get the label; a null mask counts as false."""
    cells = df.where(F.col(mask)).select(by, F.col("prow").cast("int").alias("prow"), F.col("pcol").cast("int").alias("pcol"))

    def components(table: pa.Table) -> pa.Table:
        place = table["prow"].to_numpy().astype(np.int64) * (1 << 31) + table["pcol"].to_numpy()
        nodes, node = np.unique(place, return_inverse=True)
        ends = []
        for step in (1, 1 << 31):
            at = np.searchsorted(nodes, nodes + step)
            here = np.flatnonzero(np.append(nodes, -1)[at] == nodes + step)
            ends.append((here, at[here]))
        root = K.roots(*(np.concatenate(e) for e in zip(*ends, strict=True)), len(nodes))
        return table.append_column("label", pa.array(nodes[root][node]))

    schema = StructType([*cells.schema.fields, StructField("label", LongType())])
    return cells.groupBy(by).applyInArrow(components, schema)


def drop_small(df: DataFrame, by: str, mask: str, least: int) -> DataFrame:
    """The mask without components of fewer pixels."""
    return _masked(df, by, mask, lambda t: K.drop_small(t.mask(mask), least))


def fill_holes(df: DataFrame, by: str, mask: str, least: int) -> DataFrame:
    """The mask with holes of fewer pixels filled; missing pixels are no part of a hole."""
    return _masked(df, by, mask, lambda t: ~K.drop_small(~t.mask(mask, True), least))


def local_maxima(df: DataFrame, by: str, value: str, distance: int, floor: float, relative: float = 0.0) -> DataFrame:
    """Pixels equal to the maximum of the square around them, and above the floor and the relative share of the image's maximum."""

    def top(t: Tile) -> dict:
        image = np.where(_present(t), t.image(value), -np.inf)
        return {"_top": (image == K.square_max(image, distance)) & (image > max(floor, relative * image.max()))}

    return map_tiles(df, by, top, {"_top": BooleanType()}).where("_top").drop("_top")


def distance_transform(df: DataFrame, by: str, mask: str) -> DataFrame:
    """Adds dist, the distance of masked pixels to the nearest unmasked one of the image (null if there is none)."""

    def far(t: Tile) -> dict:
        return {"dist": K.distance(t.mask(mask, True))}

    return map_tiles(df, by, far, {"dist": DoubleType()}).withColumn("dist", F.when(F.col("dist") < float("inf"), F.col("dist")))
