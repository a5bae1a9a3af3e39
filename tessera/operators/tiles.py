"""Tile windows, and pixels expanded to the tiles that hold them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StructField, StructType


def tile_grid(spark: SparkSession, width: int, height: int, size: int, overlap: int) -> DataFrame:
    """Row-major windows, truncated at the edges, with the half-open box each owns."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("the overlap must be smaller than the tile")
    columns, margin = -(-width // stride), overlap // 2
    rows = spark.range(-(-height // stride)).select(F.col("id").cast("int").alias("ri")).withColumn("ci", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    t = rows.select((F.col("ri") * columns + F.col("ci")).alias("tile_id"), (F.col("ci") * stride).alias("col_off"), (F.col("ri") * stride).alias("row_off"))
    t = t.withColumns({"w": F.least(F.lit(size), width - F.col("col_off")), "h": F.least(F.lit(size), height - F.col("row_off"))})
    return t.withColumns({
        "x0": F.when(F.col("col_off") > 0, margin).otherwise(0), "y0": F.when(F.col("row_off") > 0, margin).otherwise(0),
        "x1": F.col("w") - F.when(F.col("col_off") + F.col("w") < width, margin).otherwise(0), "y1": F.col("h") - F.when(F.col("row_off") + F.col("h") < height, margin).otherwise(0),
    })


def expand(pixels: DataFrame, width: int, size: int, overlap: int) -> DataFrame:
    """Each pixel once for every tile that holds it: an explode by arithmetic, no join."""
    stride = size - overlap
    columns = -(-width // stride)
    axis = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int"), F.floor(F.col(c) / stride).cast("int"))
    out = pixels.withColumn("ri", F.explode(axis("prow"))).withColumn("ci", F.explode(axis("pcol")))
    return out.withColumn("tile_id", F.col("ri") * columns + F.col("ci")).drop("ri", "ci")


def expand_halo(pixels: DataFrame, width: int, height: int, size: int, halo: int) -> DataFrame:
    """Each pixel for the tile that owns it, and for those whose halo it lies in; adds tile_id and own."""
    last = lambda extent: (extent - 1) // size
    axis = lambda c, extent: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)).cast("int"), F.least(F.lit(last(extent)), F.floor((F.col(c) + halo) / size)).cast("int"))
    out = pixels.withColumn("ri", F.explode(axis("prow", height))).withColumn("ci", F.explode(axis("pcol", width)))
    own = (F.floor(F.col("prow") / size) == F.col("ri")) & (F.floor(F.col("pcol") / size) == F.col("ci"))
    return out.withColumns({"tile_id": F.col("ri") * (last(width) + 1) + F.col("ci"), "own": own}).drop("ri", "ci")


def read_window(pixels: DataFrame, left: int, top: int, width: int, height: int, bands: list[str]) -> DataFrame:
    """prow, pcol (from the window's corner) and bands of every place of the window, 0 where the raster has no pixel."""
    here = pixels.where(F.col("prow").between(top, top + height - 1) & F.col("pcol").between(left, left + width - 1))
    here = here.select((F.col("prow") - top).cast("int").alias("prow"), (F.col("pcol") - left).cast("int").alias("pcol"), *bands)
    grid = pixels.sparkSession.range(height).select(F.col("id").cast("int").alias("prow")).withColumn("pcol", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(here, ["prow", "pcol"], "left").fillna(0, bands)


class Tile:
    """The pixels of one tile as images of its bounding box."""

    def __init__(self, table: pa.Table):
        self.table = table
        row, col = table["prow"].to_numpy().astype(np.int64), table["pcol"].to_numpy().astype(np.int64)
        self.top, self.left = int(row.min()), int(col.min())
        self.at = (row - self.top, col - self.left)
        self.shape = (int(self.at[0].max()) + 1, int(self.at[1].max()) + 1)

    def image(self, name: str) -> np.ndarray:
        """float64, with 0 for nulls and missing pixels."""
        out = np.zeros(self.shape)
        out[self.at] = np.nan_to_num(self.table[name].to_numpy().astype(float), nan=0.0) if self.table[name].null_count else self.table[name].to_numpy()
        return out

    def mask(self, name: str, missing: bool = False) -> np.ndarray:
        out = np.full(self.shape, missing)
        out[self.at] = self.table[name].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        return out


def map_tiles(df: DataFrame, by: str, f: Callable[[Tile], dict[str, np.ndarray]], adds: dict[str, DataType]) -> DataFrame:
    """df (by, prow, pcol and others) with the images that f makes of each tile, as columns; a column of the same name is
    replaced. One pass and one exchange by tile; a task holds one tile, whose fixed size bounds its memory."""
    kept = [x for x in df.schema.fields if x.name not in adds]
    schema = StructType([*kept, *[StructField(n, t) for n, t in adds.items()]])

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        images = f(tile)
        out = table.select([x.name for x in kept])
        for n, t in adds.items():
            out = out.append_column(n, pa.array(images[n][tile.at], pa.bool_() if isinstance(t, BooleanType) else None))
        return out

    return df.groupBy(by).applyInArrow(run, schema)


def sample_windows(width: int, height: int, size: int, n: int) -> list[tuple[int, int, int, int]]:
    """The first n windows around a square grid of centres; the middle one alone for n of 1."""
    w, h = min(size, width), min(size, height)
    side = max(1, math.ceil(math.sqrt(n)))
    centres = lambda extent, own: [extent / 2] if n <= 1 else [own / 2 + k * (extent - own) / max(1, side - 1) for k in range(side)]
    clip = lambda c, own, extent: int(min(max(c - own / 2, 0), extent - own))
    return [(clip(x, w, width), clip(y, h, height), w, h) for y in centres(height, h) for x in centres(width, w)][: max(1, n)]


def sample_windows_young(width: int, height: int, size: int) -> list[tuple[int, int, int, int]]:
    """Windows around the middle and the four quarter points."""
    size = min(size, width, height)
    clip = lambda c, extent: int(min(max(c - size / 2, 0), max(0, extent - size)))
    # The shares of width and height.
    return [(clip(width * x, width), clip(height * y, height), size, size) for x, y in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75))]
