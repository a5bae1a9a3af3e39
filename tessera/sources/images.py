"""Images of detections: PNG previews, annotated rasters, and debug images of a window."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import detectors
from tessera.operators import kernels as K
from tessera.operators.detection import marks_by_tile
from tessera.operators.state import materialize, release
from tessera.sources.files import open_write

# The colours of rings, centres and rims.
YELLOW, RED, BLACK = (255, 255, 0), (255, 0, 0), (0, 0, 0)
STRIP = 256


def as_bytes(image: np.ndarray) -> np.ndarray:
    """0 to 1 as 0 to 255, cut off."""
    return (np.clip(image, 0, 1) * 255).astype(np.uint8)


def circle(image: np.ndarray, x: float, y: float, radius: float, color: tuple[int, int, int], thickness: int = 0) -> None:
    """A disk (thickness 0), or a ring of that thickness, drawn into rows x columns x 3; what lies outside is left out."""
    reach = int(radius + thickness) + 1
    top, left = max(0, int(y) - reach), max(0, int(x) - reach)
    part = image[top : max(0, int(y) + reach + 1), left : max(0, int(x) + reach + 1)]
    if part.size:
        r, c = np.ogrid[top : top + part.shape[0], left : left + part.shape[1]]
        far = np.hypot(r - y, c - x)
        part[(far <= radius + 0.5) if not thickness else (np.abs(far - radius) <= thickness / 2)] = color


def write_png(path: str, width: int, height: int, strips: Iterable[np.ndarray], channels: int = 3) -> None:
    """Strips of rows, from the top down, as one image; they are compressed one by one."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    squeeze = zlib.compressobj(6)
    with open_write(path) as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)))
        for strip in strips:
            rows = strip.reshape(len(strip), -1)
            data = squeeze.compress(np.pad(rows, ((0, 0), (1, 0))).astype(np.uint8).tobytes())
            if data:
                out.write(chunk(b"IDAT", data))
        out.write(chunk(b"IDAT", squeeze.flush()) + chunk(b"IEND", b""))


def _draw(image: np.ndarray, marks: pa.Table, top: int) -> None:
    for x, y, r, kind in zip(*(marks[c].to_pylist() for c in ("x", "y", "r", "kind")), strict=True):
        if kind == "dot":
            circle(image, x, y - top, r, YELLOW)
            circle(image, x, y - top, r + 1, BLACK, 1)
        else:
            circle(image, x, y - top, r, YELLOW, 2 if kind == "ring2" else 1)
            circle(image, x, y - top, 1, RED)


def write_preview(pixels: DataFrame, marks: DataFrame, path: str, width: int, height: int, most: int = 5000, bands: tuple[str, str, str] = ("red", "green", "blue")) -> tuple[int, int]:
    """A PNG of at most that many pixels a side; its width and height. Bands are averaged over each of its pixels and
    rescaled over the whole image. marks: x, y, r (in pixels of the raster) and kind (ring, ring2 or dot; dots keep
    their size). Strips are drawn by tasks; the driver streams one at a time into the file."""
    scale = min(1.0, most / max(width, height))
    w, h = max(1, int(width * scale)), max(1, int(height * scale))
    at = lambda c, n: F.least(F.floor(F.col(c) * scale), F.lit(n - 1)).cast("int")
    small = materialize(pixels.groupBy(at("prow", h).alias("prow"), at("pcol", w).alias("pcol")).agg(*[F.avg(b).alias(b) for b in bands]), "preview")
    ends = small.agg(*[F.percentile(b, F.array(F.lit(0.02), F.lit(0.98))).alias(b) for b in bands]).first()
    limits = [tuple(ends[b] or (0.0, 0.0)) for b in bands]
    # Places and radii of the preview, halves to even.
    placed = marks.select((F.bround(F.col("x") * scale)).alias("x"), F.bround(F.col("y") * scale).alias("y"), F.when(F.col("kind") == "dot", F.col("r")).otherwise(F.greatest(F.lit(2.0), F.bround(F.col("r") * scale))).cast("double").alias("r"), "kind")
    reach = F.explode(F.sequence(F.floor((F.col("y") - F.col("r") - 3) / STRIP).cast("int"), F.floor((F.col("y") + F.col("r") + 3) / STRIP).cast("int")))
    near = placed.withColumn("s", reach)

    def draw(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"strip": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        number = int(table["s"][0].as_py())
        image = np.zeros((min(STRIP, h - number * STRIP), w, 3), np.uint8)
        spot = table["prow"].to_numpy() - number * STRIP, table["pcol"].to_numpy()
        for k, (band, (lo, hi)) in enumerate(zip(bands, limits, strict=True)):
            image[(*spot, k)] = as_bytes((np.nan_to_num(table[band].to_numpy().astype(float)) - lo) / (hi - lo)) if hi > lo else 0
        _draw(image, own, number * STRIP)
        return pa.table({"strip": pa.array([number], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    strips = small.withColumn("s", F.floor(F.col("prow") / STRIP).cast("int")).groupBy("s").cogroup(near.groupBy("s")).applyInArrow(draw, "strip int, data binary")
    made = materialize(strips, "strips")

    def rows() -> Iterator[np.ndarray]:
        due = 0
        for row in made.orderBy("strip").toLocalIterator():
            while due < row["strip"]:
                yield np.zeros((STRIP, w, 3), np.uint8)
                due += 1
            yield np.frombuffer(bytes(row["data"]), np.uint8).reshape(-1, w, 3)
            due += 1
        while due * STRIP < h:
            yield np.zeros((min(STRIP, h - due * STRIP), w, 3), np.uint8)
            due += 1

    write_png(path, w, h, rows())
    release(small, made)
    return w, h


def annotated(pixels: DataFrame, points: DataFrame, width: int, height: int, size: int = 1024, bands: tuple[str, str, str] = ("red", "green", "blue")) -> DataFrame:
    """row, col, red, green, blue (0 to 255) of the raster, rescaled tile by tile, with a ring round each point (id, x, y, r)."""
    columns = -(-width // size)
    tiled = pixels.select((F.floor(F.col("prow") / size) * columns + F.floor(F.col("pcol") / size)).cast("int").alias("tile_id"), "prow", "pcol", *bands)
    round_ = lambda c: F.bround(F.col(c).cast("double"))
    marks = marks_by_tile(points.select("id", round_("x").alias("x"), round_("y").alias("y"), (round_("r") + 2).alias("r")), size, width, height)
    marks = marks.select((F.floor(F.col("row_off") / size) * columns + F.floor(F.col("col_off") / size)).cast("int").alias("tile_id"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), (F.col("r") - 2).cast("double").alias("r"), F.lit("ring2").alias("kind"))

    def draw(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("row", "col", "red", "green", "blue"), [pa.int32()] * 5, strict=True)})
        tile = table["tile_id"][0].as_py()
        top, left = tile // columns * size, tile % columns * size
        spot = table["prow"].to_numpy() - top, table["pcol"].to_numpy() - left
        image = np.zeros((min(size, height - top), min(size, width - left), 3), np.uint8)
        for k, band in enumerate(bands):
            plane = np.zeros(image.shape[:2])
            plane[spot] = np.nan_to_num(table[band].to_numpy().astype(float))
            image[:, :, k] = as_bytes(K.rescale(plane))
        _draw(image, own, 0)
        values = [spot[0] + top, spot[1] + left, *(image[(*spot, k)] for k in range(3))]
        return pa.table({n: pa.array(v.astype(np.int32)) for n, v in zip(("row", "col", "red", "green", "blue"), values, strict=True)})

    return tiled.groupBy("tile_id").cogroup(marks.groupBy("tile_id")).applyInArrow(draw, "row int, col int, red int, green int, blue int")


def write_debug(bands: list[np.ndarray], preset: detectors.Preset, calibration: detectors.Calibration, folder: str) -> None:
    """Vegetation index, mask and response of one window (rescaled bands), as grey PNGs."""
    veg, bright = K.vegetation(preset.index, *bands[:3]), sum(bands[:3]) / 3
    mask = detectors.clean(detectors.raw_mask(veg, bright, detectors.thresholds(veg, bright, preset, calibration)), preset, calibration.least)
    images = {"debug_vegetation_index": veg, "debug_crown_mask": mask.astype(float), "debug_peak_response": detectors.response(veg, mask, preset, calibration.crown)}
    for name, image in images.items():
        write_png(f"{folder}/{name}.png", image.shape[1], image.shape[0], [as_bytes(image)], 1)
