"""The three detectors: masks, responses, candidates and patch features, tile by tile, and their calibration."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from tessera.operators import blobs
from tessera.operators import kernels as K
from tessera.operators.area import covered
from tessera.operators.tiles import Tile, expand, map_tiles, sample_windows, sample_windows_young


@dataclass(frozen=True)
class Preset:
    """What tells the detectors apart."""

    index: str
    share: float  # of pixels below the vegetation threshold
    otsu_factor: float
    median_factor: float
    guard: int  # pixels that Otsu's threshold needs
    no_otsu: float | None  # what stands for it; None: the calibrated threshold
    opening: float  # radius of the disk, in least crown radii
    least_object: int
    holes: tuple[int, float]  # least, and share of the least object
    least_mask_radius: float
    small: float  # least sigma of the fine blur
    large: float  # sigma of the coarse blur, in crown radii
    masked_contrast: bool
    blur: tuple[float, float] | None  # of the distance: least sigma, and in crown radii
    weights: tuple[float, float]
    gap: Callable[[float], int]  # between peaks, from the least crown radius
    relative: float  # peak floor in the tile's largest response
    area: Callable[[object], tuple[float, float]]
    radius: float
    one_each: bool  # the best peak of a component only
    capped: bool
    least_score: float
    tile: int
    overlap: int
    dark_share: float = 0.08


@dataclass(frozen=True)
class Calibration:
    crown: float
    least: float
    most: float
    spacing: float
    angle: float | None = None
    veg: float | None = None
    bright: float | None = None


# The parameters of the generic detector, of the one for young trees, and of the one that a forest judges.
GENERIC = Preset(
    index="rgb", share=0.62, otsu_factor=0.92, median_factor=0.55, guard=16, no_otsu=0.5, opening=0.20, least_object=8, holes=(16, 0.75), least_mask_radius=2.0,
    small=1.0, large=0.95, masked_contrast=True, blur=(0.6, 0.08), weights=(0.72, 0.28), gap=lambda r: max(2, round(0.85 * r)), relative=0.14,
    area=lambda c: (0.18 * math.pi * c.crown**2, 4.5 * math.pi * c.crown**2), radius=0.72, one_each=False, capped=False, least_score=0.20, tile=1024, overlap=160,
)
YOUNG = Preset(
    index="young", share=0.78, otsu_factor=0.95, median_factor=0.70, guard=32, no_otsu=None, opening=0.25, least_object=6, holes=(8, 1.0), least_mask_radius=0.0,
    small=0.8, large=1.10, masked_contrast=False, blur=None, weights=(0.70, 0.30), gap=lambda r: max(2, round(1.35 * r)), relative=0.28,
    area=lambda c: (0.65 * math.pi * c.least**2, 2.30 * math.pi * c.most**2), radius=0.70, one_each=True, capped=True, least_score=0.36, tile=1536, overlap=256,
)
HYBRID = replace(
    YOUNG, share=0.76, otsu_factor=0.92, guard=64, no_otsu=0.5, least_object=5, weights=(0.72, 0.28), gap=lambda r: max(2, int(1.1 * r)), relative=0.25,
    area=lambda c: (0.45 * math.pi * c.least**2, 2.5 * math.pi * c.most**2), capped=False, least_score=0.22,
)
CHANNELS = ("red", "green", "blue", "exg", "gli", "brightness", "saturation", "green_dom", "veg")
FEATURES = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "std", "p25", "p75", "center")] + ["score", "area_px", "radius_px", "local_contrast", "green_ratio"]


def thresholds(veg: np.ndarray, bright: np.ndarray, preset: Preset, calibration: Calibration | None = None) -> tuple[float, float]:
    """Of vegetation and brightness: from the tile alone, or from the calibration and the tile."""
    split = veg.size > preset.guard and float(veg.max() - veg.min()) > K.EPS
    known = calibration is not None and calibration.veg is not None
    otsu = K.otsu(veg.ravel()) if split else preset.no_otsu if preset.no_otsu is not None else calibration.veg if known else 0.5
    low = calibration.veg if known else float(np.quantile(veg, preset.share))
    dark = calibration.bright if known else float(np.quantile(bright, preset.dark_share))
    return max(low, otsu * preset.otsu_factor), min(dark, float(np.median(bright)) * preset.median_factor)


def raw_mask(veg: np.ndarray, bright: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
    return (veg >= limits[0] - 1e-9) & (bright >= limits[1] - 1e-9)


def clean(mask: np.ndarray, preset: Preset, least: float) -> np.ndarray:
    """Opened and closed, without small parts and holes. least: the least crown radius."""
    r = max(preset.least_mask_radius, least)
    disk, size = max(1, round(r * preset.opening)), max(preset.least_object, int(math.pi * (0.45 * r) ** 2))
    out = K.drop_small(K.closing(K.opening(mask, disk), disk), size)
    return K.fill_holes(out, max(preset.holes[0], int(preset.holes[1] * size)))


def response(veg: np.ndarray, mask: np.ndarray, preset: Preset, crown: float) -> np.ndarray:
    """Contrast of two blurs and distance to the mask's edge, rescaled and weighted; 0 off the mask."""
    small = max(preset.small, 0.22 * crown)
    contrast = K.gaussian(veg, small) - K.gaussian(veg, max(small + 0.5, preset.large * crown))
    if preset.masked_contrast:
        contrast = np.where(mask, contrast, 0.0)
    far = K.distance(mask)
    far = np.where(np.isfinite(far), far, 0.0)
    if preset.blur:
        far = K.gaussian(far, max(preset.blur[0], preset.blur[1] * crown))
    a, b = preset.weights
    return K.rescale(np.where(mask, a * K.rescale(contrast) + b * K.rescale(far), 0.0))


def candidates_of(veg: np.ndarray, bright: np.ndarray, preset: Preset, calibration: Calibration, box: tuple[int, int, int, int], area: np.ndarray | None = None, least_score: float | None = None) -> list[tuple[int, int, float, float, float]]:
    """x, y, score, area and radius of a tile's candidates, within the box (x0, y0, x1, y1) that the tile owns and the area."""
    if area is not None and not area.any():
        return []
    mask = clean(raw_mask(veg, bright, thresholds(veg, bright, preset, calibration)), preset, calibration.least)
    if area is not None:
        mask &= area
    strength = response(veg, mask, preset, calibration.crown)
    labels = K.components(mask)
    sizes = K.sizes_of(labels)
    floor = preset.least_score if least_score is None else least_score
    low, high = preset.area(calibration)
    out, taken = [], set()
    for y, x in K.peaks(strength, preset.gap(calibration.least), max(floor, preset.relative * float(strength.max(initial=0)))).tolist():
        size = float(sizes[y, x])
        if not (box[0] <= x < box[2] and box[1] <= y < box[3]) or not low <= size <= high or (preset.one_each and not size):
            continue
        if preset.one_each and labels[y, x] in taken:  # peaks come from the highest down
            continue
        taken.add(labels[y, x])
        out.append((x, y, float(strength[y, x]), size, float(np.clip(math.sqrt(max(size, 1.0) / math.pi) * preset.radius, calibration.least, calibration.most))))
    if preset.capped:
        out = out[: max(25, int(1.6 * veg.size / max(1.0, (0.70 * calibration.spacing) ** 2)))]
    return out


def _bands(tile: Tile, bands: tuple[str, ...], scaled: bool) -> list[np.ndarray]:
    return [K.rescale(tile.image(b)) if scaled else tile.image(b) for b in bands]


def _veg(bands: list[np.ndarray], preset: Preset) -> np.ndarray:
    return K.vegetation("nir" if len(bands) > 3 and preset.index == "rgb" else preset.index, *bands)


def vegetation(pixels: DataFrame, by: str, kind: str, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Adds veg, of bands as they are."""
    return map_tiles(pixels, by, lambda t: {"veg": K.vegetation(kind, *_bands(t, bands, False))}, {"veg": DoubleType()})


def masks(pixels: DataFrame, by: str, preset: Preset, cleaned: float | None = None, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Adds veg, brightness thresholds (veg_threshold, bright_threshold) and the mask m; cleaned: the least crown radius."""

    def run(t: Tile) -> dict:
        own = _bands(t, bands, False)
        veg, bright = _veg(own, preset), sum(own[:3]) / 3
        limits = thresholds(veg, bright, preset)
        m = raw_mask(veg, bright, limits)
        return {"veg": veg, "veg_threshold": np.full(t.shape, limits[0]), "bright_threshold": np.full(t.shape, limits[1]), "m": m if cleaned is None else clean(m, preset, cleaned)}

    return map_tiles(pixels, by, run, {"veg": DoubleType(), "veg_threshold": DoubleType(), "bright_threshold": DoubleType(), "m": BooleanType()})


def channels(pixels: DataFrame, by: str) -> DataFrame:
    """Adds the images that patch features are taken from, of red, green and blue as they are."""
    names = [c for c in CHANNELS if c not in ("red", "green", "blue")]
    return map_tiles(pixels, by, lambda t: K.channels(*_bands(t, ("red", "green", "blue"), False)), {n: DoubleType() for n in names})


def responses(pixels: DataFrame, by: str, value: str, mask: str, preset: Preset, crown: float) -> DataFrame:
    """Adds response, from a vegetation index and a mask."""
    return map_tiles(pixels, by, lambda t: {"response": response(t.image(value), t.mask(mask), preset, crown)}, {"response": DoubleType()})


class Grid:
    """Where tiles lie; a tile's number gives its window."""

    def __init__(self, width: int, height: int, size: int, overlap: int):
        if size <= overlap:
            raise ValueError("the overlap must be smaller than the tile")
        self.width, self.height, self.size, self.overlap = width, height, size, overlap
        self.stride, self.columns = size - overlap, -(-width // (size - overlap))

    def window(self, tile: int) -> tuple[int, int, int, int]:
        """Left, top, width, height."""
        left, top = tile % self.columns * self.stride, tile // self.columns * self.stride
        return left, top, min(self.size, self.width - left), min(self.size, self.height - top)

    def box(self, tile: int) -> tuple[int, int, int, int]:
        left, top, w, h = self.window(tile)
        m = self.overlap // 2
        return m if left else 0, m if top else 0, w - (m if left + w < self.width else 0), h - (m if top + h < self.height else 0)


def _images(table: pa.Table, grid: Grid, tile: int, bands: tuple[str, ...], scaled: bool) -> list[np.ndarray]:
    """The whole window's bands, 0 where the raster has no pixel."""
    left, top, w, h = grid.window(tile)
    at = (table["prow"].to_numpy() - top, table["pcol"].to_numpy() - left)
    out = []
    for b in bands:
        image = np.zeros((h, w))
        image[at] = np.nan_to_num(table[b].to_numpy().astype(float))
        out.append(K.rescale(image) if scaled else image)
    return out


def detect(
    pixels: DataFrame, width: int, height: int, preset: Preset, calibration: Calibration, bands: tuple[str, ...] = ("red", "green", "blue"),
    area: DataFrame | None = None, features: bool = False, least_score: float | None = None, scaled: bool = True,
) -> DataFrame:
    """tile_id, x, y, score, area, radius (and features, in the order of FEATURES) of all candidates of a raster.

    pixels: prow, pcol and bands. area: polygons (rings, in pixels): only what they touch is searched, and tiles that none
    touches are skipped. Each tile is one task's work, with all its steps in one pass; a candidate is reported by the one
    tile whose own part of the overlap it lies in. Null bands count as 0; an empty raster gives no candidates."""
    grid = Grid(width, height, preset.tile, preset.overlap)
    schema = StructType([StructField("tile_id", IntegerType()), *[StructField(n, DoubleType()) for n in ("x", "y", "score", "area", "radius")], *([StructField("features", ArrayType(DoubleType()))] if features else [])])

    def run(table: pa.Table, polygons: list | None) -> pa.Table:
        rows = []
        if table.num_rows:
            tile = table["tile_id"][0].as_py()
            left, top, w, h = grid.window(tile)
            own = None if polygons is None else np.zeros((h, w), bool)
            for rings in polygons or ():
                own |= covered(rings, left, top, w, h)
            if own is None or own.any():
                images = _images(table, grid, tile, bands, scaled)
                veg, bright = _veg(images, preset), sum(images[:3]) / 3
                found = candidates_of(veg, bright, preset, calibration, grid.box(tile), own, least_score)
                nine = K.channels(*images[:3]) if features and found else {}
                for x, y, score, size, radius in found:
                    more = [_vector(nine, y, x, calibration.crown, score, size, radius)] if features else []
                    rows.append((tile, float(x + left), float(y + top), score, size, radius, *more))
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.float64()] * 5, pa.list_(pa.float64())], strict=False)], names=schema.names)

    tiled = expand(pixels.select("prow", "pcol", *bands), width, preset.tile, preset.overlap).withColumn("tile_id", F.col("tile_id").cast("int"))
    if area is None:
        return tiled.groupBy("tile_id").applyInArrow(lambda table: run(table, None), schema)
    near = area_by_tile(area, grid)
    return tiled.groupBy("tile_id").cogroup(near.groupBy("tile_id")).applyInArrow(lambda table, polygons: run(table, polygons["rings"].to_pylist()), schema)


def _vector(nine: dict[str, np.ndarray], y: float, x: float, crown: float, score: float, size: float, radius: float) -> list[float]:
    got = K.patch_features(nine, y, x, crown)
    return [*got[:-2], score, size, radius, *got[-2:]]


def area_by_tile(area: DataFrame, grid: Grid) -> DataFrame:
    """tile_id, rings: each polygon (rings: arrays of [x, y], in pixels) for the tiles that its box meets."""
    ends = F.transform("rings", lambda r: F.struct(F.array_min(F.transform(r, lambda p: p[0])).alias("x0"), F.array_min(F.transform(r, lambda p: p[1])).alias("y0"), F.array_max(F.transform(r, lambda p: p[0])).alias("x1"), F.array_max(F.transform(r, lambda p: p[1])).alias("y1")))
    boxed = area.select("rings", ends.alias("_e")).select("rings", F.array_min("_e.x0").alias("x0"), F.array_min("_e.y0").alias("y0"), F.array_max("_e.x1").alias("x1"), F.array_max("_e.y1").alias("y1"))

    def axis(low: str, high: str, extent: int):
        last = -(-extent // grid.stride) - 1
        first = F.greatest(F.lit(0), F.ceil((F.floor(F.col(low)) - grid.size + 1) / grid.stride)).cast("int")
        return F.when(F.col(high) >= 0, F.sequence(first, F.greatest(first, F.least(F.lit(last), F.floor(F.col(high) / grid.stride))).cast("int")))

    met = boxed.where((F.col("x0") <= grid.width) & (F.col("y0") <= grid.height)).withColumn("ri", F.explode(axis("y0", "y1", grid.height))).withColumn("ci", F.explode(axis("x0", "x1", grid.width)))
    return met.select((F.col("ri") * grid.columns + F.col("ci")).cast("int").alias("tile_id"), "rings")


def area_pixels(area: DataFrame, width: int, height: int, size: int = 1024) -> DataFrame:
    """prow, pcol of the raster's pixels that the polygons (rings, in pixels) touch, whichever and however many."""
    grid = Grid(width, height, size, 0)

    def run(table: pa.Table) -> pa.Table:
        left, top, w, h = grid.window(table["tile_id"][0].as_py())
        whole = np.zeros((h, w), bool)
        for rings in table["rings"].to_pylist():  # polygons that overlap don't cancel out
            whole |= covered(rings, left, top, w, h)
        row, col = np.nonzero(whole)
        return pa.table({"prow": pa.array((row + top).astype(np.int32)), "pcol": pa.array((col + left).astype(np.int32))})

    return area_by_tile(area, grid).groupBy("tile_id").applyInArrow(run, "prow int, pcol int")


def _in_windows(pixels: DataFrame, windows: DataFrame, size: int, bands: tuple[str, ...]) -> DataFrame:
    """_left, _top, prow, pcol and bands of the pixels of windows (_col, _row: corners, in whole pixels) of that size."""
    cell = lambda c, o: F.explode(F.sequence(F.floor(F.col(o) / size).cast("int"), F.floor((F.col(o) + size - 1) / size).cast("int"))).alias(c)
    cells = windows.select("_col", "_row", cell("ci", "_col")).select("*", cell("ri", "_row"))
    here = pixels.select("prow", "pcol", *bands).withColumns({"ri": F.floor(F.col("prow") / size).cast("int"), "ci": F.floor(F.col("pcol") / size).cast("int")})
    inside = here.join(cells, ["ri", "ci"]).where((F.col("prow") >= F.col("_row")) & (F.col("prow") < F.col("_row") + size) & (F.col("pcol") >= F.col("_col")) & (F.col("pcol") < F.col("_col") + size))
    return inside.select(F.col("_col").alias("_left"), F.col("_row").alias("_top"), "prow", "pcol", *bands)


def corners(points: DataFrame, width: int, height: int, size: int, crown: float) -> DataFrame:
    """points with _col and _row, the corner of the window of that size round each, within the raster."""
    half = int(max(size // 2, 4 * crown))
    off = lambda c, extent: F.least(F.greatest(F.col(c) - half, F.lit(0.0)), F.lit(float(max(0, extent - size)))).cast("int")
    return points.withColumns({"_col": off("x", width), "_row": off("y", height)})


def _window_images(table: pa.Table, left: int, top: int, w: int, h: int, bands: tuple[str, ...], scaled: bool) -> list[np.ndarray]:
    out = []
    for b in bands[:3]:
        image = np.zeros((h, w))
        if table.num_rows:
            image[table["prow"].to_numpy() - top, table["pcol"].to_numpy() - left] = np.nan_to_num(table[b].to_numpy().astype(float))
        out.append(K.rescale(image) if scaled else image)
    return out


def propose_in_windows(pixels: DataFrame, windows: DataFrame, width: int, height: int, size: int, preset: Preset, calibration: Calibration, least_score: float, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """x, y, score, area, radius and features of the candidates of each window (_col, _row)."""
    schema = StructType([*[StructField(n, DoubleType()) for n in ("x", "y", "score", "area", "radius")], StructField("features", ArrayType(DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        left, top = table["_left"][0].as_py(), table["_top"][0].as_py()
        w, h = min(size, width - left), min(size, height - top)
        images = _window_images(table, left, top, w, h, bands, True)
        found = candidates_of(_veg(images, preset), sum(images) / 3, preset, calibration, (0, 0, w, h), None, least_score)
        nine = K.channels(*images) if found else {}
        rows = [(float(x + left), float(y + top), score, area, radius, _vector(nine, y, x, calibration.crown, score, area, radius)) for x, y, score, area, radius in found]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, [*[pa.float64()] * 5, pa.list_(pa.float64())], strict=True)], names=schema.names)

    return _in_windows(pixels, windows.select("_col", "_row").distinct(), size, bands).groupBy("_left", "_top").applyInArrow(run, schema)


def features_at(pixels: DataFrame, points: DataFrame, width: int, height: int, size: int, crown: float, bands: tuple[str, ...] = ("red", "green", "blue"), scaled: bool = True) -> DataFrame:
    """points (id, x, y, score, area, radius and others) with features, from the window of that size around each point, clipped
    to the raster. Points of one window are judged together; a null radius counts as the crown's."""
    placed = corners(points, width, height, size, crown)
    inside = _in_windows(pixels, placed.select("_col", "_row").distinct(), size, bands)
    names, schema = points.columns, StructType([*points.schema.fields, StructField("features", ArrayType(DoubleType()))])

    def run(table: pa.Table, at: pa.Table) -> pa.Table:
        out = at.select(names)
        if not at.num_rows:
            return out.append_column("features", pa.array([], pa.list_(pa.float64())))
        left, top = at["_col"][0].as_py(), at["_row"][0].as_py()
        nine = K.channels(*_window_images(table, left, top, min(size, width - left), min(size, height - top), bands, scaled))
        rows = zip(*(at[c].to_pylist() for c in ("x", "y", "score", "area", "radius")), strict=True)
        got = [_vector(nine, y - top, x - left, crown, s or 0.0, a or 0.0, r or crown) for x, y, s, a, r in rows]
        return out.append_column("features", pa.array(got, pa.list_(pa.float64())))

    return inside.groupBy("_left", "_top").cogroup(placed.groupBy("_col", "_row")).applyInArrow(run, schema)


def given_spacing(spacing_px: float, least: float | None = None, most: float | None = None) -> Calibration:
    """Radii of young trees from their known spacing."""
    low = least or max(2.0, 0.12 * spacing_px)
    high = most or max(low + 1.0, 0.42 * spacing_px)
    return Calibration(float(np.clip(0.25 * spacing_px, low, high)), low, high, spacing_px)


def spacing_radii(spacing_px: float) -> Calibration:
    """Radii of the detector that a forest judges, from the spacing of reference points."""
    return Calibration(float(np.clip(0.25 * spacing_px, 4, 40)), max(2.0, 0.12 * spacing_px), max(6.0, 0.45 * spacing_px), spacing_px)


def _windows(spark: SparkSession, pixels: DataFrame, windows: list[tuple[int, int, int, int]], bands: tuple[str, ...]) -> DataFrame:
    """The pixels of a few windows, as tiles (a window's place in the list is its tile_id)."""
    known = spark.createDataFrame([(k, *w) for k, w in enumerate(windows)], "tile_id int, l int, t int, w int, h int")
    inside = (F.col("prow") >= F.col("t")) & (F.col("prow") < F.col("t") + F.col("h")) & (F.col("pcol") >= F.col("l")) & (F.col("pcol") < F.col("l") + F.col("w"))
    return pixels.select("prow", "pcol", *bands).join(F.broadcast(known), inside).select("tile_id", "prow", "pcol", *bands)  # nine rows at most, by default


def window_evidence(spark: SparkSession, pixels: DataFrame, windows: list[tuple[int, int, int, int]], preset: Preset, fallback: float | None, least: float | None = None, most: float | None = None, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Evidence of the sample windows: a row per window with its thresholds (kind "limits"), and, with a fallback radius, its
    components and blobs (kind "object": x, y, radius, score)."""
    schema = "tile_id int, kind string, x double, y double, radius double, score double, veg double, bright double"

    def run(table: pa.Table) -> pa.Table:
        tile, key = Tile(table), table["tile_id"][0].as_py()
        own = _bands(tile, bands, True)
        veg, light = _veg(own, preset), sum(own[:3]) / 3
        limits = thresholds(veg, light, preset)
        rows = [(key, "limits", None, None, None, None, *limits)]
        if fallback:
            about = Calibration(fallback, 0.55 * fallback, 1.8 * fallback, 4 * fallback, None, *limits)
            mask = clean(raw_mask(veg, light, thresholds(veg, light, preset, about)), preset, about.least)
            labels = K.components(mask)
            # The least and the largest component that counts, its radius and score; what is kept of blobs.
            for label, size in zip(*np.unique(labels[labels >= 0], return_counts=True), strict=True):
                if 20 <= size <= max(80, math.pi * (3.2 * fallback) ** 2):
                    r, c = np.nonzero(labels == label)
                    rows.append((key, "object", float(c.mean() + tile.left), float(r.mean() + tile.top), math.sqrt(size / math.pi) * 0.72, 0.65, None, None))
            found = blobs.find(veg * mask, blobs.scales(least, most))
            if len(found):
                strength = response(veg, mask, preset, float(np.median(found[:, 2])))
                score = strength[found[:, 0].astype(int), found[:, 1].astype(int)]
                keep = score >= max(0.08, float(np.quantile(score, 0.45)))
                rows += [(key, "object", float(c + tile.left), float(r + tile.top), float(radius), float(s), None, None) for (r, c, radius), s in zip(found[keep, :3], score[keep], strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.string(), *[pa.float64()] * 6], strict=True)], names=["tile_id", "kind", "x", "y", "radius", "score", "veg", "bright"])

    return _windows(spark, pixels, windows, bands).groupBy("tile_id").applyInArrow(run, schema)


def calibrate_generic(spark: SparkSession, pixels: DataFrame, width: int, height: int, least: float | None = None, most: float | None = None, spacing: float | None = None, bands: tuple[str, ...] = ("red", "green", "blue"), windows: int = 9, preset: Preset = GENERIC) -> Calibration:
    """Crown size, spacing, row angle and thresholds from sample windows."""
    from tessera.operators.state import materialize

    evidence = materialize(window_evidence(spark, pixels, sample_windows(width, height, preset.tile, windows), preset, least or 8.0, least, most, bands), "evidence")
    found = estimate(evidence.where("kind = 'object'").select("x", "y", "radius", "score"))
    limits = evidence.where("kind = 'limits'").agg(F.median("veg").alias("veg"), F.median("bright").alias("bright")).first()
    # What stands for radii, spacing and thresholds that nothing tells.
    crown = float(least or (np.clip(found["radius"], 3.0, 40.0) if found["radius"] is not None else 8.0))
    low = float(least or max(2.5, 0.55 * crown))
    return Calibration(
        crown, low, float(most or max(low + 1, 1.85 * crown)), float(spacing or found["spacing"] or 3.5 * crown), found["angle"],
        limits.veg if limits.veg is not None else 0.45, limits.bright if limits.bright is not None else 0.08,
    )


def calibrate_young(spark: SparkSession, pixels: DataFrame, width: int, height: int, spacing_px: float, least: float | None = None, most: float | None = None, bands: tuple[str, ...] = ("red", "green", "blue"), preset: Preset = YOUNG) -> Calibration:
    """Radii from the known spacing, thresholds from sample windows."""
    evidence = window_evidence(spark, pixels, sample_windows_young(width, height, preset.tile), preset, None, bands=bands)
    limits = evidence.agg(F.median("veg").alias("veg"), F.median("bright").alias("bright")).first()
    return replace(given_spacing(spacing_px, least, most), veg=limits.veg, bright=limits.bright)


def estimate(objects: DataFrame) -> dict[str, float | None]:
    """Radius, spacing and row angle from objects (x, y, radius, score): thinned to one of those nearer than 1.65 median radii,
    if eight are left. None where fewer than eight objects, or no neighbours, tell."""
    from tessera.operators import spatial
    from tessera.operators.state import materialize

    numbered = materialize(objects.withColumn("id", F.monotonically_increasing_id()), "objects")
    about = numbered.agg(F.count(F.lit(1)).alias("n"), F.median("radius").alias("r")).first()
    if about.n < 8:
        return {"radius": None, "spacing": None, "angle": None}
    thinned = spatial.suppress(numbered, max(3.0, 1.65 * about.r), [(-F.col("score")).alias("s"), F.col("id").alias("k")])
    points = thinned if thinned.count() >= 8 else numbered
    weight = F.least(F.greatest("score", F.lit(0.05)), F.lit(1.0))
    radius = points.agg((F.sum(F.col("radius") * weight) / F.sum(weight)).alias("r"), F.median("radius").alias("m")).first()
    near = spatial.nearest_within(points, 6, max(12.0, 8 * radius.m))
    spacing = near.where(F.col("dist") > max(2, 2.4 * radius.m)).agg(F.percentile("dist", F.lit(0.35)).alias("s")).first().s
    angle = None
    if spacing is not None and points.count() >= 12:
        pairs = spatial.range_pairs(points, max(12.0, 1.65 * spacing))
        angle = spatial.row_angle_circular(pairs, spacing).first().angle
    return {"radius": radius.r, "spacing": spacing, "angle": angle}


def reference_spacing(points: DataFrame, fallback: float) -> float:
    """Median distance of reference points (id, x, y) to their nearest; the fallback for fewer than eight points."""
    from tessera.operators import spatial

    if points.count() < 8:
        return fallback
    got = spatial.nearest_within(points, 1, fallback).agg(F.median("dist").alias("m")).first().m
    return fallback if got is None else got


def as_dict(calibration: Calibration) -> dict:
    return asdict(calibration)
