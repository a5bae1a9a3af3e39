"""Whole runs: a raster in, a folder of results out."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import detectors, forest, ranking, spatial, stats, training
from tessera.operators.state import materialize, release
from tessera.sources import bundle, geopackage, images, text
from tessera.sources.geotiff import Raster, raster_meta, read_raster, write_raster


def bands_of(spark: SparkSession, path: str, rgb: tuple[int, int, int], nir: int | None = None) -> tuple[Raster, DataFrame, tuple[str, ...]]:
    """The header, prow, pcol and named bands of a raster."""
    meta = raster_meta(path)
    wanted = [*rgb, *([nir] if nir else [])]
    if max(wanted) > meta.count:
        raise ValueError(f"band {max(wanted)} of {meta.count}")
    names = ("red", "green", "blue", "nir")[: len(wanted)]
    pixels = read_raster(spark, path, wanted).select(F.col("row").alias("prow"), F.col("col").alias("pcol"), *[F.col(f"band{b}").alias(n) for b, n in zip(wanted, names, strict=True)])
    return meta, pixels, names


def numbered(found: DataFrame) -> DataFrame:
    """id by row and column."""
    return ranking.sequential_ids(found.withColumn("_k", F.monotonically_increasing_id()), "id", "y", "x", "_k").drop("_k")


def merge(found: DataFrame, distance: float, score: str = "score") -> DataFrame:
    with_id = materialize(found.withColumn("id", F.monotonically_increasing_id()), "found")
    return spatial.suppress(with_id, distance, [(-F.col(score)).alias("s"), F.col("y").alias("y"), F.col("x").alias("x"), F.col("id").alias("k")])


def counted(say: Callable[[str], None], what: str, df: DataFrame) -> DataFrame:
    """A step's result as a table, told with its number of rows."""
    out = materialize(df, "step")
    say(f"{what}: {out.count()}")
    return out


def _placed(found: DataFrame, meta: Raster) -> DataFrame:
    x, y = G.pixel_to_world(F.col("x"), F.col("y"), meta.transform)
    return found.withColumns({"wx": x, "wy": y})


def _epsg(crs: str | None) -> int | None:
    return int(crs.split(":")[1]) if crs else None


def _results(spark: SparkSession, final: DataFrame, pixels: DataFrame, meta: Raster, out: str, crown: float, annotate: bool, size: int) -> None:
    placed = _placed(final, meta)
    shown = placed.select("id", F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y"), F.col("wx").alias("x"), F.col("wy").alias("y"), "score", F.col("radius").alias("radius_px"), "support", F.col("area").alias("component_area_px"))
    text.write_csv(shown.orderBy("id"), f"{out}/trees.csv", {"pixel_x": 3, "pixel_y": 3, "x": 8, "y": 8, "score": 4, "radius_px": 3, "component_area_px": 1})
    told = placed.withColumnRenamed("radius", "radius_px").withColumn("radius_map", F.col("radius_px") * G.pixel_size(meta.transform)).orderBy("id")
    text.write_geojson(told, f"{out}/trees.geojson", text.point_geometry(), ["id", "score", "radius_px", "support"], meta.crs, "tree_points")
    text.write_geojson(told, f"{out}/tree_crowns.geojson", text.circle_geometry("radius_map"), ["id", "score", "radius_px", "radius_map"], meta.crs, "tree_crowns")
    # Fixed value: rings are no smaller than this share of a crown.
    ring = F.greatest(F.col("radius"), F.lit(0.65 * crown))
    images.write_preview(pixels, final.select("x", "y", ring.alias("r"), F.lit("ring").alias("kind")), f"{out}/detections_preview.png", meta.width, meta.height)
    if annotate:
        drawn = images.annotated(pixels, final.select("id", "x", "y", ring.alias("r")), meta.width, meta.height, size)
        write_raster(drawn, f"{out}/detections_annotated.tif", ["red", "green", "blue"], meta.width, meta.height, meta.transform, _epsg(meta.crs))


def run_generic(spark: SparkSession, path: str, out: str, rgb=(1, 2, 3), nir: int | None = None, least: float | None = None, most: float | None = None, spacing: float | None = None, preset: detectors.Preset = detectors.GENERIC, row_filter: bool = True, least_support: int = 1, annotate: bool = False, debug: bool = False, say: Callable[[str], None] = print) -> int:
    """The generic detector, calibrated on the raster itself; the number of trees."""
    meta, pixels, names = bands_of(spark, path, rgb, nir)
    c = detectors.calibrate_generic(spark, pixels, meta.width, meta.height, least, most, spacing, names, preset=preset)
    text.write_json(detectors.as_dict(c), f"{out}/calibration.json")
    raw = counted(say, "candidates", detectors.detect(pixels, meta.width, meta.height, preset, c, names))
    merged = counted(say, "after merging", merge(raw, min(0.72 * c.spacing, 2.2 * c.crown)))
    kept = spatial.row_filter_generic(merged, c.spacing, c.angle, least_support=least_support, least_score=preset.least_score) if row_filter else merged.withColumn("support", F.lit(0).cast("long"))
    final = counted(say, "after the row filter", numbered(kept.drop("id")))
    _results(spark, final, pixels, meta, out, c.crown, annotate, preset.tile)
    if debug:
        window = detectors.sample_windows(meta.width, meta.height, preset.tile, 9)[0]
        images.write_debug(_one_window(pixels, window, names), preset, c, out)
    total = final.count()
    text.write_json({"input": path, "count": total, "annotated": annotate, "calibration": detectors.as_dict(c)}, f"{out}/summary.json")
    release(raw, merged, final)
    return total


def _one_window(pixels: DataFrame, window: tuple[int, int, int, int], names: tuple[str, ...]) -> list:
    """The rescaled bands of one window, on the driver: as large as a tile."""
    import numpy as np

    from tessera.operators import kernels as K

    left, top, w, h = window
    rows = pixels.where(F.col("prow").between(top, top + h - 1) & F.col("pcol").between(left, left + w - 1)).toPandas()
    out = []
    for n in names:
        image = np.zeros((h, w))
        image[rows["prow"].to_numpy() - top, rows["pcol"].to_numpy() - left] = rows[n].to_numpy(float)
        out.append(K.rescale(image))
    return out


def run_young(spark: SparkSession, path: str, out: str, spacing_m: float = 1.5, rgb=(1, 2, 3), least_m: float | None = None, most_m: float | None = None, preset: detectors.Preset = detectors.YOUNG, least_support: int = 2, annotate: bool = False, say: Callable[[str], None] = print) -> int:
    """The detector of young trees of known spacing; the number of trees."""
    meta, pixels, names = bands_of(spark, path, rgb)
    size = G.pixel_size(meta.transform)
    px = lambda m: m / size if m else None
    c = detectors.calibrate_young(spark, pixels, meta.width, meta.height, spacing_m / size, px(least_m), px(most_m), names, preset)
    text.write_json(detectors.as_dict(c) | {"pixel_size_m": size}, f"{out}/calibration.json")
    raw = counted(say, "candidates", detectors.detect(pixels, meta.width, meta.height, preset, c, names))
    merged = counted(say, "after merging", merge(raw, 0.62 * c.spacing))
    final = counted(say, "after the row filter", numbered(spatial.row_filter_young(merged, c.spacing, least_support=least_support).drop("id")))
    _results(spark, final, pixels, meta, out, c.crown, annotate, preset.tile)
    total = final.count()
    text.write_json({"input": path, "count": total, "annotated": annotate, "calibration": detectors.as_dict(c)}, f"{out}/summary.json")
    release(raw, merged, final)
    return total


def reference_pixels(spark: SparkSession, path: str, meta: Raster) -> DataFrame:
    """id, x, y of the reference points that lie in the raster, in pixels."""
    points = geopackage.read_points(spark, path, crs=meta.crs)
    x, y = G.world_to_pixel(F.col("wx"), F.col("wy"), meta.transform)
    out = points.select(F.monotonically_increasing_id().alias("id"), x.alias("x"), y.alias("y"))
    return materialize(out.where((F.col("x") >= 0) & (F.col("x") < meta.width) & (F.col("y") >= 0) & (F.col("y") < meta.height)), "references")


def area_in_pixels(spark: SparkSession, path: str, meta: Raster) -> DataFrame:
    """id, rings of an area's polygons, in pixels."""
    polygons = geopackage.read_polygons(spark, path, crs=meta.crs)
    turn = lambda p: F.array(*G.world_to_pixel(p["x"], p["y"], meta.transform))
    return polygons.select(F.monotonically_increasing_id().alias("id"), F.transform("rings", lambda r: F.transform(r, turn)).alias("rings"))


def train(spark: SparkSession, path: str, points: str, out: str, rgb=(1, 2, 3), spacing_m: float | None = None, near_m: float = 0.55, far_m: float = 1.0, size: int = 512, trees: int = 220, depth: int = 20, preset: detectors.Preset = detectors.HYBRID, say: Callable[[str], None] = print, **how) -> dict:
    """Fits a forest on a raster and its reference points, and keeps it as a bundle with its report on held-out rows."""
    meta, pixels, names = bands_of(spark, path, rgb)
    refs, pixel = reference_pixels(spark, points, meta), G.pixel_size(meta.transform)
    if refs.isEmpty():
        raise ValueError("no reference point lies in the raster")
    c = detectors.spacing_radii(detectors.reference_spacing(refs, (spacing_m or 1.5) / pixel))
    rows = training.raster_rows(pixels, meta.width, meta.height, refs, c, near_m / pixel, far_m / pixel, preset, size, bands=names, **how)
    rows = counted(say, "training rows", rows.select(F.monotonically_increasing_id().alias("id"), "label", "features"))
    split = materialize(ranking.stratified_split(forest.spread(rows, detectors.FEATURES), "label", F.col("id"), 0.22), "split")
    model = forest.fit(split.where("not test"), detectors.FEATURES, "label", trees, depth)
    judged = forest.score(model, split.where("test")).select("label", (F.col("prob") >= 0.5).cast("int").alias("predicted"))
    by_class = stats.classification_report(judged, "label", "predicted")
    report = {str(r.label): r.asDict() for r in by_class.collect()} | {"averages": stats.report_averages(by_class).first().asDict()}  # two classes
    bundle.save(spark, model, bundle.Meta(pixel, c, list(rgb), crs=meta.crs), report, out)
    return report


def predict(spark: SparkSession, path: str, model_path: str, out: str, area: str | None = None, least_prob: float = 0.70, preset: detectors.Preset = detectors.HYBRID, say: Callable[[str], None] = print) -> int:
    """Finds trees with a bundle's forest; the number of trees."""
    model, told, _ = bundle.load(spark, model_path)
    meta, pixels, names = bands_of(spark, path, tuple(told.bands))
    polygons = area_in_pixels(spark, area, meta) if area else None
    c = told.calibration
    proposed = counted(say, "proposed", detectors.detect(pixels, meta.width, meta.height, preset, c, names, polygons, features=True))
    judged = forest.score(model, forest.spread(proposed.select("x", "y", "radius", "features"), detectors.FEATURES))
    accepted = counted(say, "accepted", judged.where(F.col("prob") >= least_prob).select("x", "y", "score", "radius", "prob"))
    final = counted(say, "after merging", numbered(merge(accepted, 0.55 * c.spacing, "prob").drop("id")))
    placed = _placed(final, meta)
    geopackage.write_points(placed.select("id", "prob", "score", F.col("x").alias("x_pixel"), F.col("y").alias("y_pixel"), F.col("radius").alias("radius_px"), "wx", "wy"), f"{out}/arboles_detectados", "arboles_detectados", _epsg(meta.crs))
    text.write_style(f"{out}/arboles_detectados.qml")
    # Dots of likely trees are larger.
    dots = final.select("x", "y", F.when(F.col("prob") < 0.85, 3.0).otherwise(4.0).alias("r"), F.lit("dot").alias("kind"))
    images.write_preview(pixels, dots, f"{out}/detections_preview.png", meta.width, meta.height)
    text.write_csv(final.select("id", F.col("x").alias("x_pixel"), F.col("y").alias("y_pixel"), "prob", "score").orderBy("id"), f"{out}/arboles_detectados.csv", {"x_pixel": 2, "y_pixel": 2, "prob": 4, "score": 4})
    total = final.count()
    release(proposed, accepted, final)
    return total


def clip_references(spark: SparkSession, path: str, points: str, out: str, say: Callable[[str], None] = print) -> int:
    """Reference points within the raster, numbered, as a layer of their own with a style, CSV and preview."""
    meta, pixels, _ = bands_of(spark, path, (1, 2, 3))
    final = counted(say, "references", numbered(reference_pixels(spark, points, meta).drop("id")))
    placed = _placed_exactly(final, meta)
    geopackage.write_points(placed.select("id", F.col("x").alias("x_pixel"), F.col("y").alias("y_pixel"), F.lit("referencia").alias("fuente"), "wx", "wy"), f"{out}/arboles_detectados", "arboles_detectados", _epsg(meta.crs))
    text.write_style(f"{out}/arboles_detectados.qml")
    text.write_csv(placed.select("id", F.col("x").alias("x_pixel"), F.col("y").alias("y_pixel")).orderBy("id"), f"{out}/arboles_detectados.csv", {"x_pixel": 2, "y_pixel": 2})
    images.write_preview(pixels, final.select("x", "y", F.lit(4.0).alias("r"), F.lit("dot").alias("kind")), f"{out}/detections_preview.png", meta.width, meta.height)
    return final.count()


def _placed_exactly(points: DataFrame, meta: Raster) -> DataFrame:
    """Continuous pixels back in the world: no half pixel is added."""
    a, b, c, d, e, f = meta.transform
    return points.withColumns({"wx": a * F.col("x") + b * F.col("y") + c, "wy": d * F.col("x") + e * F.col("y") + f})


def presets(preset: detectors.Preset, tile: int | None, overlap: int | None, share: float | None, least_score: float | None) -> detectors.Preset:
    given = {"tile": tile, "overlap": overlap, "share": share, "least_score": least_score}
    out = replace(preset, **{k: v for k, v in given.items() if v is not None})
    if out.overlap >= out.tile or not math.isfinite(out.share):
        raise ValueError("the overlap must be smaller than the tile")
    return out
