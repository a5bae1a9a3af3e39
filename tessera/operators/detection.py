"""Detection steps: response images, patch features, candidates, marks on tiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators import kernels as K
from tessera.operators import stencils
from tessera.operators.tiles import Tile, map_tiles


def response_image(pixels: DataFrame, by: str, value: str, mask: str, small: float, large: float, blur: float | None, weights: tuple[float, float] = (0.72, 0.28)) -> DataFrame:
    """by, prow, pcol, the mask and response: contrast of two blurs (0 off the mask) and (blurred) distance to the mask's edge,
    each rescaled, weighted, and rescaled over the whole tile."""

    def run(t: Tile) -> dict:
        image, m = t.image(value), t.mask(mask)
        far = K.distance(m)
        far = np.where(np.isfinite(far), far, 0.0)
        far = K.gaussian(far, blur) if blur else far
        contrast = np.where(m, K.gaussian(image, small) - K.gaussian(image, large), 0.0)
        return {"response": K.rescale(np.where(m, weights[0] * K.rescale(contrast) + weights[1] * K.rescale(far), 0.0))}

    return map_tiles(pixels.select(by, "prow", "pcol", mask, value), by, run, {"response": DoubleType()}).drop(value)


def patch_features(patches: DataFrame, values: str, side: int) -> DataFrame:
    """Mean, deviation, quartiles, centre and contrast (inner square less the whole) of square patches held as arrays.
    All by functions on arrays: no shuffle. An empty or null patch has null features."""
    n, half = side * side, side // 4
    v = F.transform(F.col(values), lambda x: x.cast("double"))
    rows = patches.withColumns({"_v": v, "_s": F.array_sort(v)})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def quantile(share: float) -> Column:
        at = share * (n - 1)
        lo, up = math.floor(at), math.ceil(at)
        return F.get("_s", F.lit(lo)) * (1 - (at - lo)) + F.get("_s", F.lit(up)) * (at - lo)

    inside = [r * side + c for r in range(half, side - half) for c in range(half, side - half)]
    inner = sum((F.get("_v", F.lit(i)) for i in inside), F.lit(0.0))
    rows = rows.withColumns({"mean": total(F.col("_v")) / n, "_in": inner})
    rows = rows.withColumns({
        "std": F.sqrt(total(F.transform("_v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n), "p25": quantile(0.25), "p75": quantile(0.75),
        "center": F.get("_v", F.lit((side // 2) * side + side // 2)), "contrast": F.col("_in") / len(inside) - F.col("mean"),
    })
    return rows.drop("_v", "_s", "_in")


def gather_at(points: DataFrame, pixels: DataFrame, by: str, value: str) -> DataFrame:
    """points (by, x, y and others) with the value of the pixel nearest to each (halves to even), clipped to the tile's rows and
    columns; null where that pixel is missing."""
    ends = pixels.groupBy(by).agg(*[f(c).alias(f"_{n}{c}") for c in ("prow", "pcol") for n, f in (("lo", F.min), ("hi", F.max))])
    clip = lambda c, axis: F.least(F.greatest(F.bround(F.col(c).cast("double")).cast("int"), F.col(f"_lo{axis}")), F.col(f"_hi{axis}"))
    at = points.join(ends, by).withColumns({"prow": clip("y", "prow"), "pcol": clip("x", "pcol")})
    return at.join(pixels.select(by, "prow", "pcol", value), [by, "prow", "pcol"], "left").select(*points.columns, value)


def component_candidates(pixels: DataFrame, by: str, mask: str, least: int, most: float) -> DataFrame:
    """Centroid and equivalent radius of the components within the size range, with a constant score."""
    sizes = stencils.label(pixels, by, mask).groupBy(by, "label").agg(F.count(F.lit(1)).alias("size"), F.avg("prow").alias("y"), F.avg("pcol").alias("x"))
    return sizes.where(F.col("size").between(least, most)).select(by, "x", "y", (F.sqrt(F.col("size") / math.pi) * 0.72).alias("radius"), F.lit(0.65).alias("score"))


def peaks_in_components(peaks: DataFrame, components: DataFrame, by: str) -> DataFrame:
    """Peaks with the label and size of the component they lie in; a peak in none is dropped."""
    sizes = components.groupBy(by, "label").agg(F.count(F.lit(1)).alias("size"))
    return peaks.join(components, [by, "prow", "pcol"]).join(sizes, [by, "label"])


def best_of(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def marks_by_tile(points: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Each point (id, x, y, r) once for every tile its circle's box reaches, in the tile's own pixels: an explode by arithmetic."""
    axis = lambda c, extent: F.sequence(F.greatest(F.floor((F.col(c) - F.col("r")) / size), F.lit(0)), F.least(F.floor((F.col(c) + F.col("r")) / size), F.lit((extent - 1) // size)))
    inside = points.where((F.col("x") + F.col("r") >= 0) & (F.col("y") + F.col("r") >= 0) & (F.floor((F.col("x") - F.col("r")) / size) <= (width - 1) // size) & (F.floor((F.col("y") - F.col("r")) / size) <= (height - 1) // size))
    out = inside.withColumn("ci", F.explode(axis("x", width))).withColumn("ri", F.explode(axis("y", height)))
    return out.select("id", (F.col("ci") * size).alias("col_off"), (F.col("ri") * size).alias("row_off"), (F.col("x") - F.col("ci") * size).alias("cx"), (F.col("y") - F.col("ri") * size).alias("cy"), "r")
