"""Areas of interest: polygons as rings of points, on pixels and on tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(rings: list[list[list[float]]], left: int, top: int, width: int, height: int) -> np.ndarray:
    """The window's pixels whose centre lies inside the rings (an odd number of crossings, so holes are rings too) or that
    an edge touches. Rings close by themselves; pixels are unit squares from their integer place on."""
    out = np.zeros((height, width), bool)
    crossings = np.zeros((height, width + 1), np.int64)
    centres = np.arange(height) + 0.5
    for ring in rings:
        p = np.array(ring, float).reshape(-1, 2) - (left, top)
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
            crossed = np.flatnonzero((centres >= min(y0, y1)) & (centres < max(y0, y1)))
            if crossed.size:  # every centre to the right of the crossing flips
                x = x0 + (centres[crossed] - y0) * (x1 - x0) / (y1 - y0)
                np.add.at(crossings, (crossed, np.clip(np.ceil(x - 0.5), 0, width).astype(int)), 1)
            rows = np.arange(max(0, int(np.floor(min(y0, y1)))), min(height - 1, int(np.floor(max(y0, y1)))) + 1)
            if y0 == y1:
                a, b = np.full(len(rows), min(x0, x1)), np.full(len(rows), max(x0, x1))
            else:  # where the edge runs within each row
                ends = [x0 + (np.clip(rows + k, min(y0, y1), max(y0, y1)) - y0) * (x1 - x0) / (y1 - y0) for k in (0, 1)]
                a, b = np.minimum(*ends), np.maximum(*ends)
            for r, lo, hi in zip(rows.tolist(), np.floor(a).astype(int).tolist(), np.floor(b).astype(int).tolist(), strict=True):
                out[r, max(0, lo) : max(0, hi + 1)] = True
    return out | (np.cumsum(crossings, axis=1)[:, :width] % 2 == 1)


def edges(polygons: DataFrame) -> DataFrame:
    """id, x0, y0, x1, y1 of every edge. polygons: id, rings."""
    ring = polygons.select("id", F.explode("rings").alias("ring")).where(F.size("ring") > 1)
    step = ring.select("id", "ring", F.posexplode("ring").alias("k", "p")).withColumn("q", F.get("ring", F.pmod(F.col("k") + 1, F.size("ring"))))
    return step.select("id", F.col("p")[0].alias("x0"), F.col("p")[1].alias("y0"), F.col("q")[0].alias("x1"), F.col("q")[1].alias("y1"))


def points_inside(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """The points (id, x, y and others) inside some polygon (id, rings). Edges are dealt to the horizontal strips of a cell's
    height that they pass through, within which every crossing is decided; polygons are told apart, so they may overlap."""
    strip = lambda c: F.floor(c / cell).cast("long")
    near = edges(polygons).withColumnRenamed("id", "area").withColumn("s", F.explode(F.sequence(strip(F.least("y0", "y1")), strip(F.greatest("y0", "y1")))))
    bounds = near.groupBy("area", "s").agg(F.min(F.least("x0", "x1")).alias("lo"), F.max(F.greatest("x0", "x1")).alias("hi"), F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    # A polygon's strip is copied to the cells that it is as wide as, so that points meet only what is near them.
    cells = bounds.withColumn("c", F.explode(F.sequence(strip(F.col("lo")), strip(F.col("hi")))))
    at = points.withColumns({"s": strip(F.col("y")), "c": strip(F.col("x"))})
    crossing = F.size(F.filter("edges", lambda e: (F.col("y") >= F.least(e["y0"], e["y1"])) & (F.col("y") < F.greatest(e["y0"], e["y1"])) & (F.col("x") <= e["x0"] + (F.col("y") - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))))
    return at.alias("p").join(cells.alias("e"), (F.col("p.s") == F.col("e.s")) & (F.col("p.c") == F.col("e.c")) & (crossing % 2 == 1), "left_semi").drop("s", "c")
