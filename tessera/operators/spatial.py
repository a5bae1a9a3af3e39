"""Point joins by grid cells: every range predicate becomes an equi-join on cells with a residual test."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import angle_difference, orientation


def grid_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (i, j, dx, dy, dist) of points (id, x, y) with dist <= radius. The right side is copied to nine cells."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    a = left.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = right.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")).withColumn("ox", near).withColumn("oy", near)
    b = b.select("j", "xj", "yj", (F.floor(F.col("xj") / radius) + F.col("ox")).alias("cx"), (F.floor(F.col("yj") / radius) + F.col("oy")).alias("cy"))
    pairs = a.join(b, ["cx", "cy"]).withColumns({"dx": F.col("xj") - F.col("xi"), "dy": F.col("yj") - F.col("yi")})
    return pairs.withColumn("dist", F.hypot("dx", "dy")).where(F.col("dist") <= radius).select("i", "j", "dx", "dy", "dist")


def range_pairs(points: DataFrame, radius: float) -> DataFrame:
    return grid_join(points, points, radius).where("i < j")


def annulus(points: DataFrame, low: float, high: float) -> DataFrame:
    return grid_join(points, points, high).where((F.col("i") != F.col("j")) & (F.col("dist") >= low))


def nearest_within(points: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest others of each point (id, x, y), ties by id; rank from 1. They are sought within the radius first, and
    within twice as much again and again for points that have fewer than k there: none is lost that lies far off."""
    from tessera.operators.state import materialize

    order = Window.partitionBy("i").orderBy("dist", "j")
    ends = points.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    widest = 0.0 if ends.lox is None else math.hypot(ends.hix - ends.lox, ends.hiy - ends.loy)
    left, found = points.select("id", "x", "y"), []
    while True:
        last = radius >= widest  # all points are within reach
        near = grid_join(left, points, radius).where("i != j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = materialize(near, "nearest")
        enough = near.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
        left = materialize(left.join(enough, "id", "left_anti"), "nearest-left")
        if last or left.isEmpty():
            found.append(near)
            return reduce(DataFrame.unionByName, found)
        found.append(near.join(left.withColumnRenamed("id", "i"), "i", "left_anti"))
        radius *= 2


def nearest_reference(candidates: DataFrame, references: DataFrame, far: float) -> DataFrame:
    """id and distance to the nearest reference; null beyond far."""
    near = grid_join(candidates, references, far).groupBy(F.col("i").alias("id")).agg(F.min("dist").alias("dist"))
    return candidates.join(near, "id", "left")


def row_angle_circular(pairs: DataFrame, spacing: float, least: int = 6) -> DataFrame:
    """Mean orientation by doubled angles of the pairs between .55 and 1.55 spacings; null with fewer than least."""
    theta = orientation(F.col("dx"), F.col("dy"))
    kept = pairs.where((F.col("dist") > 0.55 * spacing) & (F.col("dist") < 1.55 * spacing))
    mean = F.pmod(F.atan2(F.avg(F.sin(2 * theta)), F.avg(F.cos(2 * theta))) / 2, F.lit(math.pi))
    return kept.agg(F.when(F.count(F.lit(1)) >= least, mean).alias("angle"), F.count(F.lit(1)).alias("n"))


def row_angle_histogram(pairs: DataFrame, spacing: float, tolerance: float, bins: int = 36, least: int = 20) -> DataFrame:
    """Centre of the fullest of equal orientation bins, the first of equals; null with fewer than least pairs."""
    kept = pairs.where(F.col("dist").between(spacing * (1 - tolerance), spacing * (1 + tolerance)))
    k = F.least(F.floor(orientation(F.col("dx"), F.col("dy")) / math.pi * bins), F.lit(bins - 1)).cast("int")
    counts = kept.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.select(F.when(F.col("n") >= least, (F.col("k") + 0.5) * math.pi / bins).alias("angle"), "n")


def row_support(pairs: DataFrame, angle: float, tolerance: float, most_cross: int | None = None) -> DataFrame:
    """Neighbours by point: along the row before and behind, across it, and of either kind (support; across at most most_cross)."""
    theta = orientation(F.col("dx"), F.col("dy"))
    along = angle_difference(theta, F.lit(angle)) <= tolerance
    across = ~along & (angle_difference(theta, F.lit(angle + math.pi / 2)) <= tolerance)
    ahead = F.cos(F.atan2("dy", "dx") - angle) * F.col("dist") >= 0
    count = F.count_if
    counted = count(across) if most_cross is None else F.least(count(across), F.lit(most_cross))
    return pairs.groupBy(F.col("i").alias("id")).agg(count(along & ahead).alias("forward"), count(along & ~ahead).alias("backward"), count(across).alias("cross"), (count(along) + counted).alias("support"))


def row_filter_generic(points: DataFrame, spacing: float, angle: float | None, tolerance: float = 0.38, angle_tolerance: float = 18.0, least_support: int = 1, least_score: float = 0.20) -> DataFrame:
    """Points (id, x, y, score) with support, that have enough of it or a high score. All stay where there are fewer than
    twelve points or no row angle is found."""
    if points.count() < 12:
        return points.withColumn("support", F.lit(0).cast("long"))
    if angle is None:
        angle = row_angle_circular(range_pairs(points, max(12.0, 1.65 * spacing)), spacing).first().angle
    if angle is None:
        return points.withColumn("support", F.lit(0).cast("long"))
    near = annulus(points, spacing * (1 - tolerance), spacing * (1 + tolerance))
    support = row_support(near, angle, math.radians(angle_tolerance)).select("id", "support")
    out = points.join(support, "id", "left").withColumn("support", F.coalesce("support", F.lit(0)).cast("long"))
    return out.where((F.col("support") >= least_support) | (F.col("score") >= max(0.58, least_score + 0.22)))


def row_filter_young(points: DataFrame, spacing: float, tolerance: float = 0.45, angle_tolerance: float = 14.0, least_support: int = 2) -> DataFrame:
    """Points (id, x, y) with support, that have a neighbour on both sides of their row, or one along it and one across. All
    stay where there are fewer than eight points, none where no row angle is found (for want of twenty points, or pairs)."""
    n = points.count()
    if n < 8:
        return points.withColumn("support", F.lit(0).cast("long"))
    near = annulus(points, spacing * (1 - tolerance), spacing * (1 + tolerance))
    angle = row_angle_histogram(near.where("i < j"), spacing, tolerance).first().angle if n >= 20 else None
    if angle is None:
        return points.withColumn("support", F.lit(0).cast("long")).where("false")
    support = row_support(near, angle, math.radians(angle_tolerance), 1)
    both, beside = (F.col("forward") >= 1) & (F.col("backward") >= 1), (F.col("forward") + F.col("backward") >= 1) & (F.col("cross") >= 1) & (F.col("support") >= least_support)
    return points.join(support.where(both | beside).select("id", F.col("support").cast("long").alias("support")), "id")


#: Side of the squares that suppress() decides in, in distances.
SQUARE = 16


def _better(x: np.ndarray, y: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (better, worse) of points, numbered by rank, nearer than the distance."""
    cx, cy = np.floor(x / distance).astype(np.int64), np.floor(y / distance).astype(np.int64)
    cx, cy = cx - cx.min() + 1, cy - cy.min() + 1
    wide = int(cy.max()) + 2
    cell = cx * wide + cy
    order = np.argsort(cell, kind="stable")
    sorted_ = cell[order]
    a, b = [], []
    for step in (-wide - 1, -wide, -wide + 1, -1, 0, 1, wide - 1, wide, wide + 1):
        lo, hi = np.searchsorted(sorted_, cell + step), np.searchsorted(sorted_, cell + step, side="right")
        n = hi - lo
        i = np.repeat(np.arange(len(x)), n)
        j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near = (i < j) & (np.hypot(x[i] - x[j], y[i] - y[j]) < distance)
        a.append(i[near])
        b.append(j[near])
    return np.concatenate(a), np.concatenate(b)


def suppress(points: DataFrame, distance: float, rank: list[Column]) -> DataFrame:
    """Greedy non-maximum suppression, equal to a scan in rank order: a point stays when no better kept one is nearer than the
    distance. points: id, x, y and what rank (numbers that tell all points apart) needs.

    Squares of SQUARE distances decide their own points as far as they can, from a margin of one distance around them; what
    hangs on undecided points of the margin waits for the next round. Of points at one place all but the best go at once."""
    from tessera.operators.state import materialize, release

    ranks = [f"_r{k}" for k in range(len(rank))]
    ranked = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.struct(*[c.alias(n) for c, n in zip(rank, ranks, strict=True)]).alias("r"))
    best = ranked.groupBy("x", "y").agg(F.min_by("id", "r").alias("id"), F.min("r").alias("r"))
    now = materialize(best.select("id", "x", "y", *[F.col(f"r.{n}").alias(n) for n in ranks], F.lit(False).alias("kept")), "nms")
    side = SQUARE * distance
    axis = lambda c: F.explode(F.sequence(F.floor((F.col(c) - distance) / side), F.floor((F.col(c) + distance) / side)))
    schema = now.schema

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort([table[n].to_numpy() for n in reversed(ranks)])
        table = table.take(pa.array(order))
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        own = (np.floor(x / side) == key[0].as_py()) & (np.floor(y / side) == key[1].as_py())
        kept = table["kept"].to_numpy(zero_copy_only=False).copy()
        gone = np.zeros(len(x), bool)
        better, worse = _better(x, y, distance)
        while True:
            gone[worse[kept[better]]] = True  # no kept point is worse than another near it
            gone &= own
            held = np.zeros(len(x), bool)
            held[worse[~gone[better]]] = True
            new = own & ~kept & ~gone & ~held
            if not new.any():
                break
            kept |= new
        at = pa.array(np.flatnonzero(own & ~gone))
        return table.select(schema.names[:-1]).append_column("kept", pa.array(kept)).take(at)

    while True:
        dealt = now.withColumn("_cx", axis("x")).withColumn("_cy", axis("y"))
        new = materialize(dealt.groupBy("_cx", "_cy").applyInArrow(decide, schema), "nms")
        release(now)
        now = new
        if now.where("not kept").isEmpty():
            return points.join(now.select("id"), "id", "left_semi")
