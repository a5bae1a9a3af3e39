"""Tile kernels, areas and detectors against brute force."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest

from tessera.operators import area, detection, detectors, ranking, spatial, tiles
from tessera.operators import kernels as K

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_morphology(radius):
    mask = RNG.random((17, 23)) < 0.6
    disk = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    at = lambda m, r, c: [m[r + y, c + x] for y, x in disk if 0 <= r + y < 17 and 0 <= c + x < 23]
    for got, fold in ((K.erode(mask, radius), all), (K.dilate(mask, radius), any)):
        assert all(got[r, c] == fold(at(mask, r, c)) for r in range(17) for c in range(23))


def test_distance_and_peaks():
    mask = RNG.random((15, 21)) < 0.8
    off = np.argwhere(~mask)
    far = K.distance(mask)
    assert all(far[r, c] == pytest.approx(min(math.hypot(r - y, c - x) for y, x in off)) for r in range(15) for c in range(21))
    assert np.isinf(K.distance(np.ones((3, 4), bool))).all()
    image = RNG.integers(0, 6, (30, 30)).astype(float)
    tops = [(r, c) for r in range(30) for c in range(30) if image[r, c] > 2 and image[r, c] == image[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].max()]
    kept = []
    for r, c in sorted(tops, key=lambda p: (-image[p], p)):
        if all(max(abs(r - a), abs(c - b)) >= 2 for a, b in kept):
            kept.append((r, c))
    assert list(map(tuple, K.peaks(image, 2, 2.0).tolist())) == kept
    assert not len(K.peaks(np.ones((5, 5)), 1, 0.0))


def test_components_and_otsu():
    mask = RNG.random((20, 20)) < 0.55
    labels = K.components(mask)
    for r in range(20):
        for c in range(20):
            for y, x in ((r + 1, c), (r, c + 1)):
                if y < 20 and x < 20 and mask[r, c] and mask[y, x]:
                    assert labels[r, c] == labels[y, x]
    assert (labels[~mask] == -1).all() and all(labels.ravel()[k] == k for k in np.unique(labels[mask]))
    values = np.concatenate((RNG.normal(0, 1, 500), RNG.normal(10, 1, 500)))
    assert 3 < K.otsu(values) < 7 and K.otsu(np.full(9, 2.5)) == 2.5


def test_patch_features():
    images = {n: RNG.random((12, 14)) for n in detectors.CHANNELS}
    got = K.patch_features(images, 1.0, 12.0, 4.0)  # the square is cut at two edges
    part = images["red"][0:6, 8:14]
    assert got[:5] == pytest.approx([part.mean(), part.std(), np.quantile(part, 0.25), np.quantile(part, 0.75), images["red"][1, 12]])
    veg = images["veg"]
    assert got[45] == pytest.approx(veg[0:4, 10:14].mean() - veg[0:6, 8:14].mean())
    assert got[46] == pytest.approx(images["green"][1, 12] / (images["red"][1, 12] + images["blue"][1, 12] + 1e-6))
    assert len(got) + 3 == len(detectors.FEATURES) == 50 and detectors.FEATURES[44:] == ["veg_center", "score", "area_px", "radius_px", "local_contrast", "green_ratio"]


def test_covered_pixels():
    """Against fine sampling of each pixel, for polygons with a hole."""
    rng = random.Random(6)
    for _ in range(20):
        ring = [[6 + 5.3 * math.cos(a) * rng.uniform(0.5, 1), 6 + 5.1 * math.sin(a) * rng.uniform(0.5, 1)] for a in sorted(rng.uniform(0, 6.28) for _ in range(7))]
        got = area.covered([ring], 0, 0, 12, 12)
        inside = lambda x, y: sum((y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])) % 2
        for r in range(12):
            for c in range(12):
                hits = [inside(c + (i + 0.5) / 16, r + (j + 0.5) / 16) for i in range(16) for j in range(16)]
                assert not any(hits) or got[r, c]
                if got[r, c] and not any(hits):  # a corner may be touched between the samples
                    assert got[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].sum() > 1
    hole = area.covered([[[0, 0], [9, 0], [9, 9], [0, 9]], [[3.2, 3.2], [5.8, 3.2], [5.8, 5.8], [3.2, 5.8]]], 0, 0, 9, 9)
    assert not hole[4, 4] and hole[0, 0] and hole[3, 3] and hole[8, 8]


def test_points_inside(spark):
    rings = [(1, [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]]), (2, [[[8.0, 8.0], [15.0, 8.0], [15.0, 15.0], [8.0, 15.0]]])]
    points = [(k, x + 0.25, y + 0.25) for k, (x, y) in enumerate((x, y) for x in range(-2, 18) for y in range(-2, 18))]
    got = {r.id for r in area.points_inside(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(rings, "id int, rings array<array<array<double>>>"), 3.0).collect()}
    want = {k for k, x, y in points if (0 < x < 10 and 0 < y < 10 and not (4 < x < 6 and 4 < y < 6)) or (8 < x < 15 and 8 < y < 15)}
    assert got == want


def test_nearest_reaches_far_points(spark):
    rng = random.Random(9)
    points = [(k, rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(60)] + [(100, 900.0, 900.0), (101, -500.0, 7.0), (102, 900.0, 900.0)]
    got = {}
    for r in spatial.nearest_within(spark.createDataFrame(points, "id int, x double, y double"), 4, 2.0).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.j
    for i, x, y in points:
        want = sorted((math.hypot(x - a, y - b), j) for j, a, b in points if j != i)[:4]
        assert [got[i][k] for k in range(1, 5)] == [j for _, j in want]
    few = spark.createDataFrame(points[:3], "id int, x double, y double")
    assert spatial.nearest_within(few, 6, 1.0).count() == 6 and spatial.nearest_within(few.where("false"), 6, 1.0).count() == 0


def test_suppress_over_many_squares(spark):
    """Chains of points that hang on each other across squares, ties, and points at one place."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    points = [(k, k * 4.0, 5.0, float(k % 977)) for k in range(400)] + [(1000 + k, rng.uniform(0, 900), rng.uniform(0, 60), float(rng.randrange(4))) for k in range(600)] + [(2000 + k, 33.0, 33.0, 1.0) for k in range(50)]
    kept = []
    for p in sorted(points, key=lambda p: (-p[3], p[0])):
        if all(math.hypot(p[1] - k[1], p[2] - k[2]) >= 6 for k in kept):
            kept.append(p)
    got = spatial.suppress(spark.createDataFrame(points, "id int, x double, y double, score double"), 6.0, [(-F.col("score")).alias("s"), F.col("id").alias("k")])
    assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept)


def test_sequential_ids(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009, k) for k in range(500)], "a int, b int").repartition(5)
    got = [(r.a, r.b, r.n) for r in ranking.sequential_ids(rows, "n", "a", "b").collect()]
    assert sorted(got, key=lambda r: r[2]) == [(*x, n) for n, x in enumerate(sorted((a, b) for a, b, _ in got), 1)]
    assert ranking.sequential_ids(rows.where("false"), "n", "a", "b").count() == 0


def test_guards(spark):
    few = spark.createDataFrame([(k, float(k), 0.0, 0.1) for k in range(7)], "id int, x double, y double, score double")
    assert detectors.reference_spacing(few, 33.0) == 33.0
    assert detectors.estimate(few.select("x", "y", "score", "x".replace("x", "score")).toDF("x", "y", "score", "radius")) == {"radius": None, "spacing": None, "angle": None}
    assert spatial.row_filter_young(few, 1.0).count() == 7 and spatial.row_filter_generic(few, 1.0, None).count() == 7
    some = spark.createDataFrame([(k, float(k), 0.0, 0.1) for k in range(15)], "id int, x double, y double, score double")
    assert spatial.row_filter_young(some, 1.0).count() == 0  # fewer than twenty points tell no row


def test_tiles_agree_with_the_whole(spark):
    """Halos: a blur by tiles is that of the whole image."""
    from tessera.operators import stencils

    image = RNG.random((40, 50))
    pixels = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(40) for c in range(50)], "prow int, pcol int, v double")
    got = stencils.gaussian(tiles.expand_halo(pixels, 50, 40, 16, K.reach_of(1.2)), "tile_id", "v", 1.2).where("own").collect()
    want = K.gaussian(image, 1.2)
    assert len(got) == 2000 and all(r.v == pytest.approx(want[r.prow, r.pcol], abs=1e-12) for r in got)


def test_detect_nulls_and_empty(spark):
    small = replace(detectors.YOUNG, tile=32, overlap=8)
    about = detectors.given_spacing(10.0)
    none = spark.createDataFrame([], "prow int, pcol int, red int, green int, blue int")
    assert detectors.detect(none, 40, 40, small, about).count() == 0
    flat = spark.createDataFrame([(r, c, None, 5, 5) for r in range(40) for c in range(40)], "prow int, pcol int, red int, green int, blue int")
    assert detectors.detect(flat, 40, 40, small, about, features=True).count() == 0


def test_gather(spark):
    pixels = spark.createDataFrame([(0, r, c, r * 10 + c) for r in range(4) for c in range(5) if (r, c) != (2, 2)], "t int, prow int, pcol int, v int")
    points = spark.createDataFrame([(0, 1.5, 0.5), (0, 99.0, -3.0), (0, 2.0, 2.0), (0, 2.5, 1.5)], "t int, x double, y double")
    got = sorted(((r.x, r.y), r.v) for r in detection.gather_at(points, pixels, "t", "v").collect())
    assert got == [((1.5, 0.5), 2), ((2.0, 2.0), None), ((2.5, 1.5), None), ((99.0, -3.0), 4)]
