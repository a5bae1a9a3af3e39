"""Labelling, blobs, candidates and training rows against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.operators import blobs, stencils, training
from tessera.plans import detection as _added  # noqa: F401  adds to the registry
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


def flood(cells):
    left, out = set(cells), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        first = todo[0]
        while todo:
            r, c = todo.pop()
            out[r, c] = first[0] * (1 << 31) + first[1]
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in left:
                    left.discard(near)
                    todo.append(near)
    return out


def test_label(spark):
    rng = random.Random(4)
    tiles = {t: {(r, c) for r in range(30) for c in range(30) if rng.random() < p} for t, p in ((0, 0.45), (1, 0.6), (2, 1.0), (3, 0.0))}
    rows = [(t, r, c, (r, c) in cells or (None if (r + c) % 2 else False)) for t, cells in tiles.items() for r in range(30) for c in range(30)]
    rows.append((1, *min(tiles[1]), True))
    got = stencils.label(spark.createDataFrame(rows, "t int, prow int, pcol int, m boolean"), "t", "m").collect()
    assert len(got) == sum(map(len, tiles.values())) + 1
    assert {(x.t, x.prow, x.pcol): x.label for x in got} == {(t, *p): root for t, cells in tiles.items() for p, root in flood(cells).items()}
    assert stencils.label(spark.createDataFrame([], "t int, prow int, pcol int, m boolean"), "t", "m").count() == 0


def test_response_equals_direct_sum():
    image = np.random.default_rng(1).random((9, 12))
    sigma, reach = 1.4, int(4 * 1.4 + 0.5)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    taps = {k: w / sum(weight) for k, w in zip(range(-reach, reach + 1), weight, strict=True)}
    mirror = lambda i, n: (i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    got = blobs.response(image, sigma)
    for r in range(9):
        for c in range(12):
            total = sum(taps[i] * taps[j] * ((i * i + j * j) / sigma**4 - 2 / sigma**2) * image[mirror(r + i, 9), mirror(c + j, 12)] for i in taps for j in taps)
            assert got[r, c] == pytest.approx(-(sigma**2) * total, abs=1e-12)


def test_blobs(spark):
    discs = [(0, 20, 20, 5), (0, 20, 60, 8), (1, 115, 140, 4), (1, 115, 146, 4)]
    inside = lambda t, r, c: any(t == k and (r - y) ** 2 + (c - x) ** 2 <= q * q for k, y, x, q in discs)
    rows = [(t, r, c, 1.0 if inside(t, r, c) else None if (r * c) % 3 else math.nan) for t, top, left in ((0, 0, 0), (1, 100, 120)) for r in range(top, top + 42) for c in range(left, left + 82)]
    got = blobs.log_blobs(spark.createDataFrame(rows, "t int, prow int, pcol int, v double"), "t", "v", blobs.scales(3, 10), 0.3).collect()
    for t, y, x, q in discs[:2]:
        (best,) = [b for b in got if b.t == t and math.hypot(b.prow - y, b.pcol - x) <= q / 2]
        assert abs(best.radius - q) <= 1.2
    for a in got:
        others = [b for b in got if b.t == a.t and b != a]
        share = blobs.overlap(a.radius, np.array([b.radius for b in others]), np.array([math.hypot(a.prow - b.prow, a.pcol - b.pcol) for b in others]))
        assert not (share > 0.55 + 1e-9).any()
    assert blobs.log_blobs(spark.createDataFrame([], "t int, prow int, pcol int, v double"), "t", "v", [1.2, 2.2]).count() == 0


def test_overlap():
    assert blobs.overlap(2.0, np.array([2.0, 1.0, 3.0]), np.array([4.0, 0.5, 1.0])).tolist() == [0.0, 1.0, 1.0]
    grid = [(x / 40, y / 40) for x in range(-80, 200) for y in range(-80, 81)]
    both = sum(x * x + y * y <= 4 and (x - 2) ** 2 + y * y <= 2.25 for x, y in grid) / 1600
    assert blobs.overlap(2.0, np.array([1.5]), np.array([2.0]))[0] == pytest.approx(both / (math.pi * 2.25), abs=0.01)


def test_training_set(spark):
    rng = random.Random(8)
    refs = [(i, rng.randrange(300) * 1.0, rng.randrange(300) * 1.0) for i in range(60)]
    cands = [(1000 + i, rng.randrange(300) * 1.0, rng.randrange(300) * 1.0, None if i % 5 == 0 else 0.5) for i in range(200)] + [(5000, None, 3.0, 1.0)]
    nearest = lambda x, y: min(math.hypot(x - a, y - b) for _, a, b in refs)
    got = training.training_set(spark.createDataFrame(cands, "id long, x double, y double, score double"), spark.createDataFrame(refs, "id long, x double, y double"), 300, 300, 6.0, 14.0, ratio=20.0, anchors=0.5).collect()
    by = {k: [r for r in got if r.origin == k] for k in ("candidate", "anchor", "far", "random")}
    placed = [c for c in cands if c[1] is not None]
    assert {r.id for r in by["candidate"]} == {c[0] for c in placed if nearest(c[1], c[2]) <= 6} and by["candidate"]
    assert len(by["anchor"]) == len(by["candidate"]) // 2 and all(r.score == 1 and r.label == 1 for r in by["anchor"])
    assert {r.id for r in by["far"]} == {c[0] for c in placed if nearest(c[1], c[2]) >= 14}
    assert len(by["far"]) + len(by["random"]) == 20 * (len(by["candidate"]) + len(by["anchor"]))
    assert all(r.label == 0 and nearest(r.x, r.y) >= 14 for r in by["far"] + by["random"])
    assert len({r.id for r in got}) == len(got)
    none = spark.createDataFrame([], "id long, x double, y double")
    assert training.training_set(spark.createDataFrame(cands, "id long, x double, y double, score double"), none, 300, 300, 6.0, 14.0).count() == 0


@pytest.mark.parametrize("name", ["log_blobs", "nms", "nms_thin", "training_set"])
def test_queries_run(spark, name):
    out = registry.queries()[name](spark, DATA)
    rows = out.collect()
    key = ["id"] if "id" in out.columns else ["prow", "pcol"]
    assert rows and len({tuple(r[k] for k in key) for r in rows}) == len(rows)
