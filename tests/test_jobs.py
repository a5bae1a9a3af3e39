"""Whole runs on a planted orchard, written and read as files."""

import csv
import json
import math
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import __main__ as command
from tessera import jobs
from tessera.operators import detectors
from tessera.sources import bundle, geopackage, geotiff, images, text

SIDE, STEP = 240, 24
TRANSFORM = (0.0625, 0.0, 1000.0, 0.0, -0.0625, 2000.0)
CROWNS = [(c * STEP + 12 + (r + c) % 2, r * STEP + 12, 4 + (r + 2 * c) % 2) for r in range(10) for c in range(10)]


def planted() -> np.ndarray:
    image = np.empty((SIDE, SIDE, 3))
    rng = np.random.default_rng(5)
    image[:] = (120, 90, 80)
    image += rng.integers(0, 12, image.shape)
    r, c = np.ogrid[:SIDE, :SIDE]
    for x, y, radius in CROWNS:
        far = np.hypot(r - y, c - x)
        image[far <= radius] = (50, 60, 40)
        image[:, :, 1] = np.where(far <= radius, 220 - 8 * far, image[:, :, 1])
    return image


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("orchard")
    image = planted()
    pixels = spark.createDataFrame([(r, c, *map(float, image[r, c])) for r in range(SIDE) for c in range(SIDE)], "row int, col int, band1 double, band2 double, band3 double")
    path = f"file://{folder}/orchard.tif"
    geotiff.write_raster(pixels, path, ["band1", "band2", "band3"], SIDE, SIDE, TRANSFORM, 32721)
    a, _, c, _, e, f = TRANSFORM
    points = spark.createDataFrame([(k, a * (x + 0.5) + c, e * (y + 0.5) + f) for k, (x, y, _) in enumerate(CROWNS)] + [(999, 0.0, 0.0)], "id int, wx double, wy double")
    geopackage.write_points(points.coalesce(1), f"file://{folder}/points", "points", 32721)
    return path, f"file://{folder}/points", f"file://{folder}", Path(folder)


def png(path: Path) -> np.ndarray:
    data, at, body = path.read_bytes(), 8, b""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            w, h, _, color = struct.unpack(">IIBB", part[:10])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    image = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)
    assert not image[:, 0].any()
    return image[:, 1:].reshape(h, w, 3 if color == 2 else 1)


def rows_of(folder: Path) -> list[dict]:
    return [r for p in sorted(folder.glob("*.csv")) for r in csv.DictReader(p.open(newline=""))]


def hits(rows: list[dict], x: str, y: str) -> int:
    places = [(float(r[x]), float(r[y])) for r in rows]
    return sum(any(math.hypot(a - cx, b - cy) <= radius + 1 for a, b in places) for cx, cy, radius in CROWNS)


def test_generic(spark, files):
    path, _, folder, local = files
    small = jobs.presets(detectors.GENERIC, 120, 24, 0.9, None)
    n = jobs.run_generic(spark, path, f"{folder}/generic", least=3.0, most=7.0, preset=small, annotate=True, debug=True, say=lambda s: None)
    rows = rows_of(local / "generic/trees.csv")
    assert len(rows) == n and hits(rows, "pixel_x", "pixel_y") >= 95 and n <= 110
    assert [int(r["id"]) for r in rows] == list(range(1, n + 1)) and all(len(r["x"].split(".")[1]) == 8 for r in rows)
    told = json.loads((local / "generic/summary.json").read_text())
    assert told["count"] == n and told["calibration"]["spacing"] == pytest.approx(24, abs=1.5)
    crowns = json.loads((local / "generic/tree_crowns.geojson").read_text())
    assert len(crowns["features"]) == n and len(crowns["features"][0]["geometry"]["coordinates"][0]) == 25
    shown = png(local / "generic/detections_preview.png")
    assert shown.shape == (SIDE, SIDE, 3) and (shown == images.YELLOW).all(axis=2).sum() > 5 * n
    drawn = geotiff.raster_meta(f"{folder}/generic/detections_annotated.tif")
    assert (drawn.width, drawn.height, drawn.count) == (SIDE, SIDE, 3)
    assert png(local / "generic/debug_crown_mask.png").shape[2] == 1


def test_young(spark, files):
    path, _, folder, local = files
    n = jobs.run_young(spark, path, f"{folder}/young", 24 * 0.0625, preset=jobs.presets(detectors.YOUNG, 120, 24, 0.9, None), say=lambda s: None)
    rows = rows_of(local / "young/trees.csv")
    assert len(rows) == n and hits(rows, "pixel_x", "pixel_y") >= 95 and n <= 105
    assert all(int(r["support"]) >= 1 for r in rows)


def test_training_cycle(spark, files):
    path, points, folder, local = files
    own = jobs.presets(detectors.HYBRID, 120, 24, 0.9, None)
    report = jobs.train(spark, path, points, f"{folder}/bundle", near_m=0.3, far_m=0.5, size=80, trees=12, depth=6, preset=own, most_positive=60, say=lambda s: None)
    assert report["averages"]["accuracy"] > 0.9 and {"0", "1"} <= set(report)
    _, meta, kept = bundle.load(spark, f"{folder}/bundle")
    assert meta.calibration.spacing == pytest.approx(24, abs=1.5) and kept == report and meta.crs == "EPSG:32721"
    n = jobs.predict(spark, path, f"{folder}/bundle", f"{folder}/predicted", least_prob=0.5, preset=own, say=lambda s: None)
    rows = rows_of(local / "predicted/arboles_detectados.csv")
    assert len(rows) == n and hits(rows, "x_pixel", "y_pixel") >= 90 and n <= 110
    assert "SimpleMarker" in (local / "predicted/arboles_detectados.qml").read_text()
    assert geopackage.read_points(spark, f"{folder}/predicted/arboles_detectados").count() == n


def test_clip(spark, files):
    path, points, folder, local = files
    assert jobs.clip_references(spark, path, points, f"{folder}/clipped", say=lambda s: None) == 100
    rows = rows_of(local / "clipped/arboles_detectados.csv")
    assert hits(rows, "x_pixel", "y_pixel") == 100


def test_command_line(spark, files, capsys):
    path, points, folder, _ = files
    command.main(["clip", path, points, "--out-dir", f"{folder}/cli"])
    assert '{"command": "clip", "result": 100}' in capsys.readouterr().out
    with pytest.raises(ValueError):
        command.main(["young", path, "--out-dir", f"{folder}/cli", "--tile-size", "10", "--tile-overlap", "10"])
    with pytest.raises(ValueError):
        command.main(["detect", path, "--out-dir", f"{folder}/cli", "--nir-band", "9"])


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.5,), (-0.0004,), (None,)], "v double")
    assert [r.s for r in df.select(text.fixed(F.col("v"), 2).alias("s")).collect()] == ["0.12", "1.00", "2.50", "-0.00", None]


def test_lzw():
    """Against a plain encoder of the same format."""
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"abababababab" * 400, rng.integers(0, 4, 30000).astype(np.uint8).tobytes(), rng.integers(0, 256, 9000).astype(np.uint8).tobytes()):
        table, wide, held, bits, out, word = {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray(), b""

        def put(code):
            nonlocal held, bits
            held, bits = held << wide | code, bits + wide
            while bits >= 8:
                bits -= 8
                out.append(held >> bits & 255)

        put(256)
        for byte in data:
            more = word + bytes([byte])
            if more in table:
                word = more
                continue
            put(table[word])
            table[more] = len(table) + 2
            if len(table) + 2 == 4095:
                put(256)
                table, wide = {bytes([k]): k for k in range(256)}, 9
            else:
                wide = 12 if len(table) + 2 >= 2048 else 11 if len(table) + 2 >= 1024 else 10 if len(table) + 2 >= 512 else 9
            word = bytes([byte])
        if word:
            put(table[word])
        put(257)
        out.append(held << (8 - bits) & 255 if bits else 0)
        assert geotiff.lzw(bytes(out)) == data
