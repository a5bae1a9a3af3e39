"""Sources and sinks: round trips, files built by hand, and broken input."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import geopackage, geotiff, text


def tiff(path, image, order="<", tile=None, strip=5, deflate=False, predictor=1, planar=False):
    """Writes a classic TIFF of the image (rows, columns, bands)."""
    h, w, n = image.shape
    planes = [image[:, :, [k]] for k in range(n)] if planar else [image]
    blocks = []
    for plane in planes:
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, plane.shape[2]), image.dtype)
            full[:h, :w] = plane
            parts = [full[r : r + tile, c : c + tile] for r in range(0, full.shape[0], tile) for c in range(0, full.shape[1], tile)]
        else:
            parts = [plane[r : r + strip] for r in range(0, h, strip)]
        for p in parts:
            if predictor == 2:
                p = np.concatenate((p[:, :1], np.diff(p, axis=1)), axis=1)
            data = p.astype(image.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(data) if deflate else data)
    starts = 8 + np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [image.dtype.itemsize * 8] * n), (259, "H", [8 if deflate else 1]), (277, "H", [n]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [kind] * n)]
    place, size = [int(s) for s in starts[:-1]], [len(b) for b in blocks]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", place), (325, "I", size)] if tile else [(273, "I", place), (278, "I", [strip]), (279, "I", size)]
    tags += [(33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 500.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32719])]
    tags.sort()
    at, table, far = int(starts[-1]), b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, form, values in tags:
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", base + len(far))
        far += b"" if len(raw) <= 4 else raw
        table += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values)) + value
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + b"".join(blocks) + struct.pack(order + "H", len(tags)) + table + struct.pack(order + "I", 0) + far)


@pytest.mark.parametrize(
    "dtype, how",
    [("u1", {}), ("u2", {"order": ">", "deflate": True}), ("f4", {"tile": 16, "planar": True}), ("i2", {"tile": 16, "deflate": True, "predictor": 2}), ("u1", {"tile": 48, "deflate": True})],
)
def test_raster_reads(spark, tmp_path, dtype, how):
    image = np.random.default_rng(3).integers(0, 120, (23, 48, 4)).astype(dtype)
    tiff(tmp_path / "a.tif", image, **how)
    meta = geotiff.raster_meta(str(tmp_path / "a.tif"))
    assert (meta.width, meta.height, meta.count, meta.crs) == (48, 23, 4, "EPSG:32719")
    assert meta.transform == (2.0, 0.0, 10.0, 0.0, -2.0, 500.0) and meta.bounds == (10.0, 454.0, 106.0, 500.0)
    got = geotiff.read_raster(spark, str(tmp_path / "a.tif"), [3, 1], (30, 7, 40, 9)).collect()
    expected = {(r, c, float(image[r, c, 2]), float(image[r, c, 0])) for r in range(7, 16) for c in range(30, 48)}
    assert len(got) == len(expected) and {tuple(x) for x in got} == expected
    assert geotiff.read_raster(spark, str(tmp_path / "a.tif")).count() == 23 * 48


def test_raster_round_trip(spark, tmp_path):
    rows = [(r, c, float(r + c), 300.0 if c == 2 else -5.0, None if r == 1 else 7.9) for r in range(10) if r not in (4, 5) for c in range(6)]
    df = spark.createDataFrame([*rows, (99, 0, 1.0, 1.0, 1.0), (0, 5, 200.0, 0.0, 0.0)], "row int, col int, red double, green double, blue double")
    path = str(tmp_path / "deep/er/b.tif")
    geotiff.write_raster(df, path, ["red", "green", "blue"], 6, 10, (0.5, 0.1, 3.0, 0.2, -0.5, 9.0), 32719, strip_rows=2)
    meta = geotiff.raster_meta(path)
    assert meta.transform == (0.5, 0.1, 3.0, 0.2, -0.5, 9.0) and meta.crs == "EPSG:32719"
    expected = {(r, c): (0.0, 0.0, 0.0) for r in range(10) for c in range(6)}
    expected |= {(r, c): (a, min(max(b, 0.0), 255.0), 0.0 if d is None else 7.0) for r, c, a, b, d in rows}
    expected[0, 5] = (200.0, 0.0, 7.0)
    assert {(x[0], x[1]): tuple(x[2:]) for x in geotiff.read_raster(spark, path).collect()} == expected


def test_raster_errors(spark, tmp_path):
    (tmp_path / "c.tif").write_bytes(b"no raster at all, no raster")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.raster_meta(str(tmp_path / "c.tif"))
    tiff(tmp_path / "d.tif", np.zeros((4, 4, 1), "u1"))
    with pytest.raises((ValueError, PySparkException)):
        geotiff.read_raster(spark, str(tmp_path / "d.tif"), [2]).collect()


def test_points_round_trip(spark, tmp_path):
    rows = [(float(i), -float(i), i, f"it's {i}", i / 7) for i in range(50)] + [(None, 1.0, 50, None, None)]
    df = spark.createDataFrame(rows, "wx double, wy double, id long, `na\"me` string, score double").repartition(3)
    path = str(tmp_path / "points")
    assert geopackage.write_points(df, path, 'my "layer"', 32719) == 51
    got = geopackage.read_points(spark, path, crs="EPSG:32719").select("wx", "wy").collect()
    assert sorted(tuple(r) for r in got) == [(float(i), -float(i)) for i in range(50)]
    assert {(r["layer"], r["name"], r["crs"]) for r in geopackage.list_layers(spark, path).collect()} == {(0, 'my "layer"', "EPSG:32719")}
    with pytest.raises(PySparkException, match="reference system"):
        geopackage.read_points(spark, path, crs="EPSG:4326").collect()
    with pytest.raises(PySparkException, match="no layer"):
        geopackage.read_points(spark, path, layer="none").collect()


def blob(wkb, flags=1, envelope=b""):
    return struct.pack("<2sBBi", b"GP", 0, flags, 4326) + envelope + wkb


def test_geometry():
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    polygon = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    deep = struct.pack(">BIII", 0, 1003, 1, 4) + b"".join(struct.pack(">ddd", *p, 9.0) for p in ring)
    assert geopackage.geometry(blob(polygon)) == (3, [ring])
    assert geopackage.geometry(blob(deep, 3, bytes(32))) == (3, [ring])
    assert geopackage.geometry(blob(struct.pack("<BII", 1, 6, 2) + polygon + deep)) == (6, [ring, ring])
    assert geopackage.geometry(blob(struct.pack("<BIdd", 1, 1, 3.0, 4.0))) == (1, [(3.0, 4.0)])
    nan = float("nan")
    for nothing in (None, b"", blob(struct.pack("<BIdd", 1, 1, nan, nan)), blob(b"", 0x11), blob(struct.pack("<BIII", 1, 4, 0, 0)), blob(struct.pack("<BII", 1, 6, 0))):
        assert geopackage.geometry(nothing) is None


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, 2.25, 0.123456, 3.0), (1, 0.0, 0.0, None, 1.0)], "id long, wx double, wy double, score double, radius double").orderBy("id").coalesce(1)
    text.write_csv(df, str(tmp_path / "csv"), {"wx": 3, "wy": 3, "score": 4})
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes() == b"id,wx,wy,score,radius\r\n1,0.000,0.000,,1.0\r\n2,1.500,2.250,0.1235,3.0\r\n"
    assert text.write_geojson(df, str(tmp_path / "p.json"), text.point_geometry(), ["id", "score"], "EPSG:32719", "points") == 2
    doc = json.loads((tmp_path / "p.json").read_text())
    assert doc["name"] == "points" and doc["crs"]["properties"]["name"] == "EPSG:32719"
    assert doc["features"][0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.0, 0.0]}, "properties": {"id": 1, "score": None}}
    text.write_geojson(df.where("false"), str(tmp_path / "none.json"), text.point_geometry(), ["id"])
    assert json.loads((tmp_path / "none.json").read_text()) == {"type": "FeatureCollection", "crs": None, "features": []}
    text.write_geojson_lines(df, str(tmp_path / "lines"), text.circle_geometry("radius"), ["id"])
    lines = [json.loads(x) for f in (tmp_path / "lines").glob("part-*") for x in f.read_text().splitlines()]
    ring = lines[1]["geometry"]["coordinates"][0]
    assert len(ring) == 25 and ring[0] == ring[-1] == [4.5, 2.25] and ring[6][1] == pytest.approx(5.25)
    text.write_json({"a": 1, "b": None}, str(tmp_path / "r/r.json"))
    assert json.loads((tmp_path / "r/r.json").read_text()) == {"a": 1, "b": None}
    assert [r[0] for r in df.select(text.fixed(F.col("radius"), 2)).collect()] == ["1.00", "3.00"]
