"""GeoPackage layers: points and polygons read from files, points written as one file a partition.

Reading goes through Spark's binaryFile source, so any store will do and a folder of files is read in
parallel; each file is opened as an SQLite database in the memory of its task (2 GB at most).
"""

from __future__ import annotations

import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import open_write

# Bytes of the envelope by its kind in the header's flags, and the geometry types of WKB.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POINT, POLYGON, MULTIPOLYGON = 1, 3, 6
#: The application id of a GeoPackage ("GPKG") and the version 1.3.
APPLICATION, VERSION = 0x47504B47, 10300


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def geometry(blob: bytes | None) -> tuple[int, list] | None:
    """WKB type and coordinates: a point [(x, y)], or the rings of all polygons. None where empty, null or of another type."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    at = 8 + ENVELOPE[blob[3] >> 1 & 7]

    def head() -> tuple[str, int, int]:
        nonlocal at
        order = "<" if blob[at] else ">"
        kind = struct.unpack_from(order + "I", blob, at + 1)[0]
        at += 5
        more = (kind & 0xFFFF) // 1000
        wide = 2 + (more in (1, 3) or bool(kind & 0x80000000)) + (more in (2, 3) or bool(kind & 0x40000000))
        return order, (kind & 0xFFFF) % 1000, wide

    def number(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", blob, at - 4)[0]

    def spot(order: str, wide: int) -> tuple[float, float]:
        nonlocal at
        at += 8 * wide
        return struct.unpack_from(order + "dd", blob, at - 8 * wide)

    def rings(order: str, wide: int) -> list:
        return [[spot(order, wide) for _ in range(number(order))] for _ in range(number(order))]

    order, kind, wide = head()
    if kind == POINT:
        x, y = spot(order, wide)
        return (kind, [(x, y)]) if x == x and y == y else None
    if kind == POLYGON:
        found = rings(order, wide)
    elif kind == MULTIPOLYGON:
        found = []
        for _ in range(number(order)):
            inner, _, deep = head()
            found += rings(inner, deep)
    else:
        return None
    return (kind, found) if found else None


def _opened(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def _layers(db: sqlite3.Connection) -> list[tuple[str, str, str | None]]:
    """Name, geometry column and reference system of each layer of features, as the file lists them."""
    return db.execute(
        "select c.table_name, g.column_name, case when s.organization is not null and s.organization_coordsys_id > 0 then upper(s.organization) || ':' || s.organization_coordsys_id end "
        "from gpkg_contents c join gpkg_geometry_columns g on g.table_name = c.table_name left join gpkg_spatial_ref_sys s on s.srs_id = g.srs_id where c.data_type = 'features' order by c.rowid"
    ).fetchall()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")


def list_layers(spark: SparkSession, path: str) -> DataFrame:
    """path, layer (0 is a file's first), name, crs: a row per layer of features."""

    def look(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            rows = [(where.as_py(), i, name, crs) for where, content in zip(*batch.columns, strict=True) for i, (name, _, crs) in enumerate(_layers(_opened(content.as_py())))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "layer", "name", "crs"])

    return _files(spark, path).mapInArrow(look, "path string, layer int, name string, crs string")


def _features(spark: SparkSession, path: str, layer: str | None, crs: str | None) -> DataFrame:
    """fid, kind, rings of the layer (each file's first if none is named); kind is null where geometry() is None."""

    def read(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for content in batch.column(1):
                db = _opened(content.as_py())
                found = [x for x in _layers(db) if layer in (None, x[0])]
                if not found:
                    raise ValueError(f"no layer {layer or 'of features'}")
                name, column, own = found[0]
                if crs and own and own != crs:
                    raise ValueError(f"reference system {own} of the layer is not {crs}")
                rows = db.execute(f"select rowid, {_quoted(column)} from {_quoted(name)} order by rowid")
                while part := rows.fetchmany(10_000):
                    shapes = [geometry(blob) for _, blob in part]
                    flat = [None if g is None else [[{"x": x, "y": y} for x, y in ring] for ring in ([g[1]] if g[0] == POINT else g[1])] for g in shapes]
                    spots = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([g and g[0] for g in shapes], pa.int32()), pa.array(flat, spots)], names=["fid", "kind", "rings"])

    return _files(spark, path).mapInArrow(read, "fid long, kind int, rings array<array<struct<x:double,y:double>>>")


def read_points(spark: SparkSession, path: str, layer: str | None = None, crs: str | None = None) -> DataFrame:
    """fid, wx, wy of the layer's points; other types and empty geometries are left out. Raises ValueError on
    reading where both reference systems are known and differ."""
    one = F.col("rings")[0][0]
    return _features(spark, path, layer, crs).where(F.col("kind") == POINT).select("fid", one["x"].alias("wx"), one["y"].alias("wy"))


def read_polygons(spark: SparkSession, path: str, layer: str | None = None, crs: str | None = None) -> DataFrame:
    """fid, rings of the layer's polygons (of a multi-polygon, the rings of all parts); others are left out."""
    return _features(spark, path, layer, crs).where(F.col("kind").isin(POLYGON, MULTIPOLYGON)).select("fid", "rings")


def _build(file: Path, layer: str, fields: list[tuple[str, str]], epsg: int | None, rows: Iterator[tuple]) -> int:
    """Writes rows (wx, wy, fields) as a GeoPackage; the number of points."""
    db, srs, n = sqlite3.connect(file), epsg or 0, 0
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    db.executescript(f"""pragma application_id = {APPLICATION}; pragma user_version = {VERSION};
        create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
        create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer references gpkg_spatial_ref_sys (srs_id));
        create table gpkg_geometry_columns (table_name text primary key references gpkg_contents (table_name), column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);
        create table {_quoted(layer)} (fid integer primary key autoincrement, geom blob{"".join(f", {_quoted(k)} {t}" for k, t in fields)});""")
    systems = [("Undefined Cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None)]
    db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, ?, ?)", systems + ([(f"EPSG:{epsg}", epsg, "EPSG", epsg, "undefined", None)] if epsg else []))
    put = f"insert into {_quoted(layer)} (geom{''.join(', ' + _quoted(k) for k, _ in fields)}) values (?{', ?' * len(fields)})"
    for x, y, *others in rows:
        empty = x is None or y is None
        blob = None if empty else struct.pack("<2sBBi", b"GP", 0, 1, srs) + struct.pack("<BIdd", 1, POINT, x, y)
        if not empty:
            box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
        db.execute(put, (blob, *others))
        n += 1
    limits = box if box[0] <= box[2] else [None] * 4
    db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *limits, srs))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POINT', ?, 0, 0)", (layer, srs))
    db.commit()
    db.close()
    return n


def write_points(points: DataFrame, path: str, layer: str, epsg: int | None = None) -> int:
    """Writes wx, wy and the other columns (numbers and strings) to the folder path, a file a partition;
    coalesce(1) first for a single file. Files of an earlier run with the same names are replaced. A point
    without a coordinate has no geometry. The number of points. Each file is built in the task's temporary
    folder and then sent to path whole, so a repeated task rewrites its own file."""
    kinds = {"long": "integer", "bigint": "integer", "int": "integer", "double": "double", "float": "double", "string": "text", "boolean": "boolean"}
    fields = [(k, kinds[t]) for k, t in points.dtypes if k not in ("wx", "wy")]
    names = [k for k, _ in fields]

    def write(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own:
            file = Path(own, "part.gpkg")
            rows = (tuple(r.values()) for batch in arrow for r in batch.to_pylist())
            n = _build(file, layer, fields, epsg, rows)
            if n:
                with file.open("rb") as built, open_write(f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.gpkg") as out:
                    while data := built.read(1 << 20):
                        out.write(data)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return points.select("wx", "wy", *names).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
