"""GeoTIFF rasters as tables of pixels, read by blocks and written by strips.

Read: spark.dataSource.register(GeoTiff), then spark.read.format("geotiff").load(path), or read_raster().
Every partition reads the byte ranges of its own blocks, so a raster is never whole in any process, and a
window reads the blocks that it touches and no others. Strips and tiles, classic and BigTIFF, both byte
orders, pixel-interleaved and planar bands, uncompressed, LZW and deflate, with or without horizontal prediction.
Other compressions raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.state import materialize
from tessera.sources.files import open_read, open_write

# Bytes and letters of the TIFF field types, tag and key numbers of TIFF 6.0 and GeoTIFF 1.1.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS = 33550, 33922, 34264, 34735
PROJECTED, GEOGRAPHIC = 3072, 2048
#: Pixels of one partition, about.
PARTITION_PIXELS = 4 << 20


@dataclass
class Raster:
    """What the header says. transform: a, b, c, d, e, f with x = a * col + b * row + c, y = d * col + e * row + f."""

    width: int
    height: int
    count: int
    dtype: str
    transform: tuple[float, ...]
    crs: str | None
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    planar: bool
    tiled: bool

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top of the four corners."""
        a, b, c, d, e, f = self.transform
        xs = [a * x + b * y + c for x in (0, self.width) for y in (0, self.height)]
        ys = [d * x + e * y + f for x in (0, self.width) for y in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)


def _fields(file: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    """Byte order, and the values by tag of the first image."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or (kind := struct.unpack(order + "H", head[2:4])[0]) not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    file.seek(struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0])
    entries = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    step, room = (20, 8) if big else (12, 4)
    table, out = file.read(entries * step), {}
    for i in range(entries):
        entry = table[i * step : (i + 1) * step]
        tag, field = struct.unpack(order + "HH", entry[:4])
        n = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + room])[0]
        form = FIELD.get(field)
        if form is None:
            continue
        form = order + (form[0] * (n * len(form)) if form != "c" else f"{n}s")
        data = entry[-room:]
        if struct.calcsize(form) > room:
            file.seek(struct.unpack(order + ("Q" if big else "I"), data)[0])
            data = file.read(struct.calcsize(form))
        out[tag] = struct.unpack(form, data[: struct.calcsize(form)])
    return order, out


def raster_meta(path: str) -> Raster:
    """The header of a raster: size, bands, type, transform, reference system and blocks."""
    with open_read(path) as file:
        order, tags = _fields(file)
    width, height, count = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    if len(set(tags.get(BITS, (1,)))) > 1 or tags.get(BITS, (1,))[0] not in (8, 16, 32, 64):
        raise ValueError(f"bands of {tags.get(BITS)} bits")
    if tags.get(COMPRESSION, (1,))[0] not in (1, 5, 8, 32946):
        raise ValueError(f"compression {tags[COMPRESSION][0]}")
    if tags.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"predictor {tags[PREDICTOR][0]}")
    transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (col, row, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        transform = (sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(STRIP_ROWS, (height,))[0]), width)
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    return Raster(
        width, height, count, f"{order}{kind}{tags[BITS][0] // 8}", transform, f"EPSG:{code}" if code else None, block,
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES],
        tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0] == 2, tiled,
    )


def lzw(data: bytes) -> bytes:
    """Decodes a block of TIFF's LZW: codes of 9 to 12 bits, the highest bit first; 256 begins a new table, 257 ends."""
    out, table, last = [], [bytes([k]) for k in range(256)] + [b"", b""], b""
    held = bits = 0
    wide = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= wide:
            bits -= wide
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 257:
                return b"".join(out)
            if code == 256:
                del table[258:]
                last, wide = b"", 9
                continue
            if last:
                table.append(last + (table[code] if code < len(table) else last)[:1])
            last = table[code]
            out.append(last)
            wide = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


@dataclass
class Blocks(InputPartition):
    """Row and column of the first pixel of each block, and the place and size of its planes."""

    places: list[tuple[int, int, list[tuple[int, int]]]]


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, bands: list[int], window: tuple[int, int, int, int] | None):
        self.path, self.bands = path, bands
        self.meta = raster_meta(path)
        if any(not 1 <= b <= self.meta.count for b in bands):
            raise ValueError(f"bands {bands} of {self.meta.count}")
        col, row, width, height = window or (0, 0, self.meta.width, self.meta.height)
        self.box = max(0, row), max(0, col), min(row + height, self.meta.height), min(col + width, self.meta.width)

    def partitions(self) -> list[Blocks]:
        m, (top, left, bottom, right) = self.meta, self.box
        high, wide = m.block
        across, down = -(-m.width // wide), -(-m.height // high)
        planes = m.count if m.planar else 1
        places = []
        for r in range(top // high, -(-bottom // high) if bottom > top else 0):
            for c in range(left // wide, -(-right // wide) if right > left else 0):
                at = [p * across * down + r * across + c for p in range(planes)]
                places.append((r * high, c * wide, [(m.offsets[i], m.sizes[i]) for i in at]))
        self.meta.offsets = self.meta.sizes = ()  # tasks carry their own places only
        each = max(1, PARTITION_PIXELS // (high * wide))
        return [Blocks(places[i : i + each]) for i in range(0, len(places), each)]

    def _plane(self, data: bytes, samples: int, rows: int) -> np.ndarray:
        m = self.meta
        data = data if m.compression == 1 else lzw(data) if m.compression == 5 else zlib.decompress(data)
        out = np.frombuffer(data, m.dtype, rows * m.block[1] * samples).reshape(rows, m.block[1], samples)
        out = out.astype(out.dtype.newbyteorder("="))
        return np.cumsum(out, axis=1, dtype=out.dtype) if m.predictor == 2 else out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        m, (top, left, bottom, right) = self.meta, self.box
        names = ["row", "col", *(f"band{b}" for b in self.bands)]
        with open_read(self.path) as file:
            for row, col, parts in partition.places:
                rows = m.block[0] if m.tiled else min(m.block[0], m.height - row)
                planes = []
                for offset, size in parts:
                    file.seek(offset)
                    planes.append(self._plane(file.read(size), 1 if m.planar else m.count, rows))
                image = np.concatenate(planes, axis=2)
                lo_r, hi_r, lo_c, hi_c = max(top - row, 0), min(bottom - row, rows), max(left - col, 0), min(right - col, m.block[1])
                image = image[lo_r:hi_r, lo_c:hi_c]
                grid = np.indices(image.shape[:2], np.int32)
                columns = [grid[0].ravel() + np.int32(row + lo_r), grid[1].ravel() + np.int32(col + lo_c), *(image[:, :, b - 1].ravel().astype(np.float64) for b in self.bands)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


class GeoTiff(DataSource):
    """Options: path, bands ("1,2,3"; all if absent), window ("col,row,width,height", clipped to the raster)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _bands(self) -> list[int]:
        given = self.options.get("bands")
        return [int(b) for b in given.split(",")] if given else list(range(1, raster_meta(self.options["path"]).count + 1))

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"band{b} double" for b in self._bands())

    def reader(self, schema) -> GeoTiffReader:
        window = self.options.get("window")
        return GeoTiffReader(self.options["path"], self._bands(), tuple(int(x) for x in window.split(",")) if window else None)


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """row, col and a double for each band (band1 ...); bands are numbered from 1, in the order given."""
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff")
    if bands:
        reader = reader.option("bands", ",".join(map(str, bands)))
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    return reader.load(path)


def write_raster(pixels: DataFrame, path: str, bands: list[str], width: int, height: int, transform: tuple[float, ...], epsg: int | None = None, strip_rows: int = 64) -> None:
    """Writes row, col and the bands (0 to 255; truncated, and clipped to that range) as a BigTIFF of bytes,
    deflated by strips. Pixels that are missing or null are 0; of repeated pixels, the largest value counts.
    A strip is built in one task (strip_rows x width pixels); the driver streams finished strips into the file."""
    count, strips = len(bands), -(-height // strip_rows)

    def deflate(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        image = np.zeros((min(strip_rows, height - number * strip_rows), width, count), np.uint8)
        at = table["row"].to_numpy() - number * strip_rows, table["col"].to_numpy()
        for k, band in enumerate(bands):
            np.maximum.at(image[:, :, k], at, np.clip(np.nan_to_num(table[band].to_numpy().astype(np.float64)), 0, 255).astype(np.uint8))
        return pa.table({"strip": pa.array([number], pa.int32()), "data": pa.array([zlib.compress(image.tobytes())], pa.binary())})

    inside = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    rows = inside.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *(F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in bands))
    rows = rows.withColumn("strip", F.floor(F.col("row") / strip_rows).cast("int"))
    made = materialize(rows.groupBy("strip").applyInArrow(deflate, "strip int, data binary"), "strips")
    sizes = {r["strip"]: r["n"] for r in made.select("strip", F.length("data").alias("n")).toLocalIterator()}  # a number for each strip
    blank = lambda n: zlib.compress(bytes(min(strip_rows, height - n * strip_rows) * width * count))
    lengths = [sizes[n] if n in sizes else len(blank(n)) for n in range(strips)]

    a, b, c, d, e, f = transform
    entries = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8] * count), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [2 if count >= 3 else 1]),
        (STRIP_OFFSETS, "Q", [0] * strips), (SAMPLES, "H", [count]), (STRIP_ROWS, "I", [strip_rows]), (STRIP_SIZES, "Q", lengths), (PLANAR, "H", [1]),
        (FORMAT, "H", [1] * count), (MATRIX, "d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]),
    ]
    if epsg:
        entries.append((GEO_KEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, epsg]))
    code = {"H": 3, "I": 4, "Q": 16, "d": 12}
    extra = 16 + 8 + 20 * len(entries) + 8
    data_at = extra + sum(-(-len(v) * struct.calcsize("<" + k) // 8) * 8 for _, k, v in entries if len(v) * struct.calcsize("<" + k) > 8)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1] + data_at
    table, far = b"", b""
    for tag, kind, values in entries:
        values = [int(s) for s in starts] if tag == STRIP_OFFSETS else values
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) > 8:
            place = struct.pack("<Q", extra + len(far))
            far += raw.ljust(-(-len(raw) // 8) * 8, b"\0")
        else:
            place = raw.ljust(8, b"\0")
        table += struct.pack("<HHQ", tag, code[kind], len(values)) + place
    with open_write(path) as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + table + struct.pack("<Q", 0) + far)
        due = 0
        for row in made.orderBy("strip").toLocalIterator():
            for n in range(due, row["strip"]):
                out.write(blank(n))
            out.write(bytes(row["data"]))
            due = row["strip"] + 1
        for n in range(due, strips):
            out.write(blank(n))
