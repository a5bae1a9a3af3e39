"""Text sinks: CSV with fixed decimals, GeoJSON collections, point styles and JSON reports."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import open_write


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimals and no grouping, rounded half to even on its binary value; null stays null."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else f"{v:.{places}f}" for v in values], dtype=object)

    return shown(c.cast("double"))


def write_csv(df: DataFrame, path: str, places: dict[str, int]) -> None:
    """A folder of CSV files with header and CRLF line ends; columns in places get that many decimals. The
    order of rows is kept where df is sorted."""
    shown = [fixed(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in df.columns]
    df.select(shown).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def point_geometry() -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array("wx", "wy").alias("coordinates")))


def circle_geometry(radius: str, segments: int = 24) -> Column:
    """A closed ring of segments + 1 corners round (wx, wy)."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: (i % segments) * (2 * math.pi / segments))
    ring = F.transform(turn, lambda t: F.array(F.col("wx") + F.cos(t) * F.col(radius), F.col("wy") + F.sin(t) * F.col(radius)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """value: a GeoJSON feature a row, with the properties in the order given; nulls are written as null."""
    shown = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), shown, F.lit("}")).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, geometry: Column, properties: list[str]) -> None:
    """A folder of newline-delimited features, written by all tasks."""
    features(df, geometry, properties).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, geometry: Column, properties: list[str], crs: str | None = None, name: str | None = None) -> int:
    """One FeatureCollection in one file, in the order of df; the number of features. The driver holds one
    partition at a time. For results without a size bound, write_geojson_lines() is the way."""
    head = {"type": "FeatureCollection"} | ({"name": name} if name else {}) | {"crs": {"type": "name", "properties": {"name": crs}} if crs else None}
    n = 0
    with open_write(path) as out:
        out.write((json.dumps(head)[:-1] + ', "features": [').encode())
        for row in features(df, geometry, properties).toLocalIterator():
            out.write((",\n" if n else "\n").encode() + row["value"].encode())
            n += 1
        out.write(b"\n]}\n")
    return n


def write_json(report: dict, path: str) -> None:
    """A small report (calibration, summary, model facts), indented."""
    with open_write(path) as out:
        out.write((json.dumps(report, indent=2, ensure_ascii=False) + "\n").encode())


def point_style(color: str = "255,255,0,255", size: float = 2.4) -> str:
    """A style file for a layer of points: filled circles with a dark rim."""
    options = {"name": "circle", "color": color, "outline_color": "0,0,0,255", "outline_width": "0.3", "size": str(size), "size_unit": "MM"}
    shown = "".join(f'<Option type="QString" name="{k}" value="{v}"/>' for k, v in options.items())
    return f"""<!DOCTYPE qgis PUBLIC 'http://mrcc.com/qgis.dtd' 'SYSTEM'>
<qgis version="3.0" styleCategories="Symbology">
  <renderer-v2 type="singleSymbol" symbollevels="0" enableorderby="0">
    <symbols><symbol type="marker" name="0" alpha="1" clip_to_extent="1"><layer class="SimpleMarker" enabled="1" locked="0" pass="0"><Option type="Map">{shown}</Option></layer></symbol></symbols>
  </renderer-v2>
  <layerGeometryType>0</layerGeometryType>
</qgis>
"""


def write_style(path: str) -> None:
    with open_write(path) as out:
        out.write(point_style().encode())
