"""Vector file scans: GeoJSON, Shapefile and GeoPackage.

GeoJSON goes through Spark's JSON reader. The other two are read on the driver, and
their rows are handed to Spark; they are formats of single, small files.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import struct

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfold.functions import geometry as G
from cellfold.sources.layer import VectorLayer


def read_vector(spark: SparkSession, path: str | os.PathLike) -> VectorLayer:
    """The polygon features of a file, by its suffix."""
    path = os.fspath(path)
    suffix = os.path.splitext(path)[1].lower()
    try:
        if suffix in (".geojson", ".json"):
            return read_geojson(spark, path)
        if suffix == ".gpkg":
            return read_geopackage(spark, path)
        if suffix == ".shp":
            return read_shapefile(spark, path)
    except (OSError, struct.error, sqlite3.Error, json.JSONDecodeError, KeyError, IndexError) as error:
        raise ValueError(f"hazard vector could not be read: {path}.") from error
    raise ValueError(f"hazard path must be a vector file; got {suffix!r}.")


def read_geojson(spark: SparkSession, path: str) -> VectorLayer:
    """A FeatureCollection: property columns and geometry. The system is WGS84 unless a ``crs`` member names one."""
    with open(path, "rb") as f:
        if f.read(64).lstrip()[:1] != b"{":
            raise ValueError(f"hazard vector could not be read: {path}.")
    read = spark.read.option("multiLine", True).option("primitivesAsString", False)
    raw = read.json(path)
    if "features" not in raw.columns:
        raise ValueError(f"hazard vector could not be read: {path}.")
    crs = "EPSG:4326"
    if "crs" in raw.columns and (named := raw.select("crs.properties.name").first()[0]):
        crs = named
    kinds = raw.schema["features"].dataType.elementType
    # Coordinates differ in depth between the two polygon types, so they are parsed as text.
    text = spark.read.option("multiLine", True).schema("features array<struct<geometry:string>>").json(path)
    shapes = text.select(F.posexplode("features").alias("__n", "g")).select("__n", F.col("g.geometry").alias("__text"))
    rows = raw.select(F.posexplode("features").alias("__n", "f"))
    names = kinds["properties"].dataType.names if "properties" in kinds.names and isinstance(kinds["properties"].dataType, T.StructType) else []
    rows = rows.select("__n", *[F.col(f"f.properties.`{n}`").alias(n) for n in names])

    @F.pandas_udf(G.SCHEMA)
    def parse(values):
        return values.map(lambda v: None if v is None else G.to_rows(G.parse_geojson(v)))

    frame = rows.join(shapes, "__n").select(*[F.col(f"`{n}`") for n in names], parse("__text").alias("geometry"))
    return VectorLayer(frame, crs)


#: Names of known systems in well-known text.
WKT_NAMES = {"WGS_1984_WEB_MERCATOR": "EPSG:3857", "PSEUDO-MERCATOR": "EPSG:3857", "MOLLWEIDE": "ESRI:54009", "ETRS_1989_LAEA": "EPSG:3035", "ETRS89 / LAEA": "EPSG:3035", "ETRS89-EXTENDED / LAEA": "EPSG:3035", "EASE_GRID": "EPSG:6933", "EASE-GRID": "EPSG:6933", "NTF (PARIS)": "EPSG:4807", "NTF_PARIS": "EPSG:4807"}


def crs_of_wkt(text: str) -> str | None:
    """The known system that well-known text describes."""
    if found := re.findall(r'AUTHORITY\["(EPSG|ESRI)","?(\d+)"?\]\]\s*$|ID\["(EPSG|ESRI)",(\d+)\]\]\s*$', text.strip()):
        a, b, c, d = found[-1]
        return f"{a or c}:{b or d}"
    upper = text.upper()
    for name, crs in WKT_NAMES.items():
        if name in upper:
            return crs
    return "EPSG:4326" if upper.startswith("GEOG") and "WGS" in upper and "84" in upper else None


def read_shapefile(spark: SparkSession, path: str) -> VectorLayer:
    """A polygon shapefile with its DBF attributes and PRJ system."""
    base = os.path.splitext(path)[0]
    with open(path, "rb") as f:
        data = f.read()
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError(f"hazard vector could not be read: {path}.")
    shapes, at = [], 100
    while at + 8 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        shapes.append(_shape(data[at + 8 : at + 8 + length]))
        at += 8 + length
    fields, rows = _dbf(f"{base}.dbf") if os.path.isfile(f"{base}.dbf") else ([], [()] * len(shapes))
    crs = None
    if os.path.isfile(f"{base}.prj"):
        with open(f"{base}.prj", encoding="utf-8") as f:
            crs = crs_of_wkt(f.read())
    schema = T.StructType([*fields, T.StructField("geometry", T._parse_datatype_string(G.SCHEMA))])
    return VectorLayer(spark.createDataFrame([(*r, None if s is None else G.to_rows(s)) for r, s in zip(rows, shapes, strict=True)], schema), crs)


def _shape(data: bytes) -> G.Geometry | None:
    kind = struct.unpack_from("<i", data)[0]
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        raise ValueError(f"hazard vector must contain only Polygon or MultiPolygon geometry; found shape type {kind}.")
    parts, points = struct.unpack_from("<ii", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), points]
    xy = np.frombuffer(data, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b].copy() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    # Clockwise rings are shells; a hole goes to the smallest shell around it.
    out = [[r] for r in rings if G.ring_area(r) < 0] or [[r] for r in rings]
    for hole in (r for r in rings if G.ring_area(r) >= 0 and any(part[0] is not r for part in out) and not any(part[0] is r for part in out)):
        around = [p for p in out if G.points_inside(0.5 * (hole[:1] + hole[1:2]), p[0])[0]]
        (min(around, key=lambda p: abs(G.ring_area(p[0]))) if around else out[0]).append(hole)
    return out


def _dbf(path: str) -> tuple[list[T.StructField], list[tuple]]:
    with open(path, "rb") as f:
        head = f.read(32)
        count, start, length = struct.unpack_from("<IHH", head, 4)
        columns = []
        while (entry := f.read(32))[:1] not in (b"\r", b""):
            columns.append((entry[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(entry[11]), entry[16], entry[17]))
        f.seek(start)
        records = [f.read(length) for _ in range(count)]
    rows = []
    for record in records:
        row, at = [], 1
        for _, kind, size, places in columns:
            text = record[at : at + size].decode("utf-8", "replace").strip()
            at += size
            if kind in "NF":
                row.append(None if not text or set(text) == {"*"} else float(text) if places or kind == "F" else int(text))
            elif kind == "L":
                row.append({"Y": True, "T": True, "N": False, "F": False}.get(text.upper()))
            else:
                row.append(text or None)
        rows.append(tuple(row))
    kinds = [T.BooleanType() if k == "L" else (T.DoubleType() if p or k == "F" else T.LongType()) if k in "NF" else T.StringType() for _, k, _, p in columns]
    return [T.StructField(c[0], k) for c, k in zip(columns, kinds, strict=True)], rows


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> VectorLayer:
    """The first (or named) feature table of a GeoPackage."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        tables = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()
        table, column, srs = next(t for t in tables if layer in (None, t[0]))
        found = db.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone()
        quoted = '"' + table.replace('"', '""') + '"'
        info = db.execute(f"pragma table_info({quoted})").fetchall()
        names = [c[1] for c in info if c[1] != column and not c[5]]
        kinds = [_sql_type(c[2]) for c in info if c[1] != column and not c[5]]
        picked = ", ".join('"' + n.replace('"', '""') + '"' for n in [*names, column])
        rows = db.execute(f"select {picked} from {quoted}").fetchall()
    finally:
        db.close()
    schema = T.StructType([*[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], T.StructField("geometry", T._parse_datatype_string(G.SCHEMA))])
    fix = lambda v, k: None if v is None else float(v) if isinstance(k, T.DoubleType) else bool(v) if isinstance(k, T.BooleanType) else v if isinstance(k, (T.LongType, T.BinaryType)) else str(v)
    data = [(*[fix(v, k) for v, k in zip(r[:-1], kinds, strict=True)], _gpkg_shape(r[-1])) for r in rows]
    return VectorLayer(spark.createDataFrame(data, schema), f"{found[0].upper()}:{found[1]}" if found and found[0].upper() in ("EPSG", "ESRI") else None)


def _sql_type(name: str) -> T.DataType:
    name = name.upper()
    if name.startswith("BOOL"):
        return T.BooleanType()
    if "INT" in name:
        return T.LongType()
    return T.DoubleType() if name.startswith(("REAL", "DOUBLE", "FLOAT")) else T.BinaryType() if name.startswith("BLOB") else T.StringType()


def _gpkg_shape(blob: bytes | None):
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("hazard vector has a geometry that isn't a GeoPackage one.")
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return [] if blob[3] & 0x10 else G.to_rows(G.parse_wkb(blob[8 + envelope :]))
