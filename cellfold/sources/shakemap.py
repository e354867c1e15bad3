"""Shaking-intensity grids in XML: a specification and rows of text, at cell centres."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellfold.sources.grid import GridSpec, Raster


def read_shakemap(spark: SparkSession, path: str | os.PathLike, field: str = "MMI") -> Raster:
    """One field of a grid.xml as a north-up raster in WGS84 degrees.

    Nominal centres must be evenly spaced, in rows from the north and columns from the
    west; anything else is refused.
    """
    root = ET.parse(os.fspath(path)).getroot()
    name = lambda e: e.tag.rpartition("}")[2]
    by = {}
    fields = {}
    for e in root.iter():
        by.setdefault(name(e), e)
        if name(e) == "grid_field":
            fields[e.get("name").upper()] = int(e.get("index")) - 1
    if "grid_specification" not in by or "grid_data" not in by or field.upper() not in fields or not {"LON", "LAT"} <= fields.keys():
        raise ValueError(f"not a shaking grid with LON, LAT and {field}: {path}.")
    spec = by["grid_specification"]
    width, height = int(spec.get("nlon")), int(spec.get("nlat"))
    values = np.array((by["grid_data"].text or "").split(), float)
    if not width * height or values.size != width * height * len(fields):
        raise ValueError("the grid's data don't fit its specification.")
    table = values.reshape(height, width, len(fields))
    lon, lat, found = (table[:, :, fields[k]] for k in ("LON", "LAT", field.upper()))
    dx = float(spec.get("nominal_lon_spacing") or (lon[0, -1] - lon[0, 0]) / max(1, width - 1))
    dy = float(spec.get("nominal_lat_spacing") or (lat[0, 0] - lat[-1, 0]) / max(1, height - 1))
    left, top = lon[0, 0], lat[0, 0]
    if width > 1:
        dx = (lon[0, -1] - left) / (width - 1)
    if height > 1:
        dy = (top - lat[-1, 0]) / (height - 1)
    grid_x, grid_y = left + dx * np.arange(width), top - dy * np.arange(height)
    if dx <= 0 or dy <= 0 or np.abs(lon - grid_x).max() > 0.01 * dx or np.abs(lat - grid_y[:, None]).max() > 0.01 * dy:
        raise ValueError("the grid's centres must be evenly spaced, from north to south and west to east.")
    out = GridSpec.north_up(left - dx / 2, top + dy / 2, dx, dy, width, height, "EPSG:4326")
    rows = spark.createDataFrame([(r, found[r].tolist()) for r in range(height)], "row int, vals array<double>")
    return Raster(out, rows.select("row", F.posexplode("vals").alias("col", "value")), os.fspath(path))
