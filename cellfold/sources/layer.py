"""Vector layers: a DataFrame with a geometry column, and one coordinate system."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.functions import geometry as G


@dataclass(frozen=True)
class VectorLayer:
    """Polygon features. ``geometry`` is an array of parts of rings of (x, y)."""

    frame: DataFrame
    crs: object = None
    geometry: str = "geometry"
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, features: list[tuple], schema: str, crs: object, **more) -> VectorLayer:
        """A small layer from rows whose last value is a geometry (nested lists, WKT or None).

        ``schema`` names the other columns and their types, as ``id long, risk string``.
        """
        rows = [(*row[:-1], None if row[-1] is None else G.to_rows(G.parse_wkt(row[-1]) if isinstance(row[-1], str) else row[-1])) for row in features]
        return cls(spark.createDataFrame(rows, ", ".join(filter(None, [schema, f"geometry {G.SCHEMA}"]))), crs, **more)


def _parsed(frame: DataFrame, column: str, parse: Callable, geometry: str) -> DataFrame:
    @F.pandas_udf(G.SCHEMA)
    def run(values):
        return values.map(lambda v: None if v is None else G.to_rows(parse(v)))

    return frame.withColumn(geometry, run(column))


def from_wkt(frame: DataFrame, column: str, crs: object, geometry: str = "geometry") -> VectorLayer:
    return VectorLayer(_parsed(frame, column, G.parse_wkt, geometry), crs, geometry)


def from_wkb(frame: DataFrame, column: str, crs: object, geometry: str = "geometry") -> VectorLayer:
    return VectorLayer(_parsed(frame, column, lambda v: G.parse_wkb(bytes(v)), geometry), crs, geometry)


def from_geojson(frame: DataFrame, column: str, crs: object, geometry: str = "geometry") -> VectorLayer:
    return VectorLayer(_parsed(frame, column, G.parse_geojson, geometry), crs, geometry)


def from_boxes(frame: DataFrame, x0: str, y0: str, x1: str, y1: str, crs: object, geometry: str = "geometry") -> VectorLayer:
    """Rectangles from four columns."""
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return VectorLayer(frame.withColumn(geometry, F.array(F.array(ring))), crs, geometry)
