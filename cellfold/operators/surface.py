"""Surface areas on the WGS84 ellipsoid of polygons in degrees, and of what lies in a rectangle of degrees.

Edges are straight in degrees. The area left of a boundary is the integral, along its edges, of
longitude over the area of a band of latitudes; what lies in the rectangle is the same
integral with longitudes held to its sides and latitudes to its range. So nothing is clipped:
edges are cut where they cross its sides, and slanted pieces take Gauss–Legendre points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.functions.crs import WGS84_A, WGS84_F
from cellfold.functions.geometry import EARTH_SURFACE, MAX_ADDED, PIECE
from cellfold.operators.coverage import ring_area

E = math.sqrt(WGS84_F * (2 - WGS84_F))
B2 = (WGS84_A * (1 - WGS84_F)) ** 2
#: Places in (0, 1) and weights of Gauss–Legendre quadrature of five points.
_R1, _R2 = math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3
_W1, _W2 = (322 + 13 * math.sqrt(70)) / 1800, (322 - 13 * math.sqrt(70)) / 1800
QUADRATURE = ((0.5, 64 / 225), (0.5 - _R1 / 2, _W1), (0.5 + _R1 / 2, _W1), (0.5 - _R2 / 2, _W2), (0.5 + _R2 / 2, _W2))


def band_area(latitude: Column) -> Column:
    """Area per radian of longitude between the equator and a parallel, given in degrees."""
    s = F.sin(F.radians(latitude))
    return 0.5 * B2 * (s / (1 - E * E * s * s) + F.atanh(E * s) / E)


def _refuse(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def added_points(geometry: Column) -> Column:
    """Points that cutting all edges into pieces of ``PIECE`` degrees adds."""
    ring = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.greatest(F.ceil(F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / PIECE) - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.aggregate(F.transform(F.flatten(geometry), ring), F.lit(0).cast("long"), lambda a, n: a + n)


def surface_areas(features: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """(fid, whole, inside): square metres of each feature, and of its part within the rectangle.

    A feature that needs more than ``MAX_ADDED`` added points is refused, and so is a polygon that has no finite positive area
    or covers half of the Earth.
    """
    known = features.select("fid", _refuse(added_points(F.col("geometry")) > MAX_ADDED, f"Surface area would need more than {MAX_ADDED} added points; simplify the feature.", F.array_min(F.transform(F.flatten(F.flatten("geometry")), lambda p: p["x"]))).alias("ref"), F.posexplode("geometry").alias("part", "rings"))
    rings = known.select("fid", "part", "ref", F.posexplode("rings").alias("ring_no", "ring"))
    sign = F.signum(ring_area(F.col("ring"))) * F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    edges = rings.select("fid", "part", "ref", sign.alias("sign"), F.explode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1] as p, ring[i] as q))")).alias("e"))
    ends = [F.col(f"e.{end}.{c}").alias(f"{name}{c}") for name, end in (("a", "p"), ("b", "q")) for c in "xy"]
    edges = edges.select("fid", "part", "ref", "sign", *ends).where("ay <> by")
    # Places along an edge where it crosses a side of the rectangle.
    crossings = [F.try_divide(F.lit(float(v)) - F.col(f"a{c}"), F.col(f"b{c}") - F.col(f"a{c}")) for c, v in (("x", left), ("x", right), ("y", bottom), ("y", top))]
    places = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.array(*crossings), lambda t: (t > 0) & (t < 1)))))
    cut = edges.withColumn("t", places).withColumn("t", F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    on = lambda c, t: F.when(t == 1, F.col(f"b{c}")).otherwise(F.col(f"a{c}") + t * (F.col(f"b{c}") - F.col(f"a{c}")))
    cut = cut.select("fid", "part", "ref", "sign", *[on(c, F.col(f"t.{s}")).alias(f"{s}{c}") for s in "ab" for c in "xy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    count = F.when(dx == 0, 1).otherwise(F.greatest(F.ceil(F.hypot(dx, dy) / PIECE), F.lit(1))).cast("int")
    pieces = cut.withColumn("n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, u: F.col(f"a{c}") + (F.col("i") + u) / F.col("n") * (F.col(f"b{c}") - F.col(f"a{c}"))
    low, high = band_area(at("y", F.lit(0.0))), band_area(at("y", F.lit(1.0)))
    x0, x1 = (F.radians(at("x", F.lit(u)) - F.col("ref")) for u in (0.0, 1.0))
    # By parts, so that the longitude's change carries the quadrature: nothing is left of it on a meridian.
    mean = sum((w * band_area(at("y", F.lit(u))) for u, w in QUADRATURE), F.lit(0.0))
    along = x1 * high - x0 * low - (x1 - x0) * mean
    middle_x, middle_y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    held = lambda v: F.radians(F.lit(float(v)) - F.col("ref")) * (high - low)
    inside = F.when((middle_y < bottom) | (middle_y > top), 0.0).when(middle_x < left, held(left)).when(middle_x > right, held(right)).otherwise(along)
    summed = pieces.groupBy("fid", "part").agg(F.abs(F.sum(F.col("sign") * along)).alias("whole"), F.abs(F.sum(F.col("sign") * inside)).alias("inside"))
    whole = F.col("whole")
    whole = _refuse(F.isnan("whole") | (whole == float("inf")), "A polygon has no finite surface area.", _refuse(whole >= 0.5 * EARTH_SURFACE * (1 - 1e-12), "A polygon covers half or more of the Earth; split it first.", _refuse(whole <= 0, "A polygon has no positive surface area.", whole)))
    return summed.groupBy("fid").agg(F.sum(whole).alias("whole"), F.sum("inside").alias("inside"))
