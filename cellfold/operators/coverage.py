"""Shares of grid cells that polygons cover, in DataFrame operations only.

Vertices are mapped to grid coordinates, where cells are unit squares. By Green's
theorem a polygon's share of a cell is a sum over its edges' pieces in the cell's row:
a piece within the cell adds the area to its left, and a piece in a column further right
adds its whole height. So edges are cut at rows, then at columns, summed by (feature,
row, column), and a suffix sum along each row adds what lies to the right. One huge
feature spreads over its rows; no join compares polygons with cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.sources.grid import GridSpec

#: Shares at most this are dropped: rounding along boundaries.
NEGLIGIBLE = 1e-12


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed ring of points (x, y), from its first point."""
    origin = F.element_at(ring, 1)
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: (p["x"] - origin["x"]) * (q["y"] - origin["y"]) - (q["x"] - origin["x"]) * (p["y"] - origin["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) * 0.5


def plane_area(geometry: Column) -> Column:
    """Area of a geometry: shells less holes."""
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda acc, v: acc + v)
    return F.aggregate(F.transform(geometry, part), F.lit(0.0), lambda acc, v: acc + v)


def cell_shares(features: DataFrame, spec: GridSpec, fid: str = "fid", geometry: str = "geometry") -> DataFrame:
    """(fid, row, col, share) of every cell of the grid that a feature covers in part or whole."""
    return _filled(boundary_pieces(features, spec, fid, geometry), spec.width)


def boundary_pieces(features: DataFrame, spec: GridSpec, fid: str = "fid", geometry: str = "geometry") -> DataFrame:
    """(fid, row, col, cover, part): by cell, the summed heights of the edges' pieces in it and the areas left of them.

    Columns left of the grid are all -1, those right of it all its width; neither has a part.
    """
    rows = with_rows(grid_edges(features.select(F.col(fid).alias("fid"), F.col(geometry).alias("geometry")), spec), spec.height)
    rows = cut_at_rows(rows.withColumn("row", F.explode(F.sequence("r0", "r1"))), spec.width).where("dy <> 0")
    pieces = cut_at_columns(rows.withColumn("col", F.explode(F.sequence("c0", "c1"))), spec.width)
    return pieces.groupBy("fid", "row", "col").agg(F.sum("cover").alias("cover"), F.sum("part").alias("part"))


def grid_edges(features: DataFrame, spec: GridSpec) -> DataFrame:
    """The edges of ``features(fid, geometry)`` from (ax, ay) to (bx, by) in grid coordinates, with their sign, slope and the other columns.

    Edges along a row bound nothing and are left out.
    """
    rest = [c for c in features.columns if c != "geometry"]
    rings = features.select(*rest, F.explode("geometry").alias("part"))
    rings = rings.select(*rest, F.posexplode("part").alias("ring_no", "ring"))
    # Shells are counted positive and holes negative, whatever their direction.
    sign = F.signum(ring_area(F.col("ring"))) * F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    edges = rings.select(*rest, sign.alias("sign"), F.explode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1] as p, ring[i] as q))")).alias("e"))
    ax, ay = spec.to_cell(F.col("e.p.x"), F.col("e.p.y"))
    bx, by = spec.to_cell(F.col("e.q.x"), F.col("e.q.y"))
    flip = 1.0 if spec.determinant > 0 else -1.0
    edges = edges.select(*rest, (F.col("sign") * flip).alias("sign"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).where("ay <> by")
    return edges.withColumn("slope", (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))


def with_rows(edges: DataFrame, height: int) -> DataFrame:
    """Edges with the first and the last row of the grid that they touch, ``r0`` and ``r1``; those that touch none are left out."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.greatest(F.floor(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(height - 1))
    return edges.withColumns({"r0": first.cast("int"), "r1": last.cast("int")}).where("r0 <= r1")


def _at(y: str) -> Column:
    """Where an edge is at a height."""
    return F.when(F.col(y) == F.col("ay"), F.col("ax")).when(F.col(y) == F.col("by"), F.col("bx")).otherwise(F.col("ax") + (F.col(y) - F.col("ay")) * F.col("slope"))


def cut_at_rows(rows: DataFrame, width: int, first: str = "row", last: str = "row") -> DataFrame:
    """Edges' pieces between two rows, in the edge's direction: from x0 to x1, of height dy, touching columns c0 to c1."""
    y0, y1 = (F.greatest(F.least(F.col(c), F.col(last) + 1.0), F.col(first).cast("double")) for c in ("ay", "by"))
    rows = rows.withColumns({"y0": y0, "y1": y1})
    rows = rows.withColumns({"x0": _at("y0"), "x1": _at("y1"), "dy": F.col("y1") - F.col("y0")})
    # Columns left of the grid are all -1; right of it all ``width``, which covers its row whole.
    clamp = lambda c: F.greatest(F.least(c, F.lit(width)), F.lit(-1)).cast("int")
    c0 = clamp(F.floor(F.least("x0", "x1")))
    return rows.withColumns({"c0": c0, "c1": F.greatest(c0, clamp(F.ceil(F.greatest("x0", "x1")) - 1))})


def cut_at_columns(cols: DataFrame, width: int) -> DataFrame:
    """The signed height ``cover`` of a row's piece in column ``col``, and the signed area ``part`` left of it in its cell."""
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    lower = F.when(F.col("col") < 0, left).otherwise(F.greatest(left, F.col("col").cast("double")))
    upper = F.when(F.col("col") >= width, right).when(F.col("col") < 0, F.least(right, F.lit(0.0))).otherwise(F.least(right, F.col("col") + 1.0))
    run = F.col("x1") - F.col("x0")
    cover = F.when(run == 0, F.col("dy")).otherwise(F.col("dy") * F.try_divide(upper - lower, F.abs(run)))
    cols = cols.withColumns({"cover": F.col("sign") * cover, "mean": (lower + upper) / 2 - F.col("col")})
    return cols.withColumn("part", F.when(F.col("col").between(0, width - 1), F.col("cover") * F.col("mean")).otherwise(0.0))


def _filled(summed: DataFrame, width: int) -> DataFrame:
    # A row's cells between its outer boundary pieces are filled in up to the next piece on the left.
    along = Window.partitionBy("fid", "row").orderBy("col")
    after = along.rowsBetween(1, Window.unboundedFollowing)
    placed = summed.select("fid", "row", "col", "part", F.coalesce(F.sum("cover").over(after), F.lit(0.0)).alias("beyond"), F.coalesce(F.lag("col").over(along), F.lit(None)).alias("before"), F.col("cover").alias("own"))
    own = placed.select("fid", "row", "col", (F.col("part") + F.col("beyond")).alias("share"))
    gap = placed.where(F.col("before").isNotNull() & (F.col("col") - F.col("before") > 1))
    filled = gap.select("fid", "row", F.explode(F.sequence(F.greatest(F.col("before") + 1, F.lit(0)), F.col("col") - 1)).alias("col"), (F.col("beyond") + F.col("own")).alias("share"))
    both = own.unionByName(filled).where(F.col("col").between(0, width - 1))
    return both.select("fid", "row", "col", F.least(F.abs("share"), F.lit(1.0)).alias("share")).where(F.col("share") > NEGLIGIBLE)


def centers_inside(features: DataFrame, spec: GridSpec, fid: str = "fid", geometry: str = "geometry") -> DataFrame:
    """(fid, row, col) of cells whose centre lies in a feature, by the even-odd rule.

    Each edge that crosses a row's middle gives one crossing; a row's sorted crossings
    pair up to runs of columns.
    """
    rings = features.select(F.col(fid).alias("fid"), F.explode(F.flatten(F.col(geometry))).alias("ring"))
    edges = rings.select("fid", F.explode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1] as p, ring[i] as q))")).alias("e"))
    ax, ay = spec.to_cell(F.col("e.p.x"), F.col("e.p.y"))
    bx, by = spec.to_cell(F.col("e.q.x"), F.col("e.q.y"))
    edges = edges.select("fid", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).where("ay <> by")
    # Middles row + 0.5 in (low, high] of the edge.
    r0 = F.greatest(F.floor(F.least("ay", "by") - 0.5) + 1, F.lit(0)).cast("int")
    r1 = F.least(F.floor(F.greatest("ay", "by") - 0.5), F.lit(spec.height - 1)).cast("int")
    rows = edges.withColumns({"r0": r0, "r1": r1}).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    x = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    crossed = rows.select("fid", "row", x.alias("x"))
    order = Window.partitionBy("fid", "row").orderBy("x")
    runs = crossed.select("fid", "row", "x", F.lead("x").over(order).alias("x2"), F.row_number().over(order).alias("n")).where("n % 2 = 1 and x2 is not null")
    c0 = F.greatest(F.floor(F.col("x") - 0.5) + 1, F.lit(0)).cast("int")
    c1 = F.least(F.floor(F.col("x2") - 0.5), F.lit(spec.width - 1)).cast("int")
    runs = runs.select("fid", "row", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")
    return runs.select("fid", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
