"""Zonal sums over a grid stored by block: only cells on a polygon's boundary are looked up.

By Green's theorem a weighted sum of a row's cells is a sum over the pieces of the polygon's
edges in that row. A piece in column c adds its height times what the row holds before c,
which is stored, and the area to its left times the cell's own value. So the interior is
never visited, and blocks that no edge crosses are never read.

Edges go to the blocks they cross and are cut at rows and columns there, beside the strips: what
is shuffled is an edge for each block, not a piece for each cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.operators.coverage import boundary_pieces, cut_at_columns, cut_at_rows, grid_edges, plane_area, with_rows
from cellfold.sources.block_grid import BlockGrid


def boundary_points(features: DataFrame, grid: BlockGrid) -> DataFrame:
    """(fid, row, col, cover, part, tile): summed pieces of a feature's edges by the cell they lie in.

    Pieces right of the grid stand at column ``width``; pieces left of it cover nothing and are left out.
    """
    pieces = boundary_pieces(features, grid.spec).where("col >= 0")
    return pieces.withColumn("tile", grid.tile(F.col("row"), F.least(F.col("col"), F.lit(grid.spec.width - 1))))


def edges_by_block(features: DataFrame, grid: BlockGrid) -> DataFrame:
    """The edges of ``features(fid, origin, geometry)`` in grid coordinates, once for each block that they may cross, with its tile.

    r0 and r1 are the edge's first and last row in the block. Blocks within a column of the edge are listed too, so
    that rounding leaves none out. What lies right of the grid belongs to the last block.
    """
    width, size = grid.spec.width, grid.size
    edges = with_rows(grid_edges(features, grid.spec), grid.spec.height)
    rows = edges.withColumn("brow", F.explode(F.sequence(F.floor(F.col("r0") / size).cast("int"), F.floor(F.col("r1") / size).cast("int"))))
    rows = rows.withColumns({"r0": F.greatest(F.col("r0"), F.col("brow") * size), "r1": F.least(F.col("r1"), F.col("brow") * size + (size - 1))})
    rows = cut_at_rows(rows, width, "r0", "r1")
    block = lambda c: F.floor(F.greatest(F.least(c, F.lit(width - 1)), F.lit(0)) / size).cast("int")
    blocks = rows.withColumn("bcol", F.explode(F.sequence(block(F.col("c0") - 1), block(F.col("c1") + 1))))
    return blocks.select("fid", "origin", "sign", "ax", "ay", "bx", "by", "slope", "r0", "r1", "brow", "bcol", grid.tile(F.col("r0"), F.col("bcol") * size).alias("tile"))


def zonal_by_blocks(features: DataFrame, grid: BlockGrid) -> DataFrame:
    """(fid, area, inside, valid, total) per feature, as ``zonal_summary`` gives them.

    Sums are differences of running sums along a row: their rounding is that of the row's
    whole sum. What is valid is ``inside`` less what is missing, so that it equals ``inside`` where nothing is.
    """
    width, size = grid.spec.width, grid.size
    # A column's own running count of cells, from the feature's first column, keeps the numbers small.
    origin = F.floor(F.array_min(F.transform(F.flatten(F.flatten("geometry")), lambda p: grid.spec.to_cell(p["x"], p["y"])[0])))
    origin = F.greatest(F.lit(0.0), F.least(origin, F.lit(float(width))))
    edges = edges_by_block(features.select("fid", origin.alias("origin"), "geometry"), grid)
    strips = grid.strips(edges).drop("tile").withColumn("brow", F.floor(F.col("row") / size).cast("int"))
    # Spark can't foresee how often features are cut, and would send the edges through the driver to every executor.
    rows = edges.drop("tile").join(strips.hint("merge"), ["brow", "bcol"]).where("row between r0 and r1")
    rows = cut_at_rows(rows, width)
    end = F.when(F.col("first") + size >= width, F.lit(width)).otherwise(F.col("first") + (size - 1))
    rows = rows.withColumns({"c0": F.greatest("c0", "first"), "c1": F.least(F.col("c1"), end)})
    # A filter here would become the join's condition, all of the above written out in it, and its code too long to be compiled.
    found = cut_at_columns(rows.withColumn("col", F.explode(F.when(F.col("c0") <= F.col("c1"), F.sequence("c0", "c1")))), width)
    at = F.col("col") - F.col("first")
    value = F.when(F.col("col") < width, F.get("values", at.cast("int")))
    before = lambda name: F.get(name, at.cast("int"))
    total = F.col("part") * F.coalesce(value, F.lit(0.0)) + F.col("cover") * before("sums")
    missing = F.when((F.col("col") < width) & value.isNull(), F.col("part")).otherwise(0.0) + F.col("cover") * before("missing")
    inside = F.col("part") + F.col("cover") * (F.col("col") - F.col("origin"))
    summed = found.groupBy("fid").agg(F.sum(inside).alias("inside"), F.sum(missing).alias("missing"), F.sum(total).alias("total"))
    # All pieces of a grid have one sign, that of its orientation.
    whole = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    joined = features.select("fid", plane_area(F.col("geometry")).alias("area")).join(summed, "fid", "left")
    joined = joined.select("fid", "area", whole("inside").alias("inside"), whole("missing").alias("missing"), whole("total").alias("total"))
    valid = F.greatest(F.col("inside") - F.col("missing"), F.lit(0.0))
    valid = F.when(valid > 1e-9, valid).otherwise(0.0)
    return joined.select("fid", "area", "inside", valid.alias("valid"), F.when(valid > 0, F.col("total")).alias("total"))
