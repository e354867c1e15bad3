"""Registered queries of the grid operators over the driver's tables, each with plain SQL.

A grid of counts is made of ``lineitem``: cell (row, col) = (order mod 16, part mod 16),
the quantities summed; every seventh cell has no data. Polygons come from the keys
of ``nation`` and ``supplier``. The SQL uses other formulas than the operators: overlaps
of intervals on a cross join of small tables, and closed forms.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.assign import assign_population
from cellfold.catalog.selection import accepts
from cellfold.catalog.sources import SOURCES, catalog_table
from cellfold.operators.bands import band_totals, threshold_total
from cellfold.operators.coverage import cell_shares, plane_area
from cellfold.operators.cube import year_counts
from cellfold.operators.overlap import overlap_pairs
from cellfold.operators.parity import compare
from cellfold.operators.tabular import MATCH, key_report, matched
from cellfold.operators.zonal import center_sums, on_grid
from cellfold.functions.crs import KNOWN, as_crs
from cellfold.functions.exact import exact_sums
from cellfold.functions.projections import columns as column_functions
from cellfold.plans.materialize import shared_folder
from cellfold.sources.block_grid import BlockGrid, write_block_grid
from cellfold.sources.grid import GridSpec, Raster, cell_centers
from cellfold.sources.layer import VectorLayer, from_boxes, from_wkt
from cellfold.sources.order import with_position
from cellfold.sources.tiles import read_tiles, write_tiles

SIDE = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order."""
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


# ---------------------------------------------------------------------- inputs
def counts(spark: SparkSession, sf_dir: str, holes: bool = True, crs: str = "EPSG:3857", left: float = 0.0, top: float = 16.0, cell: tuple[float, float] = (1.0, 1.0)) -> Raster:
    """The grid of counts. Its no-data cells are null."""
    sums = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value"))
    if holes:
        sums = sums.withColumn("value", F.when((F.col("row") * SIDE + F.col("col")) % 7 != 0, F.col("value")))
    return Raster(GridSpec.north_up(left, top, *cell, SIDE, SIDE, crs), sums)


def ones(spark: SparkSession, spec: GridSpec) -> Raster:
    cells = spark.range(spec.width * spec.height)
    return Raster(spec, cells.select(F.floor(F.col("id") / spec.width).cast("int").alias("row"), (F.col("id") % spec.width).cast("int").alias("col"), F.lit(1.0).alias("value")))


def hazard_values(spark: SparkSession, sf_dir: str) -> Raster:
    """A grid of hazard values between 0.75 and 9.75, from counts of events."""
    by = [(F.col("user_id") % SIDE).cast("int").alias("row"), (F.col("event_id") % SIDE).cast("int").alias("col")]
    cells = table(spark, sf_dir, "events").groupBy(*by).agg((F.count("*") % 10 + 0.75).alias("value"))
    return Raster(GridSpec.north_up(0, 16, 1, 1, SIDE, SIDE, "EPSG:3857"), cells)


def nation_boxes(spark: SparkSession, sf_dir: str, dx: float = 0.0) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 3 + 0.25 + dx, F.floor(k / 5) * 3 + 0.5
    return table(spark, sf_dir, "nation").select(k.alias("key"), x0.alias("x0"), y0.alias("y0"), (x0 + 1.5 + (k % 3) * 0.5).alias("x1"), (y0 + 2.25).alias("y1"))


def boxes(spark: SparkSession, sf_dir: str, dx: float = 0.0, crs: str = "EPSG:3857") -> VectorLayer:
    layer = from_boxes(nation_boxes(spark, sf_dir, dx), "x0", "y0", "x1", "y1", crs)
    return VectorLayer(layer.frame.select("key", "geometry"), crs)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, geometry, a, b): right triangles with legs 2.5 and 1.75, from supplier keys."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("fid"), ((k * 37 % 130) / 10 + 0.03).alias("a"), ((k * 53 % 137) / 10 + 0.07).alias("b"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.col("a"), F.col("b")), point(F.col("a") + 2.5, F.col("b")), point(F.col("a"), F.col("b") + 1.75), point(F.col("a"), F.col("b")))
    return rows.withColumn("geometry", F.array(F.array(ring)))


#: The inputs above in SQL. Row r of the grid lies between y = 15 - r and 16 - r.
GRID = f"""grid AS (SELECT (l_orderkey % {SIDE})::INT AS r, (l_partkey % {SIDE})::INT AS c, sum(l_quantity) AS v0,
  CASE WHEN ((l_orderkey % {SIDE}) * {SIDE} + l_partkey % {SIDE}) % 7 <> 0 THEN sum(l_quantity) END AS v FROM lineitem GROUP BY l_orderkey % {SIDE}, l_partkey % {SIDE})"""
BOXES = """boxes AS (SELECT n_nationkey AS key, (n_nationkey % 5) * 3 + 0.25::DOUBLE + {dx} AS x0, (n_nationkey // 5) * 3 + 0.5::DOUBLE AS y0,
  (n_nationkey % 5) * 3 + 0.25::DOUBLE + {dx} + 1.5 + (n_nationkey % 3) * 0.5 AS x1, (n_nationkey // 5) * 3 + 2.75::DOUBLE AS y1 FROM nation)"""
#: Share of cell (r, c) in a box.
OVERLAP = "(greatest(0, least(x1, c + 1) - greatest(x0, c)) * greatest(0, least(y1, 16 - r) - greatest(y0, 15 - r)))"
TRIANGLES = "tri AS (SELECT s_suppkey AS key, (s_suppkey * 37 % 130)::DOUBLE / 10 + 0.03 AS a, (s_suppkey * 53 % 137)::DOUBLE / 10 + 0.07 AS b FROM supplier)"


# --------------------------------------------------------------------- queries
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    hazard = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    hazard = hazard.select(F.col("o_orderkey").alias("cell"), "o_orderpriority", "o_totalprice")
    return assign_population(hazard, lines.groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("population")), cell_columns="cell")


EXACT = "exact AS (SELECT o_orderkey AS cell, o_orderpriority, o_totalprice, q AS population FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def tabular_exact_join(spark, sf_dir):
    return rounded(_exact(spark, sf_dir))


def tabular_threshold_sum(spark, sf_dir):
    return rounded(threshold_total(_exact(spark, sf_dir), 200_000.0, "o_totalprice"))


def tabular_input_order(spark, sf_dir):
    """The exact join with each order's position in its file, kept through all shuffles."""
    lines = table(spark, sf_dir, "lineitem")
    hazard = with_position(table(spark, sf_dir, "orders")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    hazard = hazard.select(F.col("o_orderkey").alias("cell"), "position")
    return rounded(assign_population(hazard, lines.groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("population")), cell_columns="cell").orderBy("position"))


def tabular_group_sum(spark, sf_dir):
    return rounded(_exact(spark, sf_dir).groupBy("o_orderpriority").agg(F.sum("population").alias("population")))


def exact_totals(spark, sf_dir):
    """Sums of doubles to the last bit, without rounding: any partitioning gives the same."""
    lines = table(spark, sf_dir, "lineitem")
    return exact_sums(lines, ["l_returnflag", "l_linestatus"], price="l_extendedprice", revenue=F.col("l_extendedprice") * (1 - F.col("l_discount")))


def tabular_composite_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    by = [(F.col("l_suppkey") % 50).alias("grid_x"), (F.col("l_partkey") % 40).alias("grid_y")]
    hazard = lines.groupBy(*by).agg(F.sum("l_extendedprice").alias("loss"))
    people = lines.groupBy(*by).agg(F.sum("l_quantity").alias("people"))
    return rounded(assign_population(hazard, people, cell_columns=["grid_x", "grid_y"], population_column="people"), 2)


def tabular_unmatched_report(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    people = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("population"))
    return matched(customers, people, ["c_custkey"], "population").agg(F.count_if(F.col(MATCH).isNull()).alias("unmatched"))


def key_quality_report(spark, sf_dir):
    return key_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.col("missing").cast("long").alias("missing"), F.col("repeated").cast("long").alias("repeated"))


def cell_center_table(spark, sf_dir):
    return cell_centers(counts(spark, sf_dir))


def _target(cell: float, n: int, left: float = 0.0, top: float = 16.0) -> GridSpec:
    return GridSpec.north_up(left, top, cell, cell, n, n, "EPSG:3857")


def _aligned(spark, sf_dir, spec: GridSpec, **options):
    return assign_population(ones(spark, spec), counts(spark, sf_dir), **options)


def raster_same_grid(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir, _target(1, 16)).cells)


def raster_fractional_regrid(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir, _target(0.64, 25)).cells)


def raster_cross_crs(spark, sf_dir):
    """Counts in degrees, spread over a hazard grid in metres: cells are projected, not resampled."""
    people = counts(spark, sf_dir, crs="EPSG:4326", left=10.0, top=60.0, cell=(1.5, 2.0))
    found = assign_population(ones(spark, _target(180_000.0, 30, 1_000_000.0, 8_500_000.0)), people, allow_reprojection=True, allow_partial_coverage=True)
    return rounded(found.cells.where("population is not null").select("row", "col", "population"), 4)


def raster_coarsen(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir, _target(4, 4)).cells)


def raster_masked_cells(spark, sf_dir):
    """A hazard grid that reaches outside the counts: outside cells are null."""
    return rounded(_aligned(spark, sf_dir, _target(1, 20), allow_partial_coverage=True).cells)


def raster_conservation(spark, sf_dir):
    a = _aligned(spark, sf_dir, _target(0.64, 25)).attrs
    return spark.createDataFrame([(round(a["population_source_total"], 3), round(a["population_covered_total"], 3), round(a["population_aligned_total"], 3))], "source double, covered double, aligned double")


def raster_data_support(spark, sf_dir):
    a = _aligned(spark, sf_dir, _target(1, 20), allow_partial_coverage=True).attrs
    return spark.createDataFrame([(round(a["population_coverage_fraction"], 9), round(a["population_data_fraction"], 9), a["population_data_complete"])], "coverage double, data double, complete boolean")


def raster_block_totals(spark, sf_dir):
    result = _aligned(spark, sf_dir, GridSpec.north_up(0, 16, 1, 1, 16, 16, "EPSG:3857", block_shape=(4, 8)))
    return rounded(result.block_totals())


def raster_window_read(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir, _target(1, 16)).window((2, 9), (3, 12)))


def band_exposure(spark, sf_dir):
    return rounded(band_totals(assign_population(hazard_values(spark, sf_dir), counts(spark, sf_dir), allow_missing_population_data=True).cells))


def zonal_box_sum(spark, sf_dir):
    return rounded(assign_population(boxes(spark, sf_dir), counts(spark, sf_dir, holes=False)).frame.drop("geometry"))


def zonal_data_support(spark, sf_dir):
    return rounded(assign_population(boxes(spark, sf_dir), counts(spark, sf_dir)).frame.drop("geometry"))


def zonal_partial_coverage(spark, sf_dir):
    """Boxes moved beyond the grid's right edge; plane shares are reported beside the totals."""
    layer = boxes(spark, sf_dir, 2.9)
    result = assign_population(VectorLayer(layer.frame, "EPSG:4326"), counts(spark, sf_dir, crs="EPSG:4326"), allow_partial_coverage=True).frame
    return rounded(result.select("key", "population", "population_data_fraction", "population_coverage_complete"))


def zonal_missing_null(spark, sf_dir):
    """Rows 0 to 6 have no data: features wholly there get null."""
    raster = counts(spark, sf_dir, holes=False)
    raster = Raster(raster.spec, raster.cells.withColumn("value", F.when(F.col("row") > 6, F.col("value"))))
    return rounded(assign_population(boxes(spark, sf_dir), raster, allow_missing_population_data=True).frame.drop("geometry"))


def zonal_triangle_sum(spark, sf_dir):
    layer = VectorLayer(triangles(spark, sf_dir).select(F.col("fid").alias("key"), "geometry"), "EPSG:3857")
    return rounded(assign_population(layer, counts(spark, sf_dir, holes=False), allow_overlaps=True).frame.drop("geometry"))


def zonal_hole_multipart(spark, sf_dir):
    """A box with a hole, and a second part, from text; shifted by nation key."""
    k, f = F.col("n_nationkey"), lambda v: F.format_string("%.4f", v)
    at = lambda x, y: F.concat_ws(" ", f(k * 0.17 + x), f(k * 0.11 + y))
    ring = lambda x0, y0, x1, y1: F.concat(F.lit("("), F.concat_ws(",", at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)), F.lit(")"))
    text = F.concat(F.lit("MULTIPOLYGON(("), ring(0.2, 0.3, 5.2, 6.3), F.lit(","), ring(1.1, 1.6, 3.4, 4.9), F.lit("),("), ring(6.1, 2.2, 8.3, 9.4), F.lit("))"))
    layer = from_wkt(table(spark, sf_dir, "nation").select(k.alias("key"), text.alias("wkt")), "wkt", "EPSG:3857")
    return rounded(assign_population(VectorLayer(layer.frame.drop("wkt"), "EPSG:3857"), counts(spark, sf_dir), allow_overlaps=True).frame.drop("geometry"))


def zonal_cell_center(spark, sf_dir):
    return rounded(center_sums(triangles(spark, sf_dir), counts(spark, sf_dir, holes=False)).withColumnRenamed("fid", "key"))


# ------------------------------------------------- grids that grow with the tables
def wide_counts(spark: SparkSession, sf_dir: str) -> Raster:
    """A grid whose side grows with the square root of ``lineitem``'s rows; every ninth cell has no data."""
    lines = table(spark, sf_dir, "lineitem")
    side = 16 * math.ceil(math.sqrt(lines.count()) / 64)
    by = [(F.col("l_orderkey") % side).cast("int").alias("row"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % side).cast("int").alias("col")]
    cells = lines.groupBy(*by).agg(F.sum("l_quantity").alias("value")).where((F.col("row") * 5 + F.col("col")) % 9 != 0)
    return Raster(GridSpec.north_up(0, side, 1, 1, side, side, "EPSG:3857"), cells)


def stored_counts(spark: SparkSession, sf_dir: str) -> BlockGrid:
    return write_block_grid(wide_counts(spark, sf_dir), f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}", size=16, tiles=16)


def wide_triangles(spark: SparkSession, sf_dir: str, side: int) -> VectorLayer:
    """Right triangles from supplier keys, with legs of 0.15 and 0.1 of the grid's side."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("key"), ((k * 37 % 131) / 131.0 * 0.84 * side).alias("a"), ((k * 53 % 137) / 137.0 * 0.89 * side).alias("b"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.col("a"), F.col("b")), point(F.col("a") + 0.15 * side, F.col("b")), point(F.col("a"), F.col("b") + 0.1 * side), point(F.col("a"), F.col("b")))
    return VectorLayer(rows.select("key", F.array(F.array(ring)).alias("geometry")), "EPSG:3857")


def block_zonal_sum(spark, sf_dir):
    """Triangles over a grid stored by block: lookups of running sums on the triangles' boundaries."""
    grid = stored_counts(spark, sf_dir)
    layer = wide_triangles(spark, sf_dir, grid.spec.width)
    return rounded(assign_population(layer, grid, allow_overlaps=True, allow_missing_population_data=True).frame.drop("geometry"))


def block_window_read(spark, sf_dir):
    """A window of a grid stored by block: only its tiles are opened."""
    grid = stored_counts(spark, sf_dir)
    side = grid.spec.width
    return rounded(grid.window((side // 4, side // 2), (side // 8, side // 2 + 3)))


def tile_window_read(spark, sf_dir):
    """A window of a folder of GeoTIFF tiles, by filters that reach the tiles."""
    raster = wide_counts(spark, sf_dir)
    folder, side = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}", raster.spec.width
    write_tiles(raster, folder, size=16)
    cells = read_tiles(spark, folder).masked().cells
    return rounded(cells.where(F.col("row").between(side // 4, side // 2 - 1) & F.col("col").between(side // 8, side // 2 + 2)))


def tile_regrid_window(spark, sf_dir):
    """A window of counts aligned to a hazard grid of half the cell size; hazard and counts are tiles."""
    raster = wide_counts(spark, sf_dir)
    folder, side = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}", raster.spec.width
    write_tiles(raster, folder, size=16)
    hazard = Raster(GridSpec.north_up(0, side, 0.5, 0.5, 2 * side, 2 * side, "EPSG:3857"), ones(spark, GridSpec.north_up(0, side, 0.5, 0.5, 2 * side, 2 * side, "EPSG:3857")).cells)
    write_tiles(hazard, f"{folder}/hazard", size=32)
    found = assign_population(read_tiles(spark, f"{folder}/hazard"), read_tiles(spark, folder))
    return rounded(found.window((side // 2, side), (7, side // 2)))


def cell_coverage_shares(spark, sf_dir):
    return rounded(cell_shares(triangles(spark, sf_dir), _target(1, 16)).withColumnRenamed("fid", "key"), 9)


def surface_coverage(spark, sf_dir):
    """Boxes of degrees that reach outside the grid: shares of surface area."""
    layer = boxes(spark, sf_dir, 0.0, "EPSG:4326")
    spec = GridSpec.north_up(0, 14, 1, 1, 13, 13, "EPSG:4326")
    found = assign_population(layer, ones(spark, spec), allow_partial_coverage=True).frame
    return rounded(found.select("key", "population_coverage_fraction", "population_coverage_complete"), 7)


def antimeridian_split(spark, sf_dir):
    """Boxes of 20 degrees across the seam, as wrapped rings, over a world grid of counts."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("key"), (F.lit(170.0) + k * 0.1).alias("x0"), (F.lit(-170.0) + k * 0.1).alias("x1"), (k * 1.5 - 40).alias("y0"), (k * 1.5 - 33).alias("y1"))
    layer = from_boxes(rows, "x0", "y0", "x1", "y1", "EPSG:4326")
    world = counts(spark, sf_dir, False, "EPSG:4326", -180.0, 80.0, (22.5, 10.0))
    found = assign_population(VectorLayer(layer.frame.select("key", "geometry"), "EPSG:4326"), world, antimeridian="split", allow_overlaps=True)
    return rounded(found.frame.drop("geometry"), 5)


def overlap_report(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("fid"), ((k * 37 % 997) / 10).alias("x0"), ((k * 53 % 991) / 10).alias("y0"), (1 + k % 7 * 1.25).alias("w"), (0.5 + k % 5 * 2.75).alias("h"))
    layer = from_boxes(rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}), "x0", "y0", "x1", "y1", "EPSG:3857")
    return rounded(overlap_pairs(layer.frame.select("fid", "geometry")), 6)


def _projected_area(spark, sf_dir, crs: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("key"), (k * 2.0 - 30).alias("x0"), (k * 2.0 - 18).alias("x1"), (k * 1.1 - 20).alias("y0"), (k * 1.1 - 11).alias("y1"))
    layer = from_boxes(rows, "x0", "y0", "x1", "y1", "EPSG:4326")
    spec = GridSpec.north_up(0, 0, 10, 10, 1, 1, crs)
    moved = on_grid(layer.frame.select(F.col("key").alias("fid"), "geometry"), KNOWN["EPSG:4326"], spec, "error", True)
    # Boundaries follow the curves within a tenth of a cell, here 1 m of about 1,000 km.
    return moved.select(F.col("fid").alias("key"), F.round(plane_area(F.col("geometry")) / 1e10, 2).alias("area"))


def reproject_mercator_box(spark, sf_dir):
    return _projected_area(spark, sf_dir, "EPSG:3857")


def reproject_mollweide_area(spark, sf_dir):
    return _projected_area(spark, sf_dir, "ESRI:54009")


def _cube(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 18).cast("int").alias("lat_idx"), (F.col("event_id") % 36).cast("int").alias("lon_idx"), (F.col("event_id") % 14).cast("int").alias("age"), (F.lit(1950) + F.col("event_id") % 3).cast("int").alias("year"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))


def cube_year_total(spark, sf_dir):
    return rounded(year_counts(_cube(spark, sf_dir), 1951, 18, 36))


def fine_coarse_parity(spark, sf_dir):
    """Block sums of the counts against a coarse grid of the same quantities, summed apart."""
    coarse = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") % SIDE / 4).cast("int").alias("row"), F.floor(F.col("l_partkey") % SIDE / 4).cast("int").alias("col")).agg((F.sum("l_quantity") + F.max("l_quantity") / 10).alias("value"))
    found = compare(counts(spark, sf_dir, holes=False), Raster(_target(4, 4), coarse))
    return rounded(found.select("row", "col", "fine", "coarse", "same"), 4)


def catalog_list(spark, sf_dir):
    return catalog_table(spark).select("source_id", "first_year", "last_year", "n_years", "crs", "width", "height", "meaning")


def catalog_selection_check(spark, sf_dir):
    """Whether a selection is accepted, for those made of every source and nation key."""

    @F.pandas_udf("boolean")
    def known(selections: pd.Series) -> pd.Series:
        return selections.map(accepts)

    names = F.explode(F.array(*[F.lit(s) for s in SOURCES]))
    rows = table(spark, sf_dir, "nation").select((F.lit(1996) + F.col("n_nationkey")).cast("string").alias("year"), names.alias("source_id"))
    return rows.select(F.concat_ws(":", "source_id", "year").alias("selection")).withColumn("known", known("selection"))


def utm_coordinates(spark, sf_dir):
    """Coordinates in UTM 33N of points from supplier keys, as column expressions, and back to degrees."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("key"), (13.0 + (k * 37 % 401) / 100.0).alias("lon"), (40.0 + (k * 53 % 1999) / 100.0).alias("lat"))
    utm, m = as_crs("EPSG:32633").projection, column_functions()
    x, y = utm.forward(F.col("lon"), F.col("lat"), m)
    lon, lat = utm.inverse(F.col("x"), F.col("y"), m)
    back = points.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat})
    return back.select("key", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("lon2", 9).alias("lon"), F.round("lat2", 9).alias("lat"))


def stream_static_assignment(spark, sf_dir):
    """Events as a stream, assigned to counts by user; the rows written are read back."""
    from cellfold.streaming.assign import append_to, assign_stream

    static = table(spark, sf_dir, "events")
    schema = static.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.abs("c_acctbal") + 1).alias("population"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = append_to(assign_stream(stream.select("event_id", "user_id", "event_type"), people, "user_id"), f"{folder}/rows", f"{folder}/checkpoint")
    query.awaitTermination()
    found = spark.read.parquet(f"{folder}/rows")
    return rounded(found.groupBy("event_type").agg(F.count("*").alias("events"), F.count("population").alias("matched"), F.sum("population").alias("population")), 3)


QUERIES = {
    f.__name__: f
    for f in (
        tabular_exact_join, tabular_threshold_sum, tabular_input_order, tabular_group_sum, tabular_composite_key, exact_totals, tabular_unmatched_report, key_quality_report, cell_center_table,
        raster_same_grid, raster_fractional_regrid, raster_cross_crs, raster_coarsen, raster_masked_cells, raster_conservation, raster_data_support, raster_block_totals, raster_window_read, band_exposure,
        zonal_box_sum, zonal_data_support, zonal_partial_coverage, zonal_missing_null, zonal_triangle_sum, zonal_hole_multipart, zonal_cell_center, block_zonal_sum, block_window_read, tile_window_read, tile_regrid_window, cell_coverage_shares,
        surface_coverage, antimeridian_split, overlap_report, reproject_mercator_box, reproject_mollweide_area, cube_year_total, fine_coarse_parity, utm_coordinates, catalog_list, catalog_selection_check, stream_static_assignment,
    )
}


def _regrid_sql(n: int, cell: str, hazard: str = "1.0") -> str:
    return f"""WITH {GRID}, t AS (SELECT a.i::INT AS tr, b.i::INT AS tc FROM range({n}) a(i), range({n}) b(i)),
s AS (SELECT tr, tc, sum(v * greatest(0, least(c + 1, (tc + 1) * {cell}) - greatest(c, tc * {cell})) * greatest(0, least(r + 1, (tr + 1) * {cell}) - greatest(r, tr * {cell}))) AS p
  FROM t, grid WHERE v IS NOT NULL AND c < (tc + 1) * {cell} - 1e-12 AND c + 1 > tc * {cell} + 1e-12 AND r < (tr + 1) * {cell} - 1e-12 AND r + 1 > tr * {cell} + 1e-12 GROUP BY 1, 2)
SELECT tr AS row, tc AS col, {hazard}::DOUBLE AS hazard, round(p, 6) AS population FROM t LEFT JOIN s USING (tr, tc)"""


def _zonal_sql(value: str, dx: str = "0", extra: str = "") -> str:
    return f"""WITH {GRID}, {BOXES.format(dx=dx)},
z AS (SELECT key, any_value((x1 - x0) * (y1 - y0)) AS area, sum({OVERLAP} * {value}) AS p, sum(CASE WHEN {value} IS NOT NULL THEN {OVERLAP} END) AS valid FROM boxes, grid WHERE {OVERLAP} > 0 GROUP BY key)
SELECT key, round(p, 6) AS population, CASE WHEN valid >= area - 1e-9 THEN 1.0::DOUBLE ELSE round(coalesce(valid, 0) / area, 6) END AS population_data_fraction, coalesce(valid >= area - 1e-9, false) AS population_data_complete FROM z{extra}"""


_S = "(0.5 * 6356752.314245179 * 6356752.314245179 * (sin({p}) / (1 - 0.0066943799901413165 * sin({p}) ** 2) + 0.5 * ln((1 + 0.08181919084262149 * sin({p})) / (1 - 0.08181919084262149 * sin({p}))) / 0.08181919084262149))"


def _surface(x0: str, x1: str, y0: str, y1: str) -> str:
    return f"((radians({x1}) - radians({x0})) * ({_S.format(p=f'radians({y1})')} - {_S.format(p=f'radians({y0})')}))"


#: The grid of ``wide_counts``, with its side g, and the triangles over it. Row r lies between y = g - 1 - r and g - r.
WIDE = """side AS (SELECT (16 * ceil(sqrt(count(*)::DOUBLE) / 64))::BIGINT AS g FROM lineitem),
wide AS (SELECT (l_orderkey % g)::INT AS r, ((l_partkey * 7 + l_linenumber) % g)::INT AS c, any_value(g) AS g, sum(l_quantity) AS v FROM lineitem, side GROUP BY 1, 2 HAVING (r * 5 + c) % 9 <> 0)"""
WIDE_TRIANGLES = "tri AS (SELECT s_suppkey AS key, g, (s_suppkey * 37 % 131)::DOUBLE / 131.0::DOUBLE * 0.84::DOUBLE * g AS a, (s_suppkey * 53 % 137)::DOUBLE / 137.0::DOUBLE * 0.89::DOUBLE * g AS b, 0.15::DOUBLE * g AS p, 0.1::DOUBLE * g AS q FROM supplier, side)"
_CORNER = "(p * q / 2 * greatest(0, 1 - greatest({u}, 0) / p - greatest({v}, 0) / q) ** 2)"
_WIDE_SHARE = f"({_CORNER.format(u='c - a', v='g - 1 - r - b')} - {_CORNER.format(u='c + 1 - a', v='g - 1 - r - b')} - {_CORNER.format(u='c - a', v='g - r - b')} + {_CORNER.format(u='c + 1 - a', v='g - r - b')})"
_TRI = "(2.5 * 1.75 / 2 * greatest(0, 1 - greatest({u}, 0) / 2.5 - greatest({v}, 0) / 1.75) ** 2)"
_TRI_CELL = f"({_TRI.format(u='c - a', v='15 - r - b')} - {_TRI.format(u='c + 1 - a', v='15 - r - b')} - {_TRI.format(u='c - a', v='16 - r - b')} + {_TRI.format(u='c + 1 - a', v='16 - r - b')})"


def _shifted(x0: float, y0: float, x1: float, y1: float) -> str:
    a, b = "round(n_nationkey * 0.17 + {}, 4)", "round(n_nationkey * 0.11 + {}, 4)"
    x0, x1, y0, y1 = a.format(x0), a.format(x1), b.format(y0), b.format(y1)
    return f"(greatest(0, least({x1}, c + 1) - greatest({x0}, c)) * greatest(0, least({y1}, 16 - r) - greatest({y0}, 15 - r)))"


_HOLED = f"({_shifted(0.2, 0.3, 5.2, 6.3)} - {_shifted(1.1, 1.6, 3.4, 4.9)} + {_shifted(6.1, 2.2, 8.3, 9.4)})"
_HOLED_AREA = f"{5.0 * 6.0 - 2.3 * 3.3 + 2.2 * 7.2!r}"

ORACLES = {
    "tabular_exact_join": f"WITH {EXACT} SELECT cell, o_orderpriority, round(o_totalprice, 6) AS o_totalprice, round(population, 6) AS population FROM exact",
    "tabular_threshold_sum": f"WITH {EXACT} SELECT round(sum(population), 6) AS population FROM exact WHERE o_totalprice >= 200000",
    "tabular_input_order": "WITH o AS (SELECT o_orderkey, row_number() OVER () - 1 AS position FROM orders) SELECT o_orderkey AS cell, position, round(q, 6) AS population FROM o JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "tabular_group_sum": f"WITH {EXACT} SELECT o_orderpriority, round(sum(population), 6) AS population FROM exact GROUP BY 1",
    "exact_totals": """WITH n AS (SELECT l_returnflag, l_linestatus, sum((l_extendedprice * 4503599627370496.0::DOUBLE)::HUGEINT) AS p, sum((l_extendedprice * (1 - l_discount) * 4503599627370496.0::DOUBLE)::HUGEINT) AS r FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_returnflag, l_linestatus, name, n, (SELECT max(1::HUGEINT << k::INT) FROM range(0, 60) t(k) WHERE k = 0 OR n // (1::HUGEINT << k::INT) >= 4503599627370496) AS u FROM (SELECT l_returnflag, l_linestatus, unnest(['p', 'r']) AS name, unnest([p, r]) AS n FROM n)),
d AS (SELECT l_returnflag, l_linestatus, name, (n // u + CASE WHEN n % u * 2 > u OR (n % u * 2 = u AND n // u % 2 = 1) THEN 1 ELSE 0 END)::BIGINT::DOUBLE * u::DOUBLE / 4503599627370496.0::DOUBLE AS s FROM u)
SELECT l_returnflag, l_linestatus, max(s) FILTER (name = 'p') AS price, max(s) FILTER (name = 'r') AS revenue FROM d GROUP BY 1, 2""",
    "tabular_composite_key": "SELECT l_suppkey % 50 AS grid_x, l_partkey % 40 AS grid_y, round(sum(l_extendedprice), 2) AS loss, round(sum(l_quantity), 2) AS people FROM lineitem GROUP BY 1, 2",
    "tabular_unmatched_report": "SELECT count(*) AS unmatched FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "key_quality_report": "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS missing, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated",
    "cell_center_table": f"WITH {GRID} SELECT c + 0.5::DOUBLE AS longitude, 15.5::DOUBLE - r AS latitude, v AS population FROM grid WHERE v IS NOT NULL",
    "raster_same_grid": f"WITH {GRID} SELECT r AS row, c AS col, 1.0::DOUBLE AS hazard, round(v, 6) AS population FROM grid",
    "raster_fractional_regrid": _regrid_sql(25, "0.64::DOUBLE"),
    "raster_cross_crs": f"""WITH {GRID}, p AS (
  SELECT v, 6378137.0::DOUBLE * radians(10 + 1.5 * c) AS x0, 6378137.0::DOUBLE * radians(11.5 + 1.5 * c) AS x1,
    6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(58 - 2 * r) / 2)) AS y0, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(60 - 2 * r) / 2)) AS y1 FROM grid WHERE v IS NOT NULL),
t AS (SELECT a.i::INT AS row, b.i::INT AS col, 1e6::DOUBLE + b.i * 180000 AS l, 8.5e6::DOUBLE - a.i * 180000 AS u FROM range(30) a(i), range(30) b(i)),
s AS (SELECT row, col, v, greatest(0, least(x1, l + 180000) - greatest(x0, l)) / (x1 - x0) * greatest(0, least(y1, u) - greatest(y0, u - 180000)) / (y1 - y0) AS share FROM t, p)
SELECT row, col, round(sum(v * share), 4) AS population FROM s WHERE share > 0 GROUP BY row, col""",
    "raster_coarsen": f"WITH {GRID} SELECT (r // 4)::INT AS row, (c // 4)::INT AS col, 1.0::DOUBLE AS hazard, round(sum(v), 6) AS population FROM grid GROUP BY r // 4, c // 4",
    "raster_masked_cells": f"WITH {GRID}, t AS (SELECT a.i::INT AS r, b.i::INT AS c FROM range(20) a(i), range(20) b(i)) SELECT t.r AS row, t.c AS col, 1.0::DOUBLE AS hazard, round(v, 6) AS population FROM t LEFT JOIN grid ON t.r = grid.r AND t.c = grid.c",
    "raster_conservation": f"WITH {GRID} SELECT round(sum(v), 3) AS source, round(sum(v), 3) AS covered, round(sum(v), 3) AS aligned FROM grid",
    "raster_data_support": f"WITH {GRID} SELECT round(256.0::DOUBLE / 400, 9) AS coverage, round(count(v)::DOUBLE / 400, 9) AS data, false AS complete FROM grid",
    "raster_block_totals": f"WITH {GRID} SELECT (r // 4)::INT AS block_row, (c // 8)::INT AS block_col, count(v) AS cells, round(sum(v), 6) AS population FROM grid GROUP BY r // 4, c // 8",
    "raster_window_read": f"WITH {GRID} SELECT r AS row, c AS col, 1.0::DOUBLE AS hazard, round(v, 6) AS population FROM grid WHERE r BETWEEN 2 AND 8 AND c BETWEEN 3 AND 11",
    "band_exposure": f"WITH {GRID}, h AS (SELECT user_id % 16 AS r, event_id % 16 AS c, count(*) % 10 AS k FROM events GROUP BY 1, 2), b AS (SELECT i::INT AS band FROM range(1, 11) t(i)), s AS (SELECT (k + 1)::INT AS band, sum(v) AS p FROM h JOIN grid USING (r, c) WHERE v IS NOT NULL GROUP BY 1) SELECT band, round(coalesce(p, 0), 6) AS population FROM b LEFT JOIN s USING (band)",
    "zonal_box_sum": _zonal_sql("v0"),
    "zonal_data_support": _zonal_sql("v"),
    "zonal_partial_coverage": f"WITH {GRID}, {BOXES.format(dx='2.9::DOUBLE')}, z AS (SELECT key, any_value((x1 - x0) * (y1 - y0)) AS area, any_value(x1) AS x1, sum({OVERLAP} * v) AS p, sum(CASE WHEN v IS NOT NULL THEN {OVERLAP} END) AS valid FROM boxes, grid WHERE {OVERLAP} > 0 GROUP BY key) SELECT key, round(p, 6) AS population, round(CASE WHEN valid >= area - 1e-9 THEN 1 ELSE coalesce(valid, 0) / area END, 6)::DOUBLE AS population_data_fraction, x1 <= 16 AS population_coverage_complete FROM z",
    "zonal_missing_null": _zonal_sql("(CASE WHEN r > 6 THEN v0 END)"),
    "zonal_triangle_sum": f"WITH {GRID}, {TRIANGLES} SELECT key, round(sum(v0 * {_TRI_CELL}), 6) AS population, 1.0::DOUBLE AS population_data_fraction, true AS population_data_complete FROM tri, grid GROUP BY key",
    "zonal_hole_multipart": f"WITH {GRID}, z AS (SELECT n_nationkey AS key, sum({_HOLED} * v) AS p, sum(CASE WHEN v IS NOT NULL THEN {_HOLED} END) AS valid FROM nation, grid WHERE {_HOLED} > 0 GROUP BY 1) SELECT key, round(p, 6) AS population, round(valid / {_HOLED_AREA}, 6) AS population_data_fraction, false AS population_data_complete FROM z",
    "zonal_cell_center": f"WITH {GRID}, {TRIANGLES} SELECT key, round(sum(v0), 6) AS total FROM tri, grid WHERE c + 0.5 > a AND 15.5 - r > b AND (c + 0.5 - a) / 2.5 + (15.5 - r - b) / 1.75 < 1 GROUP BY key",
    "block_zonal_sum": f"""WITH {WIDE}, {WIDE_TRIANGLES}, near AS (SELECT key, tri.a, tri.b, p, q, tri.g, r, c, v FROM tri JOIN wide ON c BETWEEN floor(a) AND a + p AND tri.g - r BETWEEN b AND b + q + 1),
s AS (SELECT key, any_value(p * q / 2) AS area, sum({_WIDE_SHARE} * v) AS total, sum({_WIDE_SHARE}) AS valid FROM near GROUP BY key)
SELECT key, round(total, 6) AS population, CASE WHEN area - valid <= 1e-9 THEN 1.0::DOUBLE ELSE round(valid / area, 6) END AS population_data_fraction, area - valid <= 1e-9 AS population_data_complete FROM s""",
    "block_window_read": f"WITH {WIDE} SELECT r AS row, c AS col, round(v, 6) AS value FROM wide WHERE r >= g // 4 AND r < g // 2 AND c >= g // 8 AND c < g // 2 + 3",
    "tile_window_read": f"WITH {WIDE} SELECT r AS row, c AS col, round(v, 6) AS value FROM wide WHERE r >= g // 4 AND r < g // 2 AND c >= g // 8 AND c < g // 2 + 3",
    "tile_regrid_window": f"""WITH {WIDE}, t AS (SELECT a.i::INT AS row, b.i::INT AS col FROM side, range(g // 2, g) a(i), range(7, g // 2) b(i))
SELECT row, col, 1.0::DOUBLE AS hazard, round(v / 4, 6) AS population FROM t LEFT JOIN wide ON r = row // 2 AND c = col // 2""",
    "cell_coverage_shares": f"WITH {TRIANGLES}, g AS (SELECT a.i::INT AS r, b.i::INT AS c FROM range(16) a(i), range(16) b(i)) SELECT key, r AS row, c AS col, round({_TRI_CELL}, 9) AS share FROM tri, g WHERE {_TRI_CELL} > 1e-12",
    "surface_coverage": f"WITH {BOXES.format(dx='0')} SELECT key, CASE WHEN x1 <= 13 AND y0 >= 1 AND y1 <= 14 THEN 1.0::DOUBLE ELSE round({_surface('x0', 'least(x1, 13)', 'greatest(y0, 1)', 'least(y1, 14)')} / {_surface('x0', 'x1', 'y0', 'y1')}, 7) END AS population_coverage_fraction, x1 <= 13 AND y0 >= 1 AND y1 <= 14 AS population_coverage_complete FROM boxes",
    "antimeridian_split": f"WITH {GRID}, b AS (SELECT n_nationkey AS key, 170.0::DOUBLE + n_nationkey * 0.1 AS x0, 190.0::DOUBLE + n_nationkey * 0.1 AS x1, n_nationkey * 1.5::DOUBLE - 40 AS y0, n_nationkey * 1.5::DOUBLE - 33 AS y1 FROM nation), p AS (SELECT key, x0, 180.0::DOUBLE AS x1, y0, y1 FROM b UNION ALL SELECT key, -180.0, x1 - 360, y0, y1 FROM b) SELECT key, round(sum(v0 * greatest(0, least(x1, -180 + (c + 1) * 22.5) - greatest(x0, -180 + c * 22.5)) / 22.5 * greatest(0, least(y1, 80 - r * 10) - greatest(y0, 70 - r * 10)) / 10), 5) AS population, 1.0::DOUBLE AS population_data_fraction, true AS population_data_complete FROM p, grid GROUP BY key",
    "overlap_report": "WITH b AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 997)::DOUBLE / 10 AS x0, (s_suppkey * 53 % 991)::DOUBLE / 10 AS y0, 1 + s_suppkey % 7 * 1.25::DOUBLE AS w, 0.5 + s_suppkey % 5 * 2.75::DOUBLE AS h FROM supplier), p AS (SELECT p.k AS \"left\", q.k AS \"right\", (least(p.x0 + p.w, q.x0 + q.w) - greatest(p.x0, q.x0)) AS dx, (least(p.y0 + p.h, q.y0 + q.h) - greatest(p.y0, q.y0)) AS dy FROM b p JOIN b q ON p.k < q.k) SELECT \"left\", \"right\", round(dx * dy, 6) AS shared FROM p WHERE dx > 1e-9 AND dy > 1e-9",
    "reproject_mercator_box": "SELECT n_nationkey AS key, round(6378137.0::DOUBLE ** 2 * radians(12) * (ln(tan(pi() / 4 + radians(n_nationkey * 1.1 - 11) / 2)) - ln(tan(pi() / 4 + radians(n_nationkey * 1.1 - 20) / 2))) / 1e10, 2) AS area FROM nation",
    "reproject_mollweide_area": "SELECT n_nationkey AS key, round(6378137.0::DOUBLE ** 2 * radians(12) * (sin(radians(n_nationkey * 1.1 - 11)) - sin(radians(n_nationkey * 1.1 - 20))) / 1e10, 2) AS area FROM nation",
    "cube_year_total": "SELECT (user_id % 18)::INT AS row, ((event_id % 36 + 18) % 36)::INT AS col, round(sum(CASE WHEN event_id % 11 <> 0 THEN value END), 6) AS value FROM events WHERE event_id % 3 = 1 GROUP BY user_id % 18, event_id % 36",
    "fine_coarse_parity": "SELECT (l_orderkey % 16 // 4)::INT AS row, (l_partkey % 16 // 4)::INT AS col, round(sum(l_quantity), 4) AS fine, round(sum(l_quantity) + max(l_quantity) / 10, 4) AS coarse, max(l_quantity) / 10 <= 1 AS same FROM lineitem GROUP BY l_orderkey % 16 // 4, l_partkey % 16 // 4",
    "catalog_list": "SELECT * FROM (VALUES ('worldpop-global-1km', 2000, 2020, 21, 'EPSG:4326', 43200, 18720, 'residential'), ('ghsl-r2023a-mollweide-1km', 1975, 2020, 10, 'ESRI:54009', 36082, 18000, 'residential'), ('gpwv4-r11-count', 2000, 2020, 5, 'EPSG:4326', 43200, 21600, 'residential'), ('chambers-hybrid', 1950, 2020, 71, 'EPSG:4326', 1440, 720, 'residential'), ('landscan-global', 2000, 2024, 25, 'EPSG:4326', 43200, 21600, 'ambient')) t(source_id, first_year, last_year, n_years, crs, width, height, meaning)",
    "catalog_selection_check": "WITH s(id, a, b, step) AS (VALUES ('worldpop-global-1km', 2000, 2020, 1), ('ghsl-r2023a-mollweide-1km', 1975, 2020, 5), ('gpwv4-r11-count', 2000, 2020, 5), ('chambers-hybrid', 1950, 2020, 1), ('landscan-global', 2000, 2024, 1)) SELECT id || ':' || (1996 + n_nationkey)::VARCHAR AS selection, 1996 + n_nationkey BETWEEN a AND b AND (1996 + n_nationkey - a) % step = 0 AS known FROM nation, s",
    # Snyder's series in powers of the longitude's difference, not Krüger's.
    "utm_coordinates": """WITH c AS (SELECT 6378137.0::DOUBLE AS a, 0.0066943799901413165::DOUBLE AS e2, 0.9996::DOUBLE AS k0),
p AS (SELECT s_suppkey AS key, 13.0::DOUBLE + (s_suppkey * 37 % 401)::DOUBLE / 100.0::DOUBLE AS lon, 40.0::DOUBLE + (s_suppkey * 53 % 1999)::DOUBLE / 100.0::DOUBLE AS lat FROM supplier),
s AS (SELECT key, lon, lat, a, e2, k0, e2 / (1 - e2) AS ep2, radians(lat) AS f, a / sqrt(1 - e2 * sin(radians(lat)) ** 2) AS n, tan(radians(lat)) ** 2 AS t, e2 / (1 - e2) * cos(radians(lat)) ** 2 AS cc, radians(lon - 15) * cos(radians(lat)) AS d,
  a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384) * radians(lat) - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024 + 420 * e2 ** 4 / 16384) * sin(2 * radians(lat)) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024 + 525 * e2 ** 4 / 16384) * sin(4 * radians(lat)) - (35 * e2 ** 3 / 3072 + 175 * e2 ** 4 / 12288) * sin(6 * radians(lat)) + 315 * e2 ** 4 / 131072 * sin(8 * radians(lat))) AS mm FROM p, c)
SELECT key, round(500000 + k0 * n * (d + (1 - t + cc) * d ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * cc - 58 * ep2) * d ** 5 / 120), 1) AS x,
  round(k0 * (mm + n * tan(f) * (d ** 2 / 2 + (5 - t + 9 * cc + 4 * cc ** 2) * d ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * cc - 330 * ep2) * d ** 6 / 720)), 1) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM s""",
    "stream_static_assignment": "SELECT event_type, count(*) AS events, count(c_custkey) AS matched, round(sum(abs(c_acctbal) + 1), 3) AS population FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1",
}
