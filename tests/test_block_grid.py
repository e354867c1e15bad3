import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellfold as cf
from cellfold.functions import geometry as G
from cellfold.operators.block_zonal import boundary_points, zonal_by_blocks
from cellfold.operators.coverage import cell_shares
from cellfold.operators.zonal import zonal_summary
from cellfold.plans.materialize import shared_folder
from cellfold.plans.queries import QUERIES
from cellfold.sources.block_grid import open_block_grid, write_block_grid
from cellfold.sources.grid import GridSpec, Raster
from cellfold.sources.layer import VectorLayer

from tests.conftest import SF


def folder(spark):
    return f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"


def grid_of(spark, spec, seed=1, gaps=0.2):
    rng = np.random.default_rng(seed)
    rows = [(r, c, None if rng.random() < gaps / 2 else float(rng.integers(0, 50))) for r in range(spec.height) for c in range(spec.width) if rng.random() > gaps / 2]
    return Raster(spec, spark.createDataFrame(rows, "row int, col int, value double"))


def layer_of(spark, shapes, crs="EPSG:3857"):
    return VectorLayer(spark.createDataFrame([(k, G.to_rows(s)) for k, s in enumerate(shapes)], f"key long, geometry {G.SCHEMA}"), crs)


def features(layer):
    return layer.frame.select(F.col("key").alias("fid"), "geometry")


def star(x, y, r, n=7):
    ring = [(x + (r if i % 2 else r / 3) * math.cos(math.pi * i / n), y + (r if i % 2 else r / 3) * math.sin(math.pi * i / n)) for i in range(2 * n)]
    return G.from_coordinates([[[*ring, ring[0]]]])


SHAPES = [
    G.box(0, 0, 23, 17), G.box(3, 4, 5, 6), G.box(3.25, 4.5, 3.75, 4.75), G.box(-9, -9, 40, 40), G.box(-5, 3.2, 2.5, 9.9), G.box(20.1, 1.3, 99, 5.5), G.box(50, 50, 60, 60),
    star(11, 8, 7.7), star(0, 0, 9), star(23, 17, 12), G.parse_wkt("POLYGON((1 1,21 2,20 16,2 15,1 1),(5 5,6 12,15 11,14 4,5 5))"), G.parse_wkt("MULTIPOLYGON(((1 1,4 1,4 4,1 1)),((9 9,22 9.5,21 16,9 9)))"),
]
SPECS = [
    GridSpec.north_up(0, 17, 1, 1, 23, 17, "EPSG:3857"),
    GridSpec(19, 14, (0.9, 0.35, 1.5, -0.35, 0.9, 3.0), "EPSG:3857"),
]


@pytest.mark.parametrize("spec", SPECS, ids=["north", "rotated"])
@pytest.mark.parametrize("size, gaps", [(4, 0.3), (7, 0.0), (64, 0.3)])
def test_equals_sums_over_cells(spark, spec, size, gaps):
    """Lookups on the boundary give what a join of every covered cell gives."""
    raster = grid_of(spark, spec, gaps=gaps)
    found = {r.fid: r for r in zonal_by_blocks(features(layer_of(spark, SHAPES)), write_block_grid(raster, folder(spark), size)).collect()}
    wanted = {r.fid: r for r in zonal_summary(features(layer_of(spark, SHAPES)), raster.masked()).collect()}
    assert found.keys() == wanted.keys()
    for k, w in wanted.items():
        f = found[k]
        assert (f.area, f.inside, f.valid) == pytest.approx((w.area, w.inside, w.valid), abs=1e-8), k
        assert (f.total is None) == (w.total is None) and (w.total is None or f.total == pytest.approx(w.total, abs=1e-6)), k


def test_assignment_is_the_same(spark):
    raster = grid_of(spark, SPECS[0])
    options = {"allow_overlaps": True, "allow_partial_coverage": True, "allow_missing_population_data": True}
    layer = layer_of(spark, [s for k, s in enumerate(SHAPES) if k != 6])
    plain, stored = cf.assign_population(layer, raster, **options), cf.assign_population(layer, write_block_grid(raster, folder(spark), 5), **options)
    rows = [{r.key: r for r in a.frame.drop("geometry").collect()} for a in (plain, stored)]
    assert plain.frame.columns == stored.frame.columns and stored.attrs["population_source"]["total"] == pytest.approx(plain.attrs["population_source"]["total"])
    for k, r in rows[0].items():
        assert [pytest.approx(v, abs=1e-7) if isinstance(v, float) else v for v in r] == list(rows[1][k])
    with pytest.raises(cf.PartialCoverageError):
        cf.assign_population(layer_of(spark, [SHAPES[6]]), write_block_grid(raster, folder(spark), 5))


def test_only_boundaries_are_looked_up(spark):
    """A box of 1,000 by 999 cells: a point on each side of each row, and the plan fills nothing in."""
    spec = GridSpec.north_up(0, 2000, 1, 1, 2000, 2000, "EPSG:3857")
    raster = Raster(spec, spark.createDataFrame([(1000, 1000, 2.0), (3, 3, 5.0)], "row int, col int, value double"))
    grid = write_block_grid(raster, folder(spark), 200, 25)
    box = features(layer_of(spark, [G.box(500.5, 500.25, 1500.5, 1499.25)]))
    points = boundary_points(box, grid)
    assert points.count() == 2 * 1000
    row = zonal_by_blocks(box, grid).first()
    assert row.total == 2.0 and row.area == pytest.approx(row.inside) and row.valid == 1.0
    plan = zonal_by_blocks(box, grid)._jdf.queryExecution().toString()
    assert plan.count("Window") == 0 and "NestedLoop" not in plan and "Python" not in plan and "dynamicpruning" in plan
    assert "Window" in cell_shares(box, spec)._jdf.queryExecution().toString()


def test_pieces_of_many_features_are_not_broadcast(spark):
    """Spark takes features of a few bytes for few pieces: only numbers of tiles may go through the driver, not edges or what they are cut into."""
    grid = write_block_grid(grid_of(spark, GridSpec.north_up(0, 64, 1, 1, 64, 64, "EPSG:3857")), folder(spark), 16, 16)
    x, y = F.col("id") % 40 + 0.3, F.floor(F.col("id") / 40) + 0.6
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (23.1, 0), (0, 21.7), (0, 0))])
    triangles = spark.range(1600).select(F.col("id").alias("fid"), F.array(F.array(ring)).alias("geometry"))
    plan = zonal_by_blocks(triangles, grid)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("LeftSemi" in line and "[tile" in line for line in joins) and "SortMergeJoin" in plan
    some = triangles.where("fid % 97 = 5")
    found, wanted = ({r.fid: (r.inside, r.valid, r.total) for r in f.collect()} for f in (zonal_by_blocks(some, grid), zonal_summary(some, grid.raster())))
    assert len(found) == 17 and found == {k: pytest.approx(v, abs=1e-6) for k, v in wanted.items()}


def files(frame):
    return {r[0].rpartition("/")[0].rpartition("tile=")[2] for r in frame.select(F.input_file_name()).distinct().collect()}


def test_only_tiles_of_a_polygon_or_window_are_opened(spark):
    grid = write_block_grid(grid_of(spark, GridSpec.north_up(0, 64, 1, 1, 64, 64, "EPSG:3857")), folder(spark), 4, 64)
    assert grid.tile_blocks == 2 and len(files(grid.strips())) == 64
    city = features(layer_of(spark, [G.box(9.5, 40.5, 12.5, 43.5)]))
    tiles = boundary_points(city, grid).select("tile")
    assert files(grid.strips(tiles)) == {str(r.tile) for r in tiles.distinct().collect()} == {"17"}
    country = boundary_points(features(layer_of(spark, [G.box(1, 1, 63, 63)])), grid).select("tile")
    assert len(files(grid.strips(country))) == 8 + 8  # those of its left and right sides only
    window = grid.window((5, 12), (16, 30))
    assert files(window) == {"2", "3", "10", "11"} and "PartitionFilters: [isnotnull" not in window._jdf.queryExecution().toString() and "tile" in window._jdf.queryExecution().executedPlan().toString()
    cells = {(r.row, r.col): r.value for r in grid.raster().cells.collect()}
    assert {(r.row, r.col): r.value for r in window.collect()} == {k: v for k, v in cells.items() if 5 <= k[0] < 12 and 16 <= k[1] < 30}
    assert grid.window((60, 99), (-7, 2)).count() == sum(r >= 60 and c < 2 for r, c in cells) and grid.window((5, 5), (0, 9)).count() == 0


def test_round_trip_and_checks(spark):
    spec = GridSpec.north_up(-5, 9, 0.5, 0.25, 11, 7, "EPSG:4326", nodata=-9.0)
    raster = Raster(spec, spark.createDataFrame([(0, 0, 1.5), (6, 10, 2.5), (3, 3, -9.0), (2, 2, float("nan")), (1, 1, None), (50, 50, 1.0)], "row int, col int, value double"))
    path = folder(spark)
    made = write_block_grid(raster, path, 3)
    again = open_block_grid(spark, path)
    assert again == made and (again.total, again.valid, again.spec) == (4.0, 2, spec)
    assert {(r.row, r.col, r.value) for r in again.raster().cells.collect()} == {(0, 0, 1.5), (6, 10, 2.5)}
    assert again.strips().count() == 7 * 4 and again.strips().where(F.size("sums") != F.size("values") + 1).count() == 0
    for bad in ([(0, 0, -1.0)], [(0, 0, float("inf"))], [(0, 0, None)]):
        with pytest.raises(ValueError):
            write_block_grid(Raster(spec, spark.createDataFrame(bad, "row int, col int, value double")), folder(spark))
    with pytest.raises(TypeError, match="vector"):
        cf.assign_population(raster, made)


def test_query_grows_with_its_tables(spark):
    small, large = (spark.read.parquet(f"{d}/lineitem.parquet").count() for d in (SF, SF.replace("0.001", "0.01")))
    assert math.ceil(math.sqrt(large) / 64) > math.ceil(math.sqrt(small) / 64)
    assert QUERIES["block_zonal_sum"](spark, SF).count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
