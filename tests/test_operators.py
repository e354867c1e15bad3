import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellfold.functions import geometry as G
from cellfold.operators.bands import threshold_total
from cellfold.operators.cube import year_counts
from cellfold.operators.overlap import overlap_pairs
from cellfold.operators.parity import compare, nesting
from cellfold.plans.queries import ORACLES, QUERIES
from cellfold.sources.grid import GridSpec, Raster
from cellfold.sources.layer import from_boxes

from tests.conftest import SF, comparable


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert comparable(QUERIES[name](spark, SF).toPandas()) == comparable(duck.sql(ORACLES[name]).df())


def test_contract(spark):
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


def test_no_nested_loops(spark):
    for name in ("zonal_triangle_sum", "raster_fractional_regrid", "overlap_report", "tabular_exact_join"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_overlaps_of_very_different_sizes(spark):
    shapes = {0: G.box(0, 0, 1000, 1000), 1: G.box(10, 10, 10.001, 10.001), 2: G.box(999.9, 0, 1001, 1), 3: G.box(1001, 0, 1002, 1), 4: G.box(-5, -5, 0, 0), 5: G.box(10.0005, 10, 10.002, 10.001)}
    frame = spark.createDataFrame([(k, G.to_rows(v)) for k, v in shapes.items()], f"fid long, geometry {G.SCHEMA}")
    found = {(r.left, r.right): r.shared for r in overlap_pairs(frame).collect()}
    want = {(i, j): G.overlap_area(shapes[i], shapes[j]) for i in shapes for j in shapes if i < j}
    assert found == {k: pytest.approx(v) for k, v in want.items() if v > 0}
    assert overlap_pairs(frame.limit(0)).count() == 0


def test_dense_boxes_take_one_join(spark):
    """Many pairs in few tiles, on their borders and of several sizes: each pair once, without a broadcast, comparing pairs or cutting edges."""
    k = F.col("id")
    corner = spark.range(700).select(k.alias("fid"), (k * 37 % 41 - 20).cast("double").alias("x0"), (k * 53 % 29 / 2 - 7).alias("y0"), (1 + k % 7 * 1.25).alias("w"), (0.5 + k % 5 * 2.75).alias("h"))
    frame = from_boxes(corner.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}), "x0", "y0", "x1", "y1", "EPSG:3857").frame.select("fid", "geometry")
    pairs = overlap_pairs(frame)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and not any(word in plan for word in ("Broadcast", "Aggregate", "NestedLoop"))
    rows = {r.fid: (r.x0, r.y0, r.x0 + r.w, r.y0 + r.h) for r in corner.collect()}
    shared = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    want = {(i, j): v for i in rows for j in rows if i < j and (v := shared(rows[i], rows[j])) > 0}
    found = [(r.left, r.right, r.shared) for r in pairs.collect()]
    assert len(found) == len(want) > 10_000 and {r[:2]: r[2] for r in found} == want


def test_shared_areas_of_rough_shapes(spark):
    """Stars, holes, many parts, touching and nested shapes, and sizes from 1 to 10^4: areas as by slabs; no Python in the plan."""
    import math

    def star(x, y, r, n, turn=0.0):
        ring = [(x + (r if i % 2 else r * 0.4) * math.cos(math.pi * i / n + turn), y + (r if i % 2 else r * 0.4) * math.sin(math.pi * i / n + turn)) for i in range(2 * n)]
        return G.from_coordinates([[[*ring, ring[0]]]])

    holed = G.parse_wkt("POLYGON((0 0,40 1,38 35,2 33,0 0),(5 5,6 30,35 28,33 6,5 5))")
    shapes = dict(enumerate([star(20, 20, 18, 9), star(22, 19, 18, 40, 0.3), holed, G.box(7, 7, 30, 25), G.box(30, 7, 31, 25), G.box(-5000, -5000, 5000, 5000), star(0, 0, 4000, 400), star(10, 10, 0.5, 5), G.parse_wkt("MULTIPOLYGON(((1 1,4 1,4 4,1 1)),((9 9,30 9.5,29 31,9 9)))"), G.box(5000, 0, 5001, 1), holed]))
    frame = spark.createDataFrame([(k, G.to_rows(v)) for k, v in shapes.items()], f"fid long, geometry {G.SCHEMA}")
    pairs = overlap_pairs(frame)
    found = {(r.left, r.right): r.shared for r in pairs.collect()}
    want = {(i, j): G.overlap_area(shapes[i], shapes[j]) for i in shapes for j in shapes if i < j}
    want = {k: v for k, v in want.items() if v > 1e-12 * min(G.area(shapes[i]) for i in k)}
    assert found.keys() == want.keys() and len(want) > 25
    assert all(found[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "NestedLoop", "Cartesian"))


def test_cube_roll_and_nulls(spark):
    rows = [(0, lon, age, 2000, float(age) if lon != 3 else None) for lon in range(8) for age in range(3)] + [(0, 4, 9, 2000, float("nan")), (0, 0, 0, 1999, 50.0)]
    found = {r.col: r.value for r in year_counts(spark.createDataFrame(rows, "lat_idx int, lon_idx int, age int, year int, value double"), 2000, 1, 8).collect()}
    assert found == {c: (None if c == 7 else 3.0) for c in range(8)}


def test_parity(spark):
    fine = GridSpec.north_up(-2, 2, 1, 1, 4, 4, "EPSG:4326")
    coarse = GridSpec.north_up(-2, 2, 2, 2, 2, 2, "EPSG:4326")
    cells = spark.range(16).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), (F.col("id") + 1.0).alias("value"))
    published = spark.createDataFrame([(0, 0, 14.0), (0, 1, 22.0), (1, 0, 46.0), (1, 1, 60.0)], "row int, col int, value double")
    rows = {(r.row, r.col): (r.fine, r.same) for r in compare(Raster(fine, cells), Raster(coarse, published)).collect()}
    assert rows == {(0, 0): (14.0, True), (0, 1): (22.0, True), (1, 0): (46.0, True), (1, 1): (54.0, False)}
    assert nesting(fine, coarse) == 2
    for bad in (GridSpec.north_up(-1, 2, 2, 2, 2, 2, "EPSG:4326"), GridSpec.north_up(-2, 2, 1.5, 2, 2, 2, "EPSG:4326"), GridSpec.north_up(-2, 2, 2, 2, 1, 2, "EPSG:4326"), GridSpec.north_up(-2, 2, 2, 2, 2, 2, "EPSG:3857")):
        with pytest.raises(ValueError):
            nesting(fine, bad)


def test_threshold(spark):
    cells = spark.createDataFrame([(5.5, 2.0), (5.4, 8.0), (None, 1.0), (6.0, None)], "hazard double, population double")
    assert threshold_total(cells, 5.5).first()[0] == 2.0
