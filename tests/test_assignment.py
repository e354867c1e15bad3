import math

import pytest

from cellfold import CrsMismatchError, GridSpec, MissingPopulationDataError, PartialCoverageError, Raster, VectorLayer, assign_population
from cellfold.functions import geometry as G
from cellfold.operators.bands import band_totals


@pytest.fixture(scope="module")
def make(spark):
    class Make:
        def grid(self, values, left=0.0, top=None, w=1.0, h=1.0, crs="EPSG:3857", **more):
            rows = [(r, c, None if v is None else float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
            return Raster(GridSpec.north_up(left, len(values) if top is None else top, w, h, len(values[0]), len(values), crs, **more), spark.createDataFrame(rows, "row int, col int, value double"))

        def layer(self, *shapes, crs="EPSG:3857"):
            return VectorLayer.of(spark, [(i, s) for i, s in enumerate(shapes)], "n long", crs)

        def rows(self, result):
            return [tuple(v for k, v in r.asDict().items() if k not in ("n", "geometry")) for r in result.frame.orderBy("n").collect()]

    return Make()


BASIC = [[1, 2], [3, 4]]
HOLE = [[None, 2], [3, 4]]


# ------------------------------------------------------------------------ tables
def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


HAZARD, PEOPLE = "longitude double, latitude double, severity string", "longitude double, latitude double, population double, unused string"


def test_table(spark):
    hazard = table(spark, [(12.0, 20.0, "warning"), (10.0, 20.0, None), (11.0, 20.0, "watch")], HAZARD)
    people = table(spark, [(10.0, 20.0, 100.0, "u"), (11.0, 20.0, 200.25, "u"), (12.0, 20.0, 300.5, "u"), (13.0, 20.0, 999.0, "u")], PEOPLE)
    found = assign_population(hazard, people)
    assert found.columns == ["longitude", "latitude", "severity", "population"]
    assert {r.longitude: r.population for r in found.collect()} == {12.0: 300.5, 10.0: 100.0, 11.0: 200.25}
    assert assign_population(hazard.limit(0), people).collect() == []


def test_table_keys_of_other_types(spark):
    hazard = table(spark, [(1, 2, "a`b"), (3, 4, None)], "grid_x int, grid_y int, `odd name` string")
    people = table(spark, [(3, 4, 7), (1, 2, 5)], "grid_x long, grid_y int, people int")
    found = assign_population(hazard, people, cell_columns=["grid_x", "grid_y"], population_column="people")
    assert sorted((r.grid_x, r.people) for r in found.collect()) == [(1, 5.0), (3, 7.0)] and found.schema["people"].dataType.simpleString() == "double"


NAN, INF = float("nan"), math.inf


@pytest.mark.parametrize(
    "hazard,people,options,error",
    [
        ([(1.0, "x")], [(1.0, 5.0)], {"cell_columns": ()}, "at least one"),
        ([(1.0, "x")], [(1.0, 5.0)], {"cell_columns": ["k", "k"]}, "twice"),
        ([(1.0, "x")], [(1.0, 5.0)], {"cell_columns": "absent"}, "hazard lacks"),
        ([(1.0, "x")], [(1.0, 5.0)], {"population_column": "k"}, "cell column"),
        ([(1.0, "x")], [(1.0, 5.0)], {"population_column": "note"}, "population lacks"),
        ([(None, "x")], [(1.0, 5.0)], {}, "hazard has missing"),
        ([(NAN, "x")], [(1.0, 5.0)], {}, "hazard has missing"),
        ([(1.0, "x")], [(None, 5.0)], {}, "population has missing"),
        ([(1.0, "x"), (1.0, "y")], [(1.0, 5.0)], {}, "hazard has duplicate"),
        ([(1.0, "x")], [(1.0, 5.0), (2.0, 1.0), (2.0, 3.0)], {}, "population has duplicate"),
        ([(1.0, "x")], [(1.0, 5.0), (2.0, NAN)], {}, "finite"),
        ([(1.0, "x")], [(1.0, 5.0), (2.0, INF)], {}, "finite"),
        ([(1.0, "x")], [(1.0, 5.0), (2.0, None)], {}, "finite"),
        ([(1.0, "x")], [(1.0, -5.0)], {}, "non-negative"),
        ([(1.0, "x"), (1.0 + 1e-12, "y")], [(1.0, 5.0)], {}, "1 hazard row did not"),
        ([(3.0, "x"), (2.0, "y")], [(1.0, 5.0)], {}, "2 hazard rows did not"),
        ([(1.0, "x")], [(1.0, 5.0)], {"allow_reprojection": True}, "for vector and raster hazards"),
        ([(1.0, "x")], [(1.0, 5.0)], {"allow_partial_coverage": True}, "for vector and raster hazards"),
        ([(1.0, "x")], [(1.0, 5.0)], {"allow_overlaps": True}, "for vector hazards"),
        ([(1.0, "x")], [(1.0, 5.0)], {"antimeridian": "split"}, "for vector hazards"),
        ([(1.0, "x")], [(1.0, 5.0)], {"hazard_band": 1}, "for raster hazards"),
    ],
)
def test_table_errors(spark, hazard, people, options, error):
    with pytest.raises(ValueError, match=error):
        assign_population(table(spark, hazard, "k double, note string"), table(spark, people, "k double, population double"), **{"cell_columns": "k", **options})


def test_table_value_types(spark):
    hazard = table(spark, [(1, "x")], "k int, note string")
    for kind, value in (("string", "5"), ("boolean", True)):
        with pytest.raises(ValueError, match="numeric"):
            assign_population(hazard, table(spark, [(1, value)], f"k int, population {kind}"), cell_columns="k")
    with pytest.raises(ValueError, match="types"):
        assign_population(hazard, table(spark, [("1", 5.0)], "k string, population double"), cell_columns="k")
    with pytest.raises(ValueError, match="already has"):
        assign_population(hazard.withColumnRenamed("note", "population"), table(spark, [(1, 5.0)], "k int, population double"), cell_columns="k")


@pytest.mark.parametrize("options,error", [({"allow_overlaps": 1}, TypeError), ({"hazard_band": True}, TypeError), ({"hazard_band": "1"}, TypeError), ({"antimeridian": "wrap"}, ValueError), ({"population_column": ""}, ValueError), ({"conservation_tolerance": -1}, ValueError), ({"conservation_tolerance": True}, ValueError), ({"conservation_tolerance": INF}, ValueError)])
def test_options(spark, options, error):
    with pytest.raises(error):
        assign_population(table(spark, [(1,)], "k int"), table(spark, [(1, 5.0)], "k int, population double"), cell_columns="k", **options)


def test_kinds_must_fit(spark, make):
    people = table(spark, [(1, 5.0)], "k int, population double")
    for hazard in (make.layer(G.box(0, 0, 1, 1)), make.grid(BASIC)):
        with pytest.raises(TypeError):
            assign_population(hazard, people)
    with pytest.raises(TypeError):
        assign_population(people, make.grid(BASIC))
    with pytest.raises(TypeError):
        assign_population(5, people)
    with pytest.raises(ValueError, match="no hazard file"):
        assign_population("/nowhere.tif", make.grid(BASIC))


# ---------------------------------------------------------------------- polygons
@pytest.mark.parametrize(
    "values,shapes,expected",
    [
        (BASIC, [G.box(0, 0, 1.5, 2), G.box(1.5, 0, 2, 2)], [(7.0, 1.0, True), (3.0, 1.0, True)]),
        ([[1, 2, 3], [4, 5, 6], [7, 8, 9]], [G.box(0.5, 0.5, 2.5, 2.5)], [(20.0, 1.0, True)]),
        (BASIC, [G.box(0.25, 0.25, 1.75, 1.75)], [(5.625, 1.0, True)]),
        (HOLE, [G.box(0, 0, 2, 2)], [(9.0, 0.75, False)]),
        ([[0, 0], [3, 4]], [G.box(0, 1, 2, 2)], [(0.0, 1.0, True)]),
        (BASIC, ["POLYGON ((0 0, 2 0, 0 2, 0 0))"], [(0.5 * 1 + 3 + 0.5 * 4, 1.0, True)]),
        (BASIC, ["MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1.5 0.5, 1.5 1.5, 0.5 1.5, 0.5 0.5)))"], [(7.5, 1.0, True)]),
    ],
)
def test_polygons(make, values, shapes, expected):
    found = make.rows(assign_population(make.layer(*shapes), make.grid(values)))
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in found] == expected


def test_one_hole_in_many_is_not_complete(make):
    values = [[1.0] * 64 for _ in range(64)]
    values[0][0] = None
    ((people, fraction, complete),) = make.rows(assign_population(make.layer(G.box(0, 0, 64, 64)), make.grid(values)))
    assert (people, complete) == (4095.0, False) and fraction == pytest.approx(1 - 1 / 4096, abs=1e-12) and fraction < 1


def test_partial_coverage(make):
    with pytest.raises(PartialCoverageError, match="reaches outside"):
        assign_population(make.layer(G.box(1, 0, 3, 2)), make.grid(HOLE))
    ((people, data, data_complete, coverage, complete),) = make.rows(assign_population(make.layer(G.box(1, 0, 3, 2)), make.grid(HOLE), allow_partial_coverage=True))
    assert (people, data, data_complete, complete) == (6.0, 0.5, False, False) and coverage == pytest.approx(0.5)
    rows = make.rows(assign_population(make.layer(G.box(0, 0, 1, 1), G.box(2, 2, 6, 4), G.box(3.8, 0, 13.8, 1)), make.grid([[1] * 4] * 4), allow_partial_coverage=True))
    assert [r[0] for r in rows] == pytest.approx([1.0, 4.0, 0.2]) and [r[3] for r in rows] == pytest.approx([1.0, 0.5, 0.02]) and [r[4] for r in rows] == [True, False, False]
    with pytest.raises(PartialCoverageError, match="entirely outside"):
        assign_population(make.layer(G.box(9, 9, 10, 10)), make.grid(BASIC), allow_partial_coverage=True)


def test_missing_data(make):
    layer = make.layer(G.box(0, 1, 1, 2), G.box(1, 0, 2, 1))
    with pytest.raises(MissingPopulationDataError, match="1 hazard feature has"):
        assign_population(layer, make.grid(HOLE))
    assert make.rows(assign_population(layer, make.grid(HOLE), allow_missing_population_data=True)) == [(None, 0.0, False), (4.0, 1.0, True)]


def test_overlaps(make):
    layer = make.layer(G.box(0, 0, 2, 2), G.box(1, 0, 2, 2))
    with pytest.raises(ValueError, match="overlapping polygons at rows 0 and 1"):
        assign_population(layer, make.grid(BASIC))
    with pytest.raises(ValueError, match="overlapping polygons at rows 0 and 1"):
        assign_population(layer, make.grid(BASIC), row_id="n")
    assert [r[0] for r in make.rows(assign_population(layer, make.grid(BASIC), allow_overlaps=True))] == [10.0, 6.0]
    touching = make.layer(G.box(0, 0, 1, 2), G.box(1, 0, 2, 2), "POLYGON ((0 0, 1 0, 0 0.0000001, 0 0))")
    with pytest.raises(ValueError, match="overlapping"):
        assign_population(touching, make.grid(BASIC))


def test_antimeridian(make):
    wrapped = G.from_coordinates([[[(170, -10), (-170, -10), (-170, 10), (170, 10)]]])
    with pytest.raises(ValueError, match="antimeridian"):
        assign_population(make.layer(wrapped, crs="EPSG:4326"), make.grid([[1] * 4] * 2, -180, 10, 90, 10, "EPSG:4326"))
    for left in (-180.0, 0.0):
        found = make.rows(assign_population(make.layer(wrapped, crs="EPSG:4326"), make.grid([[1] * 4] * 2, left, 10, 90, 10, "EPSG:4326"), antimeridian="split"))
        assert found[0][0] == pytest.approx(8 * 20 / 360)
    grads = G.from_coordinates([[[(190, -10), (-190, -10), (-190, 10), (190, 10)]]])
    found = make.rows(assign_population(make.layer(grads, crs="EPSG:4807"), make.grid([[1] * 4] * 2, -200, 10, 100, 10, "EPSG:4807"), antimeridian="split"))
    assert found[0][0] == pytest.approx(8 * 20 / 400)
    with pytest.raises(ValueError, match="geographic"):
        assign_population(make.layer(G.box(0, 0, 1, 1)), make.grid(BASIC), antimeridian="split")


def test_reprojection(make):
    from cellfold.functions.crs import KNOWN, forward

    (left, right), _ = forward(KNOWN["EPSG:3857"], [0, 2], [0, 0])
    _, (bottom, top) = forward(KNOWN["EPSG:3857"], [0, 0], [-1, 1])
    grid = make.grid(BASIC, left, top, (right - left) / 2, (top - bottom) / 2)
    layer = make.layer(G.box(0, -1, 1, 1), G.box(1, -1, 2, 1), crs="EPSG:4326")
    with pytest.raises(CrsMismatchError):
        assign_population(layer, grid)
    assert [r[0] for r in make.rows(assign_population(layer, grid, allow_reprojection=True))] == pytest.approx([4.0, 6.0])


def test_mollweide_box(make):
    a, n = 6378137.0, 60
    x = a * 2 * math.sqrt(2) / math.pi * math.radians(21)
    y = a * math.sqrt(2) * math.sin(0.2925)
    grid = make.grid([[1.0] * n] * n, -x, y, 2 * x / n, 2 * y / n, "ESRI:54009")
    box = make.layer(G.box(-20, -20, 20, 20), crs="EPSG:4326")
    ((people, _, _),) = make.rows(assign_population(box, grid, allow_reprojection=True))
    exact = a * a * 2 * math.radians(20) * 2 * math.sin(math.radians(20)) / grid.spec.cell_area
    assert people == pytest.approx(exact, rel=2e-3)  # boundaries may deviate by a tenth of a cell


@pytest.mark.parametrize("shape,error", [(None, "missing"), ([], "empty"), ("POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", "invalid"), ("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))", "invalid")])
def test_bad_geometry(make, shape, error):
    with pytest.raises(ValueError, match=error):
        assign_population(make.layer(shape, G.box(0, 0, 1, 1)), make.grid(BASIC))


def test_layer_checks(spark, make):
    with pytest.raises(ValueError, match="CRS"):
        assign_population(make.layer(G.box(0, 0, 1, 1), crs=None), make.grid(BASIC))
    with pytest.raises(ValueError, match="itself"):
        assign_population(make.layer(G.box(0, 0, 1, 1)), make.grid(BASIC), population_column="population_data_fraction")
    with pytest.raises(ValueError, match="already has"):
        assign_population(make.layer(G.box(0, 0, 1, 1)), make.grid(BASIC), population_column="n")
    with pytest.raises(ValueError, match="at least one polygon"):
        assign_population(VectorLayer(make.layer(G.box(0, 0, 1, 1)).frame.limit(0), "EPSG:3857"), make.grid(BASIC))
    with pytest.raises(ValueError, match="LineString|Linestring"):
        G.parse_wkt("LINESTRING (0 0, 1 1)")


# ------------------------------------------------------------------------ rasters
def test_raster_same_grid(make):
    result = assign_population(make.grid([[10, 20], [30, 40]]), make.grid(BASIC))
    hazard, people = result.read()
    assert people.tolist() == BASIC and hazard.tolist() == [[10, 20], [30, 40]]
    assert [result.attrs[k] for k in ("population_source_total", "population_covered_total", "population_aligned_total", "population_relative_difference")] == [10, 10, 10, 0]


def test_raster_fractions_and_masks(make):
    assert assign_population(make.grid([[1] * 3] * 2, 0, 2, 0.5, 1), make.grid(BASIC)).attrs["population_aligned_total"] == 7.0
    with pytest.raises(PartialCoverageError):
        assign_population(make.grid([[10, 20, 30], [40, 50, 60]]), make.grid(HOLE))
    result = assign_population(make.grid([[10, 20, 30], [40, 50, 60]]), make.grid(HOLE), allow_partial_coverage=True)
    assert result.read()[1].tolist() == [[None, 2.0, None], [3.0, 4.0, None]]
    assert result.attrs["population_coverage_fraction"] == pytest.approx(2 / 3) and result.attrs["population_data_fraction"] == 0.5
    half = assign_population(make.grid([[1]], 0, 1, 2, 1), make.grid([[5, None]]))
    assert half.read()[1].tolist() == [[5.0]] and half.attrs["population_data_fraction"] == 0.5
    with pytest.raises(PartialCoverageError, match="entirely outside"):
        assign_population(make.grid(BASIC, 10, 12), make.grid(BASIC))
    with pytest.raises(MissingPopulationDataError):
        assign_population(make.grid([[1, 1]], 0, 1), make.grid([[None, None, 5]], 0, 1))


def test_raster_bands_of_shaking(make):
    people = make.grid([[10 * r + c + 1 for c in range(10)] for r in range(4)], 0, 2, 0.5, 0.5, "EPSG:4326")
    hazard = make.grid([[0.5, 1.5, 2.5, 3.5, 4.5], [5.5, 6.5, 7.5, 8.5, 9.5]], 0, 2, 1, 1, "EPSG:4326")
    result = assign_population(hazard, people)
    assert [r.population for r in band_totals(result.cells).orderBy("band").collect()] == [26, 34, 42, 50, 58, 106, 114, 122, 130, 138]
    with pytest.raises(Exception, match="outside the bands"):
        band_totals(assign_population(make.grid([[0.4, 1], [1, 1]]), make.grid(BASIC)).cells).collect()


def test_raster_reprojected(spark, make):
    source = make.grid([[11, 17], [29, 43]], 9.5, 52.5, 0.5, 0.5, "EPSG:4326")
    spec = GridSpec(3, 2, (80000 / 3, 0, 4280000, 0, -60000, 3270000), "EPSG:3035")
    target = Raster(spec, spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(3)], "row int, col int, value double"))
    with pytest.raises(CrsMismatchError):
        assign_population(target, source)
    people = assign_population(target, source, allow_reprojection=True, allow_partial_coverage=True).read()[1]
    golden = [[6.401646559479, 10.760132396940, 10.888750310061], [16.943197525947, 27.393784907209, 27.612488300363]]
    assert abs(people - golden).max() < 0.02


def test_rotated_grid(spark, make):
    spec = GridSpec(2, 2, (1.0, 1.0, 0.0, 1.0, -1.0, 2.0), "EPSG:3857")
    raster = Raster(spec, make.grid(BASIC).cells)
    whole = make.rows(assign_population(make.layer(spec.footprint), raster))
    assert whole[0][0] == pytest.approx(10.0) and whole[0][2]
    aligned = assign_population(make.grid([[1] * 4] * 4, 0, 4, 1, 1), raster, allow_partial_coverage=True)
    assert aligned.attrs["population_aligned_total"] == pytest.approx(10.0)


def test_bands_and_blocks(spark, make):
    two = Raster(GridSpec.north_up(0, 2, 1, 1, 2, 2, "EPSG:3857", bands=2), spark.createDataFrame([(b, r, c, float(10 * b + r)) for b in (1, 2) for r in range(2) for c in range(2)], "band int, row int, col int, value double"))
    with pytest.raises(ValueError, match="several bands"):
        assign_population(two, make.grid(BASIC))
    with pytest.raises(ValueError, match="between 1 and 2"):
        assign_population(two, make.grid(BASIC), hazard_band=3)
    assert assign_population(two, make.grid(BASIC), hazard_band=2).read()[0].tolist() == [[20, 20], [21, 21]]
    ones = make.grid([[1.0] * 300] * 300)
    result = assign_population(ones, ones)
    assert [w for w in result.windows()] == [((0, 256), (0, 256)), ((0, 256), (256, 300)), ((256, 300), (0, 256)), ((256, 300), (256, 300))]
    assert {(r.block_row, r.block_col): r.population for r in result.block_totals().collect()} == {(0, 0): 65536, (0, 1): 11264, (1, 0): 11264, (1, 1): 1936}


@pytest.mark.parametrize(
    "values,more,error",
    [
        (BASIC, {"crs": None}, "CRS"),
        ([[1, -2]], {}, "non-negative"),
        ([[1, INF]], {}, "finite"),
        ([[None, None]], {}, "at least one valid"),
        (BASIC, {"nodata": INF}, "nodata"),
        (BASIC, {"bands": 2}, "one count band"),
        (BASIC, {"tags": {"units": "people per square km"}}, "density"),
        (BASIC, {"tags": {"Population_Semantics": "density"}}, "semantics"),
        (BASIC, {"unit": "persons/km2"}, "density"),
    ],
)
def test_bad_counts(make, values, more, error):
    with pytest.raises(ValueError, match=error):
        assign_population(make.layer(G.box(0, 0, 0.5, 0.5)), make.grid(values, **more))


def test_bad_grids(spark, make):
    for transform in ((1, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 0), (1, 0, INF, 0, -1, 0), (-1, 0, 0, 0, -1, 0), (1, 0, 0, 0, 1, 5)):
        with pytest.raises(ValueError):
            GridSpec(2, 2, transform, "EPSG:3857").validate("population")


def test_nodata_values_are_masked(make):
    assert make.rows(assign_population(make.layer(G.box(0, 0, 2, 2)), make.grid([[-9999, 2], [NAN, 4]], nodata=-9999.0))) == [(6.0, 0.5, False)]


def test_conservation(make):
    from cellfold.operators.regrid import conservation_tolerance

    assert (conservation_tolerance(None, False), conservation_tolerance(None, True), conservation_tolerance(0.5, True)) == (1e-6, 1e-3, 0.5)


def test_row_ids_tell_rows_apart(spark, make):
    people = make.grid(BASIC)
    boxes = [G.box(0, 0, 1, 1), G.box(1, 1, 2, 2), G.box(0, 1, 1, 2)]
    layer = lambda *ids: VectorLayer.of(spark, list(zip(ids, boxes[: len(ids)])), "n long", "EPSG:3857")
    for row_id, ids, error in (("n", (1, 1), "must be unique; 1 values repeat, such as 1"), ("n", (1, None), "null in 1 rows"), ("n", (None, None, 1), "null in 2 rows"), ("m", (1, 2), "no column 'm'")):
        with pytest.raises(ValueError, match=error):
            assign_population(layer(*ids), people, row_id=row_id)
    assert {r.n: r.population for r in assign_population(layer(7, 3, 5), people, row_id="n").frame.collect()} == {7: 3.0, 3: 2.0, 5: 1.0}
    assert sorted(r.population for r in assign_population(layer(1, 1), people).frame.collect()) == [2.0, 3.0]  # without row_id rows are numbered
