import math
import random

import pytest
from pyspark.sql import functions as F

import cellfold as cf
from cellfold.functions import geometry as G
from cellfold.operators.validity import invalid_features, is_simple, numbered_edges
from cellfold.sources.grid import GridSpec, Raster
from cellfold.sources.layer import VectorLayer


def rings(*parts):
    return G.from_coordinates([list(part) for part in parts])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
#: Shapes and whether they are valid.
SHAPES = [
    (rings([SQUARE]), True), (rings([SQUARE[::-1]]), True), (rings([[(0, 0), (4, 0), (0, 3), (0, 0)]]), True), (rings([[(0, 0), (4, 0), (8, 0), (0, 0)]]), False),
    (rings([[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]), False), (rings([[(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0)]]), False),
    (rings([SQUARE, box(2, 2, 4, 4)]), True), (rings([SQUARE, box(0, 2, 4, 4)]), False), (rings([SQUARE, [(0, 5), (4, 4), (4, 6), (0, 5)]]), True), (rings([SQUARE, box(12, 2, 14, 4)]), False), (rings([SQUARE, box(8, 8, 12, 12)]), False),
    (rings([SQUARE, box(2, 2, 4, 4), box(5, 5, 7, 7)]), True), (rings([SQUARE, box(2, 2, 8, 8), box(3, 3, 4, 4)]), False), (rings([SQUARE, box(3, 3, 4, 4), box(2, 2, 8, 8)]), False), (rings([SQUARE, box(2, 2, 5, 5), box(4, 4, 7, 7)]), False),
    (rings([SQUARE], [box(20, 0, 30, 10)]), True), (rings([SQUARE], [box(10, 0, 20, 10)]), False), (rings([SQUARE], [[(10, 10), (20, 10), (20, 20), (10, 10)]]), True), (rings([SQUARE], [box(2, 2, 4, 4)]), False), (rings([box(2, 2, 4, 4)], [SQUARE]), False),
    (rings([SQUARE, box(2, 2, 8, 8)], [box(3, 3, 7, 7)]), True), (rings([SQUARE, box(2, 2, 8, 8)], [box(3, 3, 9, 7)]), False), (rings([SQUARE], [SQUARE]), False), (rings([SQUARE, box(2, 2, 8, 8)], [box(2, 2, 8, 8)]), False), (rings([SQUARE], [box(5, 5, 15, 15)]), False),
    (rings([[(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5), (0, 0)]]), True), (rings([[(0, 0), (6, 0), (6, 3), (0, 3), (0, 0)]], [[(6, 1), (9, 0), (9, 3), (6, 1)]]), True),
]


def frame(spark, shapes):
    return spark.createDataFrame([(k, G.to_rows(s) if not isinstance(s, list) or not s or not isinstance(s[0], dict) else s) for k, s in enumerate(shapes)], f"fid long, geometry {G.SCHEMA}")


def star(rng, n, cross=False):
    ring = [((5 + 4 * rng.random()) * math.cos(2 * math.pi * i / n), (5 + 4 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    if cross:
        i = rng.randrange(n - 2)
        ring[i], ring[i + 1] = ring[i + 1], ring[i]
    return rings([[*ring, ring[0]]])


def test_known_shapes(spark):
    shapes = [s for s, _ in SHAPES]
    bad = {r.fid for r in invalid_features(frame(spark, shapes)).collect()}
    assert bad == {k for k, (_, ok) in enumerate(SHAPES) if not ok}


def test_random_shapes_and_scales(spark):
    rng = random.Random(2)
    shapes = [star(rng, rng.choice([5, 9, 40, 300]), rng.random() < 0.5) for _ in range(60)]
    shapes += [[[r * s + [s, -s] for r in part] for part in shape] for shape in shapes[:20] for s in (1e-6, 1e7)]
    bad = {r.fid for r in invalid_features(frame(spark, shapes)).collect()}
    assert bad == {k for k, s in enumerate(shapes) if not G.is_valid(s)} and 10 < len(bad) < len(shapes) - 10


def test_simple_shapes_need_no_join(spark):
    shapes = [rings([SQUARE]), rings([[(0, 0), (0, 2), (1, 2), (1, 0), (0, 0)]]), rings([[(0, 0), (4, 0), (0, 3), (0, 0)]]), rings([[(0, 0), (4, 1), (5, 5), (0, 4), (0, 0)]]), rings([SQUARE, box(2, 2, 3, 3)]), rings([[(0, 0), (0, 0), (1, 1), (1, 1), (0, 0)]])]
    assert [r[0] for r in frame(spark, shapes).orderBy("fid").select(is_simple(F.col("geometry"))).collect()] == [True, True, True, False, False, False]


def test_broken_rings(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    shapes = [[[[point(0, 0), point(1, 0), point(1, 1), point(0, 1)]]], [[[point(0, 0), point(1, 0), point(0, 0)]]], [[[point(0, 0), point(float("nan"), 0), point(1, 1), point(0, 0)]]], [[[point(0, 0), point(float("inf"), 0), point(1, 1), point(0, 0)]]], [[[point(0, 0), point(1, 1), point(2, 2), point(0, 0)]]]]
    found = spark.createDataFrame(list(enumerate(shapes)), f"fid long, geometry {G.SCHEMA}")
    assert {r.fid for r in invalid_features(found).collect()} == set(range(5))


def test_a_huge_ring_is_spread(spark):
    """200,000 edges of one feature: no Python, no nested loop, equal shares of many tasks; one crossing is found."""
    n = 200_000
    ring = [((2 + 0.1 * math.sin(90 * t)) * math.cos(t), (2 + 0.1 * math.sin(90 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    huge = frame(spark, [rings([[*ring, ring[0]]])])
    plan = invalid_features(huge)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "NestedLoop", "Cartesian"))
    dealt = numbered_edges(huge).repartition(8, F.hash(F.floor(F.col("ax") * 1000), F.floor(F.col("ay") * 1000))).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r[1] for r in dealt) < n / 4
    assert invalid_features(huge).isEmpty()
    ring[50_000] = (ring[20_000][0] * 1.01, ring[20_000][1] * 1.01)
    assert not invalid_features(frame(spark, [rings([[*ring, ring[0]]])])).isEmpty()


def test_assignment_refuses_invalid_layers(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(40) for c in range(40)], "row int, col int, value double")
    grid = Raster(GridSpec.north_up(-5, 35, 1, 1, 40, 40, "EPSG:3857"), cells)
    for shape, ok in SHAPES[4:8]:
        layer = VectorLayer(frame(spark, [shape]), "EPSG:3857")
        if ok:
            assert cf.assign_population(layer, grid).frame.count() == 1
        else:
            with pytest.raises(ValueError, match="invalid geometry"):
                cf.assign_population(layer, grid)


def test_surface_areas(spark):
    """Whole and clipped areas as by clipping and quadrature in numpy: boxes, slanted rings, holes, parts, and grids that cut them; no Python."""
    from cellfold.operators.surface import surface_areas

    shapes = [rings([box(-3, -2, 4, 5)]), rings([box(0, 0, 0.001, 0.001)]), rings([[(0, 0), (7, 1), (3, 8), (-4, 3), (0, 0)]]), rings([SQUARE, box(2, 2, 8, 8)], [box(20, 40, 30, 50)]), rings([[(-70, -50), (80, -40), (60, 60), (-50, 70), (-70, -50)]]), rings([[(1, 1), (1, 9), (9, 5), (1, 1)]])]
    bounds = (0.0, 0.0, 6.5, 7.25)
    frame_ = frame(spark, shapes)
    areas = surface_areas(frame_, *bounds)
    found = {r.fid: r for r in areas.collect()}
    assert "Python" not in areas._jdf.queryExecution().executedPlan().toString()
    for k, shape in enumerate(shapes):
        assert found[k].whole == pytest.approx(G.surface_area(shape), rel=1e-9), k
        assert found[k].inside == pytest.approx(G.surface_area(G.clip(shape, bounds[0], bounds[1], bounds[2], bounds[3])), rel=1e-8), k
    for bad in (rings([box(-180, -80, 180, 85)]), rings([[(0, 0), (179, 0), *[(179 - i * 0.05, 1 + i % 2 * 80) for i in range(130)], (0, 0)]])):
        with pytest.raises(Exception, match="half or more|added points"):
            surface_areas(frame(spark, [bad]), *bounds).collect()
