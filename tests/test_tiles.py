import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellfold as cf
from cellfold.plans.materialize import shared_folder
from cellfold.sources import tiles as T
from cellfold.sources.geotiff import read_geotiff
from cellfold.sources.grid import GridSpec, Raster


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"


def raster_of(spark, height, width, bands=1, **more):
    rng = np.random.default_rng(5)
    rows = [(b + 1, r, c, float(rng.integers(1, 99))) for b in range(bands) for r in range(height) for c in range(width) if rng.random() > 0.1]
    cells = spark.createDataFrame(rows, "band int, row int, col int, value double")
    spec = GridSpec.north_up(-3.5, 60.25, 0.5, 0.25, width, height, "EPSG:4326", bands=bands, **more)
    return Raster(spec, cells if bands > 1 else cells.drop("band"))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_round_trip(spark, folder):
    raster = raster_of(spark, 37, 50, tags={"unit": "people"}, unit="count")
    T.write_tiles(raster, folder, 16)
    again = T.read_tiles(spark, folder)
    assert again.spec == raster.spec and rows(again.cells) == rows(raster.cells)
    # Each tile is a file of its own, in its place.
    names = {n[: n.rindex("-")]: n for n in os.listdir(f"{folder.removeprefix('file://')}/tiles")}
    tile = read_geotiff(spark, f"{folder.removeprefix('file://')}/tiles/{names['1-2-3']}")
    assert (tile.spec.height, tile.spec.width, tile.spec.crs) == (5, 2, "EPSG:4326") and tile.spec.corner(0, 0) == raster.spec.corner(48, 32)
    assert rows(tile.cells.select(F.col("row") + 32, F.col("col") + 48, "value")) == [r for r in rows(raster.cells) if r[0] >= 32 and r[1] >= 48]
    with pytest.raises(ValueError, match="16"):
        T.write_tiles(raster, folder, 10)


def test_a_window_decodes_only_its_own_tiles(spark, folder):
    raster = raster_of(spark, 64, 96, bands=2)
    T.write_tiles(raster, folder, 16)
    spark.dataSource.register(T.TileSource)
    spark.conf.set(T.PUSHDOWN, "true")
    # A tile for each task, so that partitions count decoded tiles.
    cells = spark.read.format(T.FORMAT).option("taskCells", 256).load(folder)
    held = rows(raster.cells)
    for test, want, tiles in (
        (F.lit(True), lambda b, r, c: True, 2 * 4 * 6),
        (F.col("row").between(20, 30), lambda b, r, c: 20 <= r <= 30, 2 * 6),
        ((F.col("row") == 16) & (F.col("col") > 31) & (F.col("col") < 64), lambda b, r, c: r == 16 and 31 < c < 64, 2 * 2),
        ((F.col("band") == 2) & (F.col("row") >= 48) & (F.col("col") <= 15), lambda b, r, c: b == 2 and r >= 48 and c <= 15, 1),
        ((F.col("band") == 2) & (F.col("value") > 50), lambda b, r, c: b == 2, 24),
        (F.col("row") > 63, lambda b, r, c: False, 0),
        (F.col("row").isin(3, 60), lambda b, r, c: r in (3, 60), 48),
    ):
        frame = cells.where(test)
        assert rows(frame) == [x for x in held if want(*x[:3]) and (x[3] > 50 or "value" not in str(test))]
        assert frame.rdd.getNumPartitions() == max(tiles, 1), str(test)


def test_only_pushed_rows_reach_spark(spark, folder):
    T.write_tiles(raster_of(spark, 32, 32), folder, 16)
    cells = T.read_tiles(spark, folder).masked().cells.where((F.col("row") < 3) & (F.col("col") == 4))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "TileReader" not in plan
    assert {(r.row, r.col) for r in cells.collect()} <= {(0, 4), (1, 4), (2, 4)}


def test_unknown_filters_stay_with_spark():
    reader = T.TileReader.__new__(T.TileReader)
    reader.ranges = {c: [0, 99] for c in ("band", "row", "col")}
    kept = [T.D.In(("row",), (1, 2)), T.D.EqualTo(("value",), 3.0), T.D.GreaterThan(("row", "x"), 3), T.D.LessThan(("row",), 2.5), T.D.Not(T.D.EqualTo(("row",), 3))]
    taken = [T.D.GreaterThan(("row",), 3), T.D.LessThanOrEqual(("row",), 9), T.D.EqualTo(("band",), 1), T.D.IsNotNull(("row",))]
    assert list(reader.pushFilters([*kept, *taken])) == kept and reader.ranges == {"band": [1, 1], "row": [4, 9], "col": [0, 99]}


def test_assigned_window_filters_both_sides(spark, folder):
    """The window of an aligned raster reads only tiles and row groups of the window."""
    spec = GridSpec.north_up(0, 64, 1, 1, 64, 64, "EPSG:3857")
    cells = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), (F.col("id") + 1.0).alias("value"))
    T.write_tiles(Raster(spec, cells), folder, 16)
    found = cf.assign_population(T.read_tiles(spark, folder), Raster(spec, cells))
    window = found.window((10, 20), (30, 40))
    assert rows(window) == [(r, c, r * 64 + c + 1.0, r * 64 + c + 1.0) for r in range(10, 20) for c in range(30, 40)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(row,10)" in plan
    hazard, population = found.read((10, 20), (30, 40))
    assert hazard[0, 0] == 10 * 64 + 31 == population[0, 0]


def jobs(spark, run):
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    out = run()
    return out, spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before


def test_blocks_in_one_pass(spark):
    """All blocks in row order by one shuffle; the jobs don't grow with the number of blocks."""
    made = []
    for side, block in ((24, 8), (48, 4)):
        spec = GridSpec.north_up(0, side, 1, 1, side, side, "EPSG:3857", block_shape=(block, block))
        cells = spark.range(side * side).where("id % 5 <> 0").select((F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"), (F.col("id") + 1.0).alias("value"))
        found = cf.assign_population(Raster(spec, cells), Raster(spec, cells))
        blocks, n = jobs(spark, lambda: list(found.iter_blocks()))
        made.append(n)
        assert [w for w, _, _ in blocks] == list(found.windows()) and len(blocks) == (side // block) ** 2
        for (rows_of, cols_of), hazard, population in blocks:
            h, p = found.read(rows_of, cols_of) if rows_of[0] == 0 and cols_of[0] < 8 else (hazard, population)
            assert (h.mask == hazard.mask).all() and (h.filled(0) == hazard.filled(0)).all() and (p.filled(0) == population.filled(0)).all()
            assert hazard.shape == (block, block) and (hazard.mask == population.mask).all()
        assert sum(float(p.sum()) for _, _, p in blocks) == cells.agg({"value": "sum"}).first()[0]
    assert made[1] <= made[0] + 2 and made[1] < 16
