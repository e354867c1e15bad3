import pytest
from pyspark.sql import functions as F

import cellfold as cf
from cellfold.functions import geometry as G
from cellfold.sources.grid import GridSpec, Raster
from cellfold.sources.layer import VectorLayer
from cellfold.sources.order import with_position


@pytest.fixture
def files(spark, tmp_path):
    """Files of 5, 3000 and 70 rows; Spark reads the largest first."""
    n = 0
    for name, size in (("a", 5), ("b", 3000), ("c", 70)):
        spark.range(n, n + size, numPartitions=1).select(F.col("id").alias("v"), (F.col("id") % 7).alias("offset")).write.parquet(str(tmp_path / f"part={name}"))
        n += size
    return str(tmp_path)


def pairs(frame):
    return sorted((r.position, r.v) for r in frame.select("position", "v").collect())


def test_files_by_path_and_place(spark, files):
    frame = with_position(spark.read.parquet(files))
    assert frame.columns == ["v", "offset", "part", "position"] and pairs(frame) == [(i, i) for i in range(3075)]
    assert pairs(frame.repartition(7, "offset")) == [(i, i) for i in range(3075)]


def test_what_a_filter_leaves_is_numbered_in_order(spark, files):
    kept = spark.read.parquet(files).where("v % 3 = 1").withColumn("more", F.lit(1))
    assert pairs(with_position(kept)) == list(enumerate(range(1, 3075, 3)))


def test_rows_without_files(spark):
    frame = spark.createDataFrame([(i,) for i in range(100)], "v long").repartition(1).coalesce(1)
    assert [v for _, v in pairs(with_position(spark.range(0, 500, numPartitions=7).withColumnRenamed("id", "v")))] == list(range(500))
    assert sorted(p for p, _ in pairs(with_position(frame))) == list(range(100))
    assert with_position(frame.limit(0)).count() == 0 and with_position(frame, "row").columns == ["v", "row"]
    with pytest.raises(ValueError, match="exists"):
        with_position(frame, "V")


def test_text_files_have_no_places(spark, tmp_path):
    spark.range(50).coalesce(1).write.csv(str(tmp_path / "t"))
    frame = with_position(spark.read.schema("v long").csv(str(tmp_path / "t")))
    assert pairs(frame) == [(i, i) for i in range(50)]


def test_results_and_errors_by_position(spark, files):
    table = with_position(spark.read.parquet(files)).select("position", F.col("v").alias("cell"))
    people = spark.range(4000).select(F.col("id").alias("cell"), (F.col("id") * 2.0).alias("population"))
    found = cf.assign_population(table, people, cell_columns="cell").orderBy("position").collect()
    assert [(r.position, r.population) for r in found] == [(i, i * 2.0) for i in range(3075)]
    shapes = [G.box(0, 0, 1, 1), G.box(50, 50, 51, 51), G.box(2, 2, 3, 3)]
    layer = VectorLayer(with_position(spark.createDataFrame([(G.to_rows(s),) for s in shapes], f"geometry {G.SCHEMA}").coalesce(1)), "EPSG:3857")
    grid = Raster(GridSpec.north_up(0, 4, 1, 1, 4, 4, "EPSG:3857"), spark.createDataFrame([(r, c, 1.0) for r in range(4) for c in range(4)], "row int, col int, value double"))
    with pytest.raises(cf.PartialCoverageError, match="1 covered"):
        cf.assign_population(layer, grid, row_id="position")
