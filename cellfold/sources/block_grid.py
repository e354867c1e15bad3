"""Grids of counts stored by block, with running sums along their rows.

A strip is one row of a block: its values, and how much the grid's whole row holds before
each of its cells. A sum over a run of cells is then a difference of two of them, however
long the run. Strips are Parquet, partitioned by tile: a square of blocks, as large as
keeps the tiles to ``TILES``. A reader that knows its tiles opens no other folder.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.plans.materialize import keep
from cellfold.sources.files import read_text, write_text
from cellfold.sources.grid import BLOCK, GridSpec, Raster, validate_population

#: Tiles, and so partitions, of a stored grid at most; lists of tiles are bounded by it.
TILES = 4096
STRIPS = "row int, bcol int, values array<double>, sums array<double>, missing array<int>"


@dataclass(frozen=True)
class BlockGrid:
    """A stored grid: its folder, what is known of its counts, and how it is cut.

    Its values are checked when it is written, so that no reader scans them again.
    """

    spark: SparkSession
    folder: str
    spec: GridSpec
    size: int
    tile_blocks: int
    total: float
    valid: int

    @property
    def tiles_across(self) -> int:
        return -(-self.spec.width // (self.size * self.tile_blocks))

    def tile(self, row: Column, col: Column) -> Column:
        side = self.size * self.tile_blocks
        return (F.floor(row / side) * self.tiles_across + F.floor(col / side)).cast("int")

    def strips(self, tiles: DataFrame | None = None) -> DataFrame:
        """(row, bcol, first, values, sums, missing, tile); those of ``tiles(tile)`` only, by dynamic pruning of partitions.

        ``sums`` and ``missing`` have one element more than ``values``: counts and cells without a value in the
        grid's row before each cell, and after the last. ``tiles`` may have repeated and null tiles.
        """
        strips = self.spark.read.schema(f"{STRIPS}, tile int").parquet(f"{self.folder}/strips")
        if tiles is not None:
            # The tiles of a grid are bounded, so their distinct numbers are broadcast. The test of their sign tells Spark to prune.
            strips = strips.join(F.broadcast(tiles.select("tile").where("tile >= 0").distinct()), "tile", "left_semi")
        return strips.withColumn("first", F.col("bcol") * self.size)

    def raster(self, tiles: DataFrame | None = None) -> Raster:
        """The cells with a value, of all or some tiles."""
        cells = self.strips(tiles).select("row", "first", F.posexplode("values").alias("at", "value")).where("value is not null")
        return Raster(self.spec, cells.select("row", (F.col("first") + F.col("at")).alias("col"), "value"))

    def window(self, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        """(row, col, value) from the first to before the last row and column; only tiles of the window are read."""
        side = self.size * self.tile_blocks
        inside = [r * self.tiles_across + c for r in range(max(rows[0], 0) // side, -(-min(rows[1], self.spec.height) // side)) for c in range(max(cols[0], 0) // side, -(-min(cols[1], self.spec.width) // side))]
        strips = self.strips().where(F.col("tile").isin(inside) & F.col("row").between(rows[0], rows[1] - 1) & F.col("bcol").between(cols[0] // self.size, (cols[1] - 1) // self.size))
        cells = strips.select("row", "first", F.posexplode("values").alias("at", "value")).where("value is not null").select("row", (F.col("first") + F.col("at")).alias("col"), "value")
        return cells.where(F.col("col").between(cols[0], cols[1] - 1))


def write_block_grid(raster: Raster, folder: str, size: int = BLOCK, tiles: int = TILES) -> BlockGrid:
    """Check a grid of counts and store it by block in ``folder``, a URI that all executors reach.

    Cells without a value may be null or absent; each other cell stands once. Strips without any value are
    stored too, as rows' running sums go on over them.
    """
    if size < 1 or tiles < 1:
        raise ValueError("size and tiles must be at least 1.")
    spec, spark = raster.spec, raster.cells.sparkSession
    cells = keep(raster.masked().cells.where("value is not null").select("row", "col", "value"))
    total = validate_population(replace(raster, cells=cells))
    across, down = -(-spec.width // size), -(-spec.height // size)
    tile_blocks = max(1, math.ceil(math.sqrt(across * down / tiles)))
    while -(-across // tile_blocks) * -(-down // tile_blocks) > tiles:
        tile_blocks += 1

    def strips(key, table):
        """All strips of a block; a block has ``size`` squared cells at most."""
        r0, c0 = key[0].as_py() * size, key[1].as_py() * size
        shape = min(size, spec.height - r0), min(size, spec.width - c0)
        values = np.full(shape, np.nan)
        row, col, value = (table.column(c).combine_chunks() for c in ("row", "col", "value"))
        held = value.is_valid().to_numpy(zero_copy_only=False)
        at = np.asarray(row)[held] - r0, np.asarray(col.fill_null(0))[held] - c0
        values[at] = np.asarray(value.filter(pa.array(held)))
        sums = np.concatenate([np.zeros((shape[0], 1)), np.cumsum(np.nan_to_num(values), axis=1)], axis=1)
        missing = np.concatenate([np.zeros((shape[0], 1), np.int32), np.cumsum(np.isnan(values), axis=1, dtype=np.int32)], axis=1)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), from_pandas=True))
        return pa.table({"row": pa.array(np.arange(r0, r0 + shape[0], dtype=np.int32)), "bcol": pa.array(np.full(shape[0], key[1].as_py(), np.int32)), "values": lists(values), "sums": lists(sums), "missing": lists(missing)})

    # A row without a value stands for each block, so that none is left out.
    blocks = spark.range(across * down).select((F.floor(F.col("id") / across) * size).cast("int").alias("row"), ((F.col("id") % across) * size).cast("int").alias("col"), F.lit(None).cast("double").alias("value"))
    by = [F.floor(F.col("row") / size).cast("int").alias("brow"), F.floor(F.col("col") / size).cast("int").alias("bcol")]
    made = cells.unionByName(blocks).groupBy(*by).applyInArrow(strips, STRIPS)
    before = Window.partitionBy("row").orderBy("bcol").rowsBetween(Window.unboundedPreceding, -1)
    grid = BlockGrid(spark, folder, spec, size, tile_blocks, total, cells.count())
    based = made.withColumns({"s": F.coalesce(F.sum(F.element_at("sums", -1)).over(before), F.lit(0.0)), "m": F.coalesce(F.sum(F.element_at("missing", -1)).over(before), F.lit(0)).cast("int")})
    based = based.select("row", "bcol", "values", F.transform("sums", lambda x: x + F.col("s")).alias("sums"), F.transform("missing", lambda x: x + F.col("m")).alias("missing"))
    placed = based.withColumn("tile", grid.tile(F.col("row"), F.col("bcol") * size))
    placed.repartition("tile").sortWithinPartitions("tile", "row", "bcol").write.mode("overwrite").partitionBy("tile").parquet(f"{folder}/strips")
    known = {**asdict(spec), "size": size, "tile_blocks": tile_blocks, "total": total, "valid": grid.valid}
    write_text(f"{folder}/grid.json", json.dumps(known))
    return grid


def open_block_grid(spark: SparkSession, folder: str) -> BlockGrid:
    """A stored grid. Only its description is read."""
    known = json.loads(read_text(f"{folder}/grid.json"))
    rest = {k: known.pop(k) for k in ("size", "tile_blocks", "total", "valid")}
    spec = GridSpec(**{**known, "transform": tuple(known["transform"]), "block_shape": tuple(known["block_shape"])})
    return BlockGrid(spark, folder, spec, **rest)
