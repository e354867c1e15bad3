"""Folders of GeoTIFF tiles: a sink that tasks write, and a source that decodes only the tiles a query asks for.

Each tile is a GeoTIFF of its own, with its place in the grid, that any program can open. A
table beside them names the files of the attempts that succeeded. The source is a Python
data source: filters on row, col and band reach it, tiles outside them are
no partition of any task, and rows outside them never reach Spark.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from cellfold.sources.files import file_system, read_text, write_bytes, write_text
from cellfold.sources.geotiff import TILE, decode_block, pack_tile, read_directory, write_directory
from cellfold.sources.grid import GridSpec, Raster

FORMAT = "cellfold_tiles"
CELLS = "band int, row int, col int, value double"
#: Cells that a task decodes, about.
TASK_CELLS = 1 << 20
#: Spark hands filters to Python data sources only with this setting.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
MANIFEST = "band int, tile_row int, tile_col int, path string, cells long"


def write_tiles(raster: Raster, folder: str, size: int = TILE) -> None:
    """Write a grid's cells, of all its bands, as GeoTIFF tiles of ``size`` cells a side below ``folder``.

    Tasks write the files, of doubles, deflated, no data as NaN; tiles without a value have none.
    A task that is run again writes its tiles anew under other names. ``size`` is a multiple of 16.
    """
    if size <= 0 or size % 16:
        raise ValueError("size must be a multiple of 16.")
    spec = replace(raster.spec, bands=1, nodata=None)
    cells = raster.masked().cells.where("value is not null")
    cells = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    cells = cells.select("band", "row", "col", "value")

    def encode(key, table):
        band, tile_row, tile_col = (k.as_py() for k in key)
        tile = np.full((size, size), np.nan)
        row, col = (np.asarray(table.column(c).combine_chunks()) % size for c in ("row", "col"))
        tile[row, col] = np.asarray(table.column("value").combine_chunks())
        out = io.BytesIO(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        out.seek(0, io.SEEK_END)
        at, data = out.tell(), pack_tile(tile)
        out.write(data)
        (x, y), (a, b, _, d, e, _) = spec.corner(tile_col * size, tile_row * size), spec.transform
        part = replace(spec, transform=(a, b, x, d, e, y), width=min(size, spec.width - tile_col * size), height=min(size, spec.height - tile_row * size))
        write_directory(out, part, spec.tags, [at], [len(data)], size)
        path = f"{folder}/tiles/{band}-{tile_row}-{tile_col}-{uuid.uuid4().hex}.tif"
        write_bytes(path, out.getvalue())
        return pa.table({"band": pa.array([band], pa.int32()), "tile_row": pa.array([tile_row], pa.int32()), "tile_col": pa.array([tile_col], pa.int32()), "path": [path], "cells": pa.array([table.num_rows], pa.int64())})

    by = [F.col("band").cast("int").alias("tile_band"), F.floor(F.col("row") / size).cast("int").alias("tile_row"), F.floor(F.col("col") / size).cast("int").alias("tile_col")]
    cells.groupBy(*by).applyInArrow(encode, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    write_text(f"{folder}/grid.json", json.dumps({**asdict(replace(raster.spec, nodata=None)), "size": size}))


def read_tiles(spark: SparkSession, folder: str) -> Raster:
    """A folder of tiles as a Raster. Filters on its cells reach the tiles, by ``PUSHDOWN``, which this sets."""
    known = json.loads(read_text(f"{folder}/grid.json"))
    known.pop("size")
    spec = GridSpec(**{**known, "transform": tuple(known["transform"]), "block_shape": tuple(known["block_shape"])})
    spark.dataSource.register(TileSource)
    spark.conf.set(PUSHDOWN, "true")
    cells = spark.read.format(FORMAT).load(folder)
    return Raster(spec, cells if spec.bands > 1 else cells.drop("band"), folder)


class TileSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("taskCells", TASK_CELLS)))


class TilePart(D.InputPartition):
    """Some tiles' bands, places and files."""

    def __init__(self, tiles: list[tuple[int, int, int, str]]):
        self.tiles = tiles


class TileReader(D.DataSourceReader):
    def __init__(self, folder: str, task_cells: int):
        self.folder, self.task_cells = folder, task_cells
        self.size = json.loads(read_text(f"{folder}/grid.json"))["size"]
        #: Closed ranges that row, col and band must lie in.
        self.ranges = {c: [-(1 << 31), (1 << 31) - 1] for c in ("band", "row", "col")}

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if not self._narrow(f):
                yield f

    def _narrow(self, f: D.Filter) -> bool:
        """Take a comparison of row, col or band with a number into the ranges."""
        if isinstance(f, D.IsNotNull):
            return f.attribute in (("band",), ("row",), ("col",), ("value",))
        known = {D.EqualTo: (0, 0), D.GreaterThan: (1, None), D.GreaterThanOrEqual: (0, None), D.LessThan: (None, -1), D.LessThanOrEqual: (None, 0)}
        if type(f) not in known or len(f.attribute) != 1 or f.attribute[0] not in self.ranges or not isinstance(f.value, int):
            return False
        low, high = known[type(f)]
        span = self.ranges[f.attribute[0]]
        if low is not None:
            span[0] = max(span[0], f.value + low)
        if high is not None:
            span[1] = min(span[1], f.value + high)
        return True

    def partitions(self) -> list[TilePart]:
        import pyarrow.parquet as pq

        system, path = file_system(f"{self.folder}/manifest")
        held = sorted(tuple(r.values()) for r in pq.read_table(path, filesystem=system).to_pylist())
        inside = lambda c, first, last: first <= self.ranges[c][1] and last >= self.ranges[c][0]
        side = self.size
        wanted = [(band, r, c, p) for band, r, c, p, _ in held if inside("band", band, band) and inside("row", r * side, r * side + side - 1) and inside("col", c * side, c * side + side - 1)]
        n = max(1, self.task_cells // (side * side))
        # Spark makes a partition of its own where there are none.
        return [TilePart(wanted[i : i + n]) for i in range(0, len(wanted), n)] or [TilePart([])]

    def read(self, partition: TilePart) -> Iterator[pa.RecordBatch]:
        (r0, r1), (c0, c1) = self.ranges["row"], self.ranges["col"]
        for band, tile_row, tile_col, path in partition.tiles:
            layout, _ = read_directory(path)
            system, name = file_system(path)
            with system.open_input_file(name) as f:
                values = decode_block(layout, f.read_at(layout.sizes[0], layout.offsets[0]))[: layout.height, : layout.width, 0]
            row, col = np.nonzero(~np.isnan(values))
            value = values[row, col]
            row, col = row + tile_row * self.size, col + tile_col * self.size
            keep = (row >= r0) & (row <= r1) & (col >= c0) & (col <= c1)
            if keep.any():
                arrays = [np.full(keep.sum(), band, np.int32), row[keep].astype(np.int32), col[keep].astype(np.int32), value[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["band", "row", "col", "value"])
