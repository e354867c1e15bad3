"""Count-preserving regrid of a grid of counts onto a hazard grid.

Along the axes of two aligned grids a source cell's overlaps are products of
one-dimensional shares, so two narrow tables of shares (source index, target index,
share) are joined to the cells and counts are summed by target cell. Grids that are
rotated or in another system go by shares of projected source cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.errors import MissingPopulationDataError, PartialCoverageError
from cellfold.functions import crs as C
from cellfold.functions import geometry as G
from cellfold.operators.coverage import NEGLIGIBLE, cell_shares
from cellfold.operators.zonal import BELOW_ONE, TOLERANCE, coverage_fraction, data_fraction, zonal_summary
from cellfold.plans.materialize import keep_sorted
from cellfold.sources.grid import GridSpec, Raster, block_size, validate_population

#: Relative differences allowed between the counts inside the footprint and on the grid.
SAME_CRS, CROSS_CRS = 1e-6, 1e-3
#: Share tables up to this many rows are broadcast; a grid's sides bound their size.
BROADCAST_ROWS = 1 << 20


@dataclass(frozen=True)
class RasterAssignment:
    """A hazard grid with counts aligned to it, read lazily.

    ``hazard`` (row, col, hazard) and ``aligned`` (row, col, population) have the cells that aren't masked. The
    aligned counts are stored in order of rows and columns.
    """

    shape: tuple[int, int]
    crs: C.Crs
    transform: tuple[float, ...]
    bounds: tuple[float, float, float, float]
    hazard_band: int
    attrs: Mapping[str, object]
    hazard: DataFrame = field(repr=False)
    aligned: DataFrame = field(repr=False)
    block_shape: tuple[int, int] = (256, 256)

    @property
    def cells(self) -> DataFrame:
        """Every hazard cell: (row, col, hazard, population), null where masked."""
        return self.hazard.join(self.aligned, ["row", "col"], "full")

    def window(self, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        """Cells of rows and columns from the first up to before the last.

        Both sides are filtered before they meet, so that sources which know rows and columns read no others.
        """
        inside = F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1)
        return self.hazard.where(inside).join(self.aligned.where(inside), ["row", "col"], "full")

    def read(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> tuple[np.ma.MaskedArray, np.ma.MaskedArray]:
        """Hazard and population of a window as masked arrays on the driver; meant for small windows."""
        rows, cols = rows or (0, self.shape[0]), cols or (0, self.shape[1])
        found = self.window(rows, cols).toPandas()
        out = []
        for name in ("hazard", "population"):
            values, mask = np.zeros((rows[1] - rows[0], cols[1] - cols[0])), np.ones((rows[1] - rows[0], cols[1] - cols[0]), bool)
            valid = found[found[name].notna()]
            at = (valid["row"].to_numpy() - rows[0], valid["col"].to_numpy() - cols[0])
            values[at], mask[at] = valid[name].to_numpy(float), False
            out.append(np.ma.MaskedArray(values, mask))
        return out[0], out[1]

    def windows(self) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """Blocks of at most 256 cells a side, row by row."""
        h, w = self.block_shape
        for r in range(0, self.shape[0], h):
            for c in range(0, self.shape[1], w):
                yield (r, min(r + h, self.shape[0])), (c, min(c + w, self.shape[1]))

    def iter_blocks(self) -> Iterator[tuple]:
        """(window, hazard, population) of each block, row by row, as masked arrays.

        One pass: cells are shuffled once to ranges of blocks, tasks make the blocks' arrays, and the driver holds
        those of the range it is at, while the next one is made.
        """
        (h, w), (height, width) = self.block_shape, self.shape
        across = -(-width // w)

        def arrays(key, table):
            r0, c0 = key[0].as_py() // across * h, key[0].as_py() % across * w
            shape = min(h, height - r0), min(w, width - c0)
            made = {"block": pa.array([key[0].as_py()], pa.int64())}
            at = np.asarray(table.column("row").combine_chunks()) - r0, np.asarray(table.column("col").combine_chunks()) - c0
            for name in ("hazard", "population"):
                grid = np.full(shape, np.nan)
                grid[at] = table.column(name).combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)
                made[name] = pa.array([grid.tobytes()], pa.binary())
            return pa.table(made)

        number = F.floor(F.col("row") / h) * across + F.floor(F.col("col") / w)
        made = self.cells.withColumn("block", number.cast("long")).groupBy("block").applyInArrow(arrays, "block long, hazard binary, population binary")
        rows = made.orderBy("block").toLocalIterator(prefetchPartitions=True)
        row = next(rows, None)
        for k, (rows_of, cols_of) in enumerate(self.windows()):
            shape, here = (rows_of[1] - rows_of[0], cols_of[1] - cols_of[0]), row is not None and row.block == k
            grids = [np.frombuffer(row[name]).reshape(shape).copy() if here else np.full(shape, np.nan) for name in ("hazard", "population")]
            yield ((rows_of, cols_of), *(np.ma.MaskedArray(np.nan_to_num(g), np.isnan(g)) for g in grids))
            if here:
                row = next(rows, None)

    def block_totals(self) -> DataFrame:
        """(block_row, block_col, cells, population): the blocks as one distributed aggregate."""
        h, w = self.block_shape
        by = [F.floor(F.col("row") / h).cast("int").alias("block_row"), F.floor(F.col("col") / w).cast("int").alias("block_col")]
        return self.cells.groupBy(*by).agg(F.count("population").alias("cells"), F.sum("population").alias("population"))


def axis_shares(spark, source_start: float, source_step: float, n_source: int, start: float, step: float, n: int) -> DataFrame:
    """(src, dst, share): the parts of each source interval that lie in each target interval."""
    rows = spark.range(n_source).select(F.col("id").cast("int").alias("src"))
    # Source ends in target coordinates, where target cells are unit intervals.
    a = (F.lit(source_start) + F.col("src") * source_step - start) / step
    b = (F.lit(source_start) + (F.col("src") + 1) * source_step - start) / step
    rows = rows.select("src", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    first, last = F.greatest(F.floor("lo"), F.lit(0)).cast("int"), F.least(F.ceil("hi") - 1, F.lit(n - 1)).cast("int")
    rows = rows.withColumns({"d0": first, "d1": last}).where("d0 <= d1").withColumn("dst", F.explode(F.sequence("d0", "d1")))
    share = (F.least(F.col("hi"), F.col("dst") + 1.0) - F.greatest(F.col("lo"), F.col("dst").cast("double"))) / (F.col("hi") - F.col("lo"))
    # Shares this small are edges that touch: they must not unmask a neighbour.
    return rows.select("src", "dst", share.alias("share")).where(F.col("share") > NEGLIGIBLE)


def align(raster: Raster, target: GridSpec) -> DataFrame:
    """(row, col, population) on ``target``: each count spread by area; cells that no valid cell touches are absent."""
    source = raster.spec
    valid = raster.cells.where("value is not null")
    if source.known_crs("population") == target.known_crs("hazard") and source.axis_aligned and target.axis_aligned:
        spark = raster.cells.sparkSession
        (a, _, c, _, e, f), (ta, _, tc, _, te, tf) = source.transform, target.transform
        rows = axis_shares(spark, f, e, source.height, tf, te, target.height).select(F.col("src").alias("row"), F.col("dst").alias("row2"), F.col("share").alias("rs"))
        cols = axis_shares(spark, c, a, source.width, tc, ta, target.width).select(F.col("src").alias("col"), F.col("dst").alias("col2"), F.col("share").alias("cs"))
        small = lambda table, m, n: F.broadcast(table) if m + n <= BROADCAST_ROWS else table
        spread = valid.join(small(rows, source.height, target.height), "row").join(small(cols, source.width, target.width), "col")
        return spread.groupBy(F.col("row2").alias("row"), F.col("col2").alias("col")).agg(F.sum(F.col("value") * F.col("rs") * F.col("cs")).alias("population"))
    return _align_projected(raster, target)


def _align_projected(raster: Raster, target: GridSpec) -> DataFrame:
    """Source cells as polygons in the target's system; each count spread over what its polygon covers."""
    source, crs, goal = raster.spec, raster.spec.known_crs("population"), target.known_crs("hazard")
    tolerance = target.boundary_tolerance * 0.1

    @F.pandas_udf(G.SCHEMA)
    def ring(row: pd.Series, col: pd.Series) -> pd.Series:
        # The cells of a batch are projected together: one array of corners, refined where they bend.
        steps = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
        x, y = source.corner(col.to_numpy()[:, None] + steps[:, 0], row.to_numpy()[:, None] + steps[:, 1])
        corners = np.stack((x, y), axis=2)
        if source.determinant < 0:
            corners = corners[:, ::-1]  # shells run counter-clockwise
        rings = list(corners) if crs == goal else G.reproject_rings(list(corners), crs, goal, tolerance)
        return pd.Series([G.to_rows([[r]]) for r in rings])

    from cellfold.operators.coverage import plane_area

    fid = F.col("row").cast("long") * source.width + F.col("col")
    shapes = raster.cells.where("value is not null").select(fid.alias("fid"), "value", ring("row", "col").alias("geometry"))
    shapes = shapes.withColumn("area", plane_area(F.col("geometry")))
    shares = cell_shares(shapes, target)
    weighted = shares.join(shapes.select("fid", "value", "area"), "fid")
    share = F.col("share") * F.lit(target.cell_area)
    return weighted.groupBy("row", "col").agg(F.sum(F.col("value") * F.try_divide(share, F.col("area"))).alias("population"))


def conservation_tolerance(given: float | None, reprojecting: bool) -> float:
    return float(given) if given is not None else (CROSS_CRS if reprojecting else SAME_CRS)


def assign_raster(
    hazard: Raster,
    population: Raster,
    population_column: str = "population",
    hazard_band: int | None = None,
    conservation: float | None = None,
    allow_reprojection: bool = False,
    allow_partial_coverage: bool = False,
    allow_missing_population_data: bool = False,
    source: dict | None = None,
) -> RasterAssignment:
    """Counts aligned to a hazard grid, after the checks that the counts are all there.

    Covered counts and data support are measured on source cells. A half-missing target
    cell has what its valid part holds; one without valid source cells is null.
    """
    band, hazard_cells = hazard.band(hazard_band)
    hazard.spec.validate("hazard")
    population.spec.validate("population")
    goal = C.as_crs(hazard.spec.crs, "hazard")
    reprojecting = C.match(goal, population.spec.crs, allow_reprojection)
    raster = population.masked()
    total = validate_population(raster)
    spec = raster.spec
    footprint = hazard.spec.footprint
    if reprojecting:
        footprint = G.reproject(footprint, goal, spec.known_crs("population"), spec.boundary_tolerance)
    spark = raster.cells.sparkSession
    feature = spark.createDataFrame([(0, G.to_rows(footprint))], f"fid long, geometry {G.SCHEMA}")
    cell = spec.cell_area
    fraction, complete = data_fraction(F.col("valid"), F.col("area"), cell)
    found = zonal_summary(feature, raster).select(coverage_fraction(F.col("area"), F.col("inside"), cell).alias("coverage"), F.coalesce("total", F.lit(0.0)).alias("total"), F.when(F.col("valid") > 0, fraction).otherwise(0.0).alias("data")).first()
    where = "Hazard bounds on the population grid: ({}); population bounds: ({}).".format(*(", ".join(f"{v:g}" for v in b) for b in (G.bounds(footprint), spec.bounds)))
    if found["coverage"] <= 0:
        raise PartialCoverageError(f"The hazard raster lies entirely outside the population grid. {where}")
    covered = 1.0 if found["coverage"] >= 1 - TOLERANCE else min(found["coverage"], BELOW_ONE)
    if covered < 1 and not allow_partial_coverage:
        raise PartialCoverageError(f"The hazard raster reaches outside the population grid: {covered:.1%} of it lies inside. {where} Pass allow_partial_coverage=True to leave outside cells null.")
    if found["data"] <= 0 and not allow_missing_population_data:
        raise MissingPopulationDataError("The population grid has no values anywhere under the hazard grid. No data is not zero people; pass allow_missing_population_data=True to go on.")
    aligned = keep_sorted(align(raster, hazard.spec), "row", "col")
    aligned_total = float(aligned.agg(F.coalesce(F.sum("population"), F.lit(0.0))).first()[0])
    tolerance = conservation_tolerance(conservation, reprojecting)
    scale = max(1.0, abs(found["total"]))
    difference = abs(aligned_total - found["total"])
    if difference > tolerance * scale:
        raise ValueError(f"Population was not conserved on the hazard grid: expected {found['total']:.12g}, got {aligned_total:.12g}; the difference of {difference:.12g} exceeds {tolerance * scale:.12g}.")
    masked = Raster(hazard.spec, hazard_cells).masked().cells.select("row", "col", F.col("value").alias("hazard"))
    attrs = {
        "population_assignment": "raster_sum_resampling",
        "population_name": population_column,
        "population_source_total": total,
        "population_covered_total": found["total"],
        "population_aligned_total": aligned_total,
        "population_relative_difference": difference / scale,
        "conservation_tolerance": tolerance,
        "population_coverage_fraction": covered,
        "population_coverage_complete": covered == 1.0,
        "population_data_fraction": found["data"],
        "population_data_complete": found["data"] == 1.0,
        "population_crs": spec.known_crs("population").name,
        "hazard_crs": goal.name,
        "hazard_band": band,
        "reprojected": reprojecting,
        "partial_coverage_allowed": allow_partial_coverage,
        "missing_population_data_allowed": allow_missing_population_data,
        "population_source": {**(source or {"source_id": "custom"}), "total": total},
    }
    return RasterAssignment(hazard.spec.shape, goal, hazard.spec.transform, hazard.spec.bounds, band, MappingProxyType(attrs), masked, aligned, block_size(hazard.spec))


