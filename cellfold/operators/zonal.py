"""Area-weighted zonal sums of a grid of counts over polygons."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.errors import MissingPopulationDataError, PartialCoverageError
from cellfold.functions import crs as C
from cellfold.functions import geometry as G
from cellfold.operators.block_zonal import zonal_by_blocks
from cellfold.operators.coverage import cell_shares, centers_inside, plane_area
from cellfold.operators.overlap import first_overlap
from cellfold.operators.surface import surface_areas
from cellfold.operators.validity import has_broken_ring, invalid_features, is_simple
from cellfold.plans.materialize import keep
from cellfold.sources.block_grid import BlockGrid
from cellfold.sources.grid import GridSpec, Raster, validate_population
from cellfold.sources.layer import VectorLayer

DATA_FRACTION, DATA_COMPLETE = "population_data_fraction", "population_data_complete"
COVERAGE_FRACTION, COVERAGE_COMPLETE = "population_coverage_fraction", "population_coverage_complete"
#: A share this close to 1, of area or of one cell, counts as complete.
TOLERANCE = 1e-9
#: The largest double below 1: no incomplete share is reported as 1.
BELOW_ONE = math.nextafter(1.0, 0.0)
#: Features that an error names.
NAMED = 5
#: Tolerance, in degrees, of boundaries reprojected to measure surface area.
SURFACE_TOLERANCE = 1e-7


@dataclass(frozen=True)
class Assignment:
    """A result's rows, and what is known of how they were made."""

    frame: DataFrame
    attrs: dict = field(default_factory=dict)


def reserved_columns(partial: bool) -> tuple[str, ...]:
    return (DATA_FRACTION, DATA_COMPLETE) + ((COVERAGE_FRACTION, COVERAGE_COMPLETE) if partial else ())


def data_fraction(valid_cells: Column, area: Column, cell_area: float) -> tuple[Column, Column]:
    """(fraction, complete) of a feature's area that has values; 1.0 exactly if complete."""
    supported = valid_cells * F.lit(cell_area)
    complete = (valid_cells > 0) & (area - supported <= TOLERANCE * cell_area)
    share = F.when(area > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(supported, area)))).otherwise(0.0)
    return F.when(complete, 1.0).otherwise(F.least(share, F.lit(BELOW_ONE))), complete


def _check_layer(layer: VectorLayer, population_column: str, antimeridian: str, partial: bool, row_id: str | None) -> None:
    frame, reserved = layer.frame, reserved_columns(partial)
    if population_column in reserved:
        raise ValueError(f"population_column can't be {population_column!r}; assignment adds that column itself.")
    if population_column in frame.columns:
        raise ValueError(f"hazard already has a column {population_column!r}; choose another population_column.")
    if taken := [n for n in reserved if n in frame.columns]:
        raise ValueError(f"hazard already has a column {', '.join(map(repr, taken))}; rename it before assignment.")
    if layer.crs is None:
        raise ValueError("hazard vector must define a CRS.")
    C.as_crs(layer.crs, "hazard")
    if layer.geometry not in frame.columns:
        raise ValueError(f"hazard vector has no geometry column {layer.geometry!r}.")
    if row_id is not None and row_id not in frame.columns:
        raise ValueError(f"hazard vector has no column {row_id!r} for row_id.")
    g = F.col(layer.geometry)
    empty = (F.size(F.flatten(g)) == 0) | F.exists(F.flatten(g), lambda r: F.size(r) == 0)
    there = g.isNotNull() & ~empty
    rows, missing, vacant, broken, rough = frame.agg(F.count("*"), F.count_if(g.isNull()), F.count_if(g.isNotNull() & empty), F.count_if(there & has_broken_ring(g)), F.count_if(there & ~is_simple(g))).first()
    if not rows:
        raise ValueError("hazard vector must have at least one polygon feature.")
    if row_id is not None:
        _check_ids(frame, row_id)
    if missing:
        raise ValueError("hazard vector has missing geometry.")
    if vacant:
        raise ValueError("hazard vector has empty geometry.")
    if antimeridian == "split":
        return
    # Only shapes that could be invalid are numbered and kept for the joins.
    if broken or rough and not invalid_features(keep(frame.where(there & ~is_simple(g)).select(F.monotonically_increasing_id().alias("fid"), g.cast(G.SCHEMA).alias("geometry")))).isEmpty():
        raise ValueError("hazard vector has invalid geometry.")


def _check_ids(frame: DataFrame, row_id: str) -> None:
    """Ids tell features apart: features of one id would be summed as one."""
    counts = frame.groupBy(F.col(f"`{row_id}`").alias("id")).agg(F.count("*").alias("n"))
    missing, repeated, first = counts.agg(F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)), F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)), F.min(F.when(F.col("n") > 1, F.col("id")))).first()
    if missing:
        raise ValueError(f"row_id {row_id!r} is null in {missing} rows.")
    if repeated:
        raise ValueError(f"row_id {row_id!r} must be unique; {repeated} values repeat, such as {first!r}.")


def on_grid(features: DataFrame, hazard: C.Crs, spec: GridSpec, antimeridian: str, reprojecting: bool) -> DataFrame:
    """``features(fid, geometry)`` in the grid's system: seams refused or split, then reprojected.

    Features whose geometry needs no change stay within DataFrame operations.
    """
    target = spec.known_crs("population")
    if antimeridian == "split" and not hazard.geographic:
        raise ValueError('antimeridian="split" needs vector hazards in a geographic CRS.')
    half = hazard.half_turn
    if half is not None:
        limit = math.nextafter(half, math.inf)
        long_edge = F.exists(F.flatten("geometry"), lambda r: F.exists(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.abs(p["x"] - q["x"])), lambda d: d > limit))
        if antimeridian == "error" and features.where(long_edge).limit(1).count():
            raise ValueError('A hazard boundary has an edge longer than half a turn: it crosses the antimeridian. Split it there, or pass antimeridian="split".')
    split, centre = antimeridian == "split", 0.0
    if split and hazard == target:
        left, _, right, _ = spec.bounds
        if right - left > 2 * half * (1 + 1e-12):
            raise ValueError("population raster longitude span can't exceed one full turn.")
        centre = 0.5 * (left + right)
    if not split and not reprojecting:
        return features
    tolerance = spec.boundary_tolerance

    @F.pandas_udf(G.SCHEMA)
    def move(values: pd.Series) -> pd.Series:
        def one(value):
            shape = G.from_rows(value)
            if split:
                shape = G.split_antimeridian(shape, half, centre)
            if reprojecting:
                shape = G.reproject(shape, hazard, target, tolerance)
            return G.to_rows(shape)

        return values.map(one)

    return features.withColumn("geometry", move("geometry"))


def zonal_summary(features: DataFrame, raster: Raster, shares: DataFrame | None = None) -> DataFrame:
    """(fid, area, inside, valid, total) per feature: plane area in the grid's units, covered and
    valid cells as sums of shares, and the weighted total (null without valid cells)."""
    shares = cell_shares(features, raster.spec) if shares is None else shares
    valued = shares.join(raster.cells.where("value is not null"), ["row", "col"], "left")
    summed = valued.groupBy("fid").agg(F.sum("share").alias("inside"), F.sum(F.when(F.col("value").isNotNull(), F.col("share"))).alias("valid"), F.sum(F.col("share") * F.col("value")).alias("total"))
    measured = features.select("fid", plane_area(F.col("geometry")).alias("area"))
    joined = measured.join(summed, "fid", "left")
    return joined.select("fid", "area", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.coalesce("valid", F.lit(0.0)).alias("valid"), "total")


def coverage_fraction(area: Column, inside: Column, cell_area: float) -> Column:
    return F.when(area > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(inside * cell_area, area)))).otherwise(0.0)


def surface_fractions(features: DataFrame, spec: GridSpec) -> DataFrame:
    """(fid, surface): share of a feature's surface area on the WGS84 ellipsoid inside the grid."""
    crs, world = spec.known_crs("population"), C.KNOWN["EPSG:4326"]
    if crs == world and spec.axis_aligned:
        left, bottom, right, top = spec.bounds
        found = surface_areas(features, left, bottom, right, top)
        share = F.when(F.col("inside") > 0, F.least(F.lit(1.0), F.col("inside") / F.col("whole"))).otherwise(F.raise_error(F.lit("A feature's intersection with the population grid has no area.")).cast("double"))
        return found.select("fid", share.alias("surface"))
    w, h = float(spec.width), float(spec.height)

    @F.pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        def degrees(shape):
            return shape if crs == world else G.reproject(shape, crs, world, SURFACE_TOLERANCE)

        def one(value):
            shape = G.from_rows(value)
            cells = [[_stack(spec.to_cell(r[:, 0], r[:, 1])) for r in part] for part in shape]
            a, b, c, d, e, f = spec.transform
            kept = G.clip(cells, 0.0, 0.0, w, h)
            if not kept:
                raise RuntimeError("A feature's intersection with the population grid has no area.")
            back = [[_stack((a * r[:, 0] + b * r[:, 1] + c, d * r[:, 0] + e * r[:, 1] + f)) for r in part] for part in kept]
            return min(1.0, max(0.0, G.surface_area(degrees(back)) / G.surface_area(degrees(shape))))

        return values.map(one)

    return features.select("fid", share("geometry").alias("surface"))


def _stack(pair):
    import numpy as np

    return np.stack(pair, axis=1)


def _describe(rows: list, count: int, what: str, name) -> str:
    text = ", ".join(f"{name(r['fid'])} {what} {r['share']:.1%}" for r in rows)
    return f"{text}, and {count - len(rows)} more" if count > len(rows) else text


def _worst(summary: DataFrame, test: Column, share: Column) -> tuple[int, list]:
    bad = summary.where(test).select("fid", share.alias("share"))
    count = bad.count()
    return count, (bad.orderBy("fid").limit(NAMED).collect() if count else [])


def assign_polygons(
    layer: VectorLayer,
    population: Raster | BlockGrid,
    population_column: str = "population",
    antimeridian: str = "error",
    allow_overlaps: bool = False,
    allow_reprojection: bool = False,
    allow_partial_coverage: bool = False,
    allow_missing_population_data: bool = False,
    row_id: str | None = None,
    source: dict | None = None,
) -> Assignment:
    """The layer's rows with the counts that their polygons represent.

    A cell counts by the share of it that the polygon covers. Coverage (does the grid
    reach?) and data support (has it values?) are separate facts: support is always
    reported, coverage if partial coverage is allowed. Features without any values get
    null, if that is allowed. ``row_id`` names a unique column for reports and errors;
    without one, rows are numbered in the order Spark reads them. Of a grid stored by
    block, which was checked when it was written, only blocks on the polygons' boundaries are read.
    """
    _check_layer(layer, population_column, antimeridian, allow_partial_coverage, row_id)
    population.spec.validate("population")
    hazard = C.as_crs(layer.crs, "hazard")
    reprojecting = C.match(hazard, population.spec.crs, allow_reprojection)
    stored = isinstance(population, BlockGrid)
    raster = population if stored else population.masked()
    numbered = keep(layer.frame.withColumn("__fid", F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()))
    # Errors name a row by its id, or else by its place in the order Spark reads rows in.
    name = str if row_id else (lambda fid: str(numbered.where(F.col("__fid") < fid).count()))
    features = numbered.select(F.col("__fid").alias("fid"), F.col(layer.geometry).cast(G.SCHEMA).alias("geometry"))
    features = on_grid(features, hazard, raster.spec, antimeridian, reprojecting)
    if antimeridian == "split" or reprojecting:
        features = keep(features)
        if not invalid_features(features).isEmpty():
            raise ValueError("hazard vector has invalid geometry.")
    if not allow_overlaps and (pair := first_overlap(features)):
        raise ValueError(f"hazard vector has overlapping polygons at rows {name(pair[0])} and {name(pair[1])}; pass allow_overlaps=True for independent, non-additive totals.")
    total = population.total if stored else validate_population(raster)
    cell = raster.spec.cell_area
    summary = keep(zonal_by_blocks(features, population) if stored else zonal_summary(features, raster))
    coverage = coverage_fraction(F.col("area"), F.col("inside"), cell)
    note = _longitude_note(features, raster.spec)
    count, rows = _worst(summary, coverage <= 0, coverage)
    if count:
        raise PartialCoverageError(f"{count} hazard {'feature lies' if count == 1 else 'features lie'} entirely outside the population grid: {_describe(rows, count, 'covered', name)}.{note()}")
    count, rows = (0, []) if allow_partial_coverage else _worst(summary, coverage < 1 - TOLERANCE, coverage)
    if count:
        raise PartialCoverageError(f"{count} hazard {'feature reaches' if count == 1 else 'features reach'} outside the population grid: {_describe(rows, count, 'covered', name)}.{note()} Clip the geometry, or pass allow_partial_coverage=True for partial totals with their coverage.")
    fraction, complete = data_fraction(F.col("valid"), F.col("area"), cell)
    count, rows = (0, []) if allow_missing_population_data else _worst(summary, fraction <= 0, fraction)
    if count:
        raise MissingPopulationDataError(f"{count} hazard {'feature has' if count == 1 else 'features have'} no population values anywhere: {_describe(rows, count, 'has data for', name)}. No data is not zero people; pass allow_missing_population_data=True for nulls.")
    added = {population_column: F.when(F.col("valid") > 0, F.col("total")), DATA_FRACTION: fraction, DATA_COMPLETE: complete}
    if allow_partial_coverage:
        covered = coverage >= 1 - TOLERANCE
        summary = summary.join(surface_fractions(features, raster.spec), "fid")
        added |= {COVERAGE_FRACTION: F.when(covered, 1.0).otherwise(F.least(F.col("surface"), F.lit(BELOW_ONE))), COVERAGE_COMPLETE: covered}
    found = summary.select(F.col("fid").alias("__found"), *[value.alias(f"__out_{name}") for name, value in added.items()])
    joined = numbered.join(found, F.col("__fid") == F.col("__found"))
    frame = joined.select(*[F.col(f"`{c}`") for c in layer.frame.columns], *[F.col(f"`__out_{n}`").alias(n) for n in added])
    attrs = {
        **layer.attrs,
        "population_assignment": {
            "method": "area_weighted_sum",
            "population_crs": raster.spec.known_crs("population").name,
            "population_band": 1,
            "overlaps_allowed": allow_overlaps,
            "reprojected": reprojecting,
            "partial_coverage_allowed": allow_partial_coverage,
            "missing_population_data_allowed": allow_missing_population_data,
        },
        "population_source": {**(source or {"source_id": "custom"}), "total": total},
    }
    return Assignment(frame, attrs)


def _longitude_note(features: DataFrame, spec: GridSpec):
    """A sentence for coverage errors where longitudes leave the grid's range; made when needed."""

    def note() -> str:
        if not spec.known_crs("population").geographic:
            return ""
        left, _, right, _ = spec.bounds
        beyond = F.exists(F.flatten("geometry"), lambda r: F.exists(r, lambda p: (p["x"] < left) | (p["x"] > right)))
        if not features.where(beyond).limit(1).count():
            return ""
        return f" Some longitudes lie outside the grid's range of {left:g} to {right:g}; they are never wrapped on their own."

    return note


def center_sums(features: DataFrame, raster: Raster) -> DataFrame:
    """(fid, total): sums over cells whose centre lies in a feature, for comparison."""
    inside = centers_inside(features, raster.spec)
    return inside.join(raster.cells, ["row", "col"]).groupBy("fid").agg(F.sum("value").alias("total"))
