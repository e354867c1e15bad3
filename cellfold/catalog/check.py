"""Whether a file is the grid that the catalog says it is."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import SparkSession

from cellfold.catalog.sources import PLAUSIBLE_TOTAL, Source
from cellfold.functions.crs import as_crs
from cellfold.sources.geotiff import read_geotiff
from cellfold.sources.grid import GridSpec, Raster, validate_population


def check_grid(spec: GridSpec, source: Source, year: int, name: str, marker: bool) -> None:
    """Refuse a grid that differs from the source's, and, with ``marker``, one that doesn't name the year."""
    if spec.crs is None or as_crs(spec.crs) != as_crs(source.crs):
        raise ValueError(f"{name}: the CRS must be {source.crs}.")
    if (spec.width, spec.height) != (source.width, source.height):
        raise ValueError(f"{name}: the grid must have {source.width} by {source.height} cells.")
    a, b, _, d, e, _ = spec.transform
    cell_x, cell_y = source.cell
    if abs(a - cell_x) > 1e-8 * cell_x or abs(-e - cell_y) > 1e-8 * cell_y:
        raise ValueError(f"{name}: cells must measure {cell_x:g} by {cell_y:g}.")
    if abs(b) > 1e-12 or abs(d) > 1e-12 or a <= 0 or e >= 0:
        raise ValueError(f"{name}: the grid must be north-up.")
    if any(abs(x - y) > 1e-6 * cell_x for x, y in zip(spec.bounds, source.value("bounds", year), strict=True)):
        raise ValueError(f"{name}: the bounds differ from the published ones.")
    nodata = source.value("nodata", year)
    if nodata is not None:
        same = spec.nodata is not None and (math.isnan(nodata) and math.isnan(spec.nodata) or abs(spec.nodata - nodata) <= 1e-6 * abs(nodata))
        if not same:
            raise ValueError(f"{name}: the no-data value must be {nodata!r}.")
    if marker:
        tagged = [str(v) for k, v in spec.tags.items() if k.lower() in ("year", "population_year", "time")]
        if not (any(re.search(rf"(?<!\d){year}(?!\d)", t) for t in tagged) if tagged else re.search(rf"(?<!\d){year}(?!\d)", Path(name).name)):
            raise ValueError(f"{name}: neither its tags nor its name say {year}.")


def check_file(path: Path, source: Source, year: int, marker: bool) -> dict:
    """Check a file's grid and counts; returns the facts observed."""
    raster = read_geotiff(SparkSession.getActiveSession(), path)
    check_grid(raster.spec, source, year, str(path), marker)
    total = validate_population(raster)
    low, high = PLAUSIBLE_TOTAL
    if not low <= total <= high:
        raise ValueError(f"{path}: a total of {total:.6g} is not plausible.")
    return observed(raster, total)


def observed(raster: Raster, total: float) -> dict:
    s = raster.spec
    return {"crs": as_crs(s.crs).name, "width": s.width, "height": s.height, "transform": list(s.transform), "bounds": list(s.bounds), "nodata": s.nodata, "units": s.unit or s.tags.get("units"), "total": total}
