"""A year of the demographic cube's file, once it is known to be the published one."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np

from cellfold.operators.cube import AGES, FIRST_YEAR, LATITUDES, LONGITUDES, YEARS

#: The file's variable, its type, and its axes with their coordinates.
VARIABLE, TYPE = "demographic_totals", np.dtype("float32")
AXES = {
    "latitude": 90 - np.arange(LATITUDES) / 4,
    "longitude": np.arange(LONGITUDES) / 4,
    "age_band_lower_bound": 5 * np.arange(AGES),
    "year": FIRST_YEAR + np.arange(YEARS),
}


def check_cube(file: Mapping) -> None:
    """Refuse a file whose counts or axes aren't those of the published cube.

    ``file`` maps names to arrays, or to what has their shape, type and slices. Only the
    axes are read.
    """
    for name in (VARIABLE, *AXES):
        if not hasattr(file.get(name), "dtype"):
            raise ValueError(f"The demographic cube has no dataset {name!r}.")
    counts, shape = file[VARIABLE], tuple(map(len, AXES.values()))
    if counts.shape != shape or counts.dtype != TYPE:
        raise ValueError(f"The demographic cube's {VARIABLE} must be {TYPE} of shape {shape}; got {counts.dtype} of shape {counts.shape}.")
    for name, published in AXES.items():
        if not np.array_equal(np.asarray(file[name]), published):
            raise ValueError(f"The demographic cube's {name} isn't the published axis.")


def year_blocks(file: Mapping, year: int, rows: int = 90) -> Iterator[tuple[int, np.ndarray]]:
    """(first latitude, sums over age bands) of ``rows`` latitudes at a time; NaN where every band is NaN."""
    check_cube(file)
    if year not in AXES["year"]:
        raise ValueError(f"The demographic cube has no year {year}.")
    for low in range(0, LATITUDES, rows):
        ages = np.asarray(file[VARIABLE][low : low + rows, :, :, year - FIRST_YEAR], float)
        if np.isinf(ages).any() or (ages < 0).any():
            raise ValueError(f"The demographic cube has infinite or negative counts in {year}.")
        yield low, np.where(np.isnan(ages).all(axis=2), np.nan, np.nansum(ages, axis=2))
