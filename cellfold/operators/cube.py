"""A demographic cube in long form: one grid of counts for a year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cube's shape: latitudes from the north, longitudes from 0°, age bands, years.
LATITUDES, LONGITUDES, AGES, FIRST_YEAR, YEARS = 720, 1440, 14, 1950, 71


def year_counts(cube: DataFrame, year: int | None = None, latitudes: int = LATITUDES, longitudes: int = LONGITUDES, south_first: bool = False) -> DataFrame:
    """(row, col, value) of a year: sums over age bands, null where every band is null.

    ``cube(lat_idx, lon_idx, year, value)`` may have ages and other columns. Longitudes
    that run from 0° to 360° are rolled by half a turn to run from -180° to 180°.
    """
    rows = cube if year is None else cube.where(F.col("year") == year)
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    row = F.lit(latitudes - 1) - F.col("lat_idx") if south_first else F.col("lat_idx")
    col = (F.col("lon_idx") + longitudes // 2) % longitudes
    return rows.groupBy(row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.sum(value).alias("value"))
