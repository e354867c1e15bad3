"""Sums of counts by bands of a hazard's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shaking intensity bands: half-open from 0.5, 1.5 … up to 10.5.
FIRST, LAST, BANDS = 0.5, 10.5, 10


def band_totals(cells: DataFrame, hazard: str = "hazard", population: str = "population", first: float = FIRST, last: float = LAST, bands: int = BANDS) -> DataFrame:
    """(band, population) for bands 1 … ``bands`` of equal width, each half-open at its upper end.

    Cells where either value is null are left out; a value outside the bands is an
    error, raised when the result is computed.
    """
    rows = cells.where(F.col(hazard).isNotNull() & F.col(population).isNotNull())
    band = F.width_bucket(F.col(hazard), F.lit(float(first)), F.lit(float(last)), F.lit(bands))
    inside = F.when((F.col(hazard) >= first) & (F.col(hazard) < last), band)
    checked = F.coalesce(inside, F.raise_error(F.lit("A hazard value lies outside the bands.")).cast("bigint"))
    sums = rows.groupBy(checked.cast("int").alias("band")).agg(F.sum(population).alias("found"))
    all_bands = cells.sparkSession.range(1, bands + 1).select(F.col("id").cast("int").alias("band"))
    return all_bands.join(sums, "band", "left").select("band", F.coalesce("found", F.lit(0.0)).alias("population"))


def threshold_total(cells: DataFrame, least: float, hazard: str = "hazard", population: str = "population") -> DataFrame:
    """One row: counts where the hazard is at least ``least`` (null if there are none)."""
    return cells.where(F.col(hazard) >= least).agg(F.sum(population).alias("population"))
