"""Comparison of a fine grid's block sums with a published coarse grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.sources.grid import GridSpec, Raster


def nesting(fine: GridSpec, coarse: GridSpec) -> int:
    """How many fine cells a coarse cell has a side; refuses grids that don't nest exactly."""
    if fine.known_crs("fine") != coarse.known_crs("coarse"):
        raise ValueError("fine and coarse grids must share one CRS.")
    for spec in (fine, coarse):
        if not spec.axis_aligned or spec.transform[0] <= 0 or spec.transform[4] >= 0:
            raise ValueError("fine and coarse grids must be north-up.")
    ratio = round(coarse.transform[0] / fine.transform[0])
    if ratio < 1 or abs(coarse.transform[0] - ratio * fine.transform[0]) > 1e-9 or abs(coarse.transform[4] - ratio * fine.transform[4]) > 1e-9:
        raise ValueError("a coarse cell must be a whole number of fine cells.")
    if abs(fine.transform[2] - coarse.transform[2]) > 1e-9 or abs(fine.transform[5] - coarse.transform[5]) > 1e-9:
        raise ValueError("fine and coarse grids must share their origin.")
    if (fine.height, fine.width) != (coarse.height * ratio, coarse.width * ratio):
        raise ValueError("fine and coarse grids must have one extent.")
    return ratio


def coarsen(fine: Raster, k: int) -> DataFrame:
    """(row, col, value, cells): sums and numbers of valid cells of blocks of k × k."""
    by = [F.floor(F.col(c) / k).cast("int").alias(c) for c in ("row", "col")]
    return fine.cells.groupBy(*by).agg(F.sum("value").alias("value"), F.count("value").alias("cells"))


def summation_bound(n: int, digits: int = 53) -> float:
    """Relative bound of rounding in a sum of n values: (n - 1)u / (1 - (n - 1)u)."""
    u = (n - 1) * 2.0**-digits
    return u / (1 - u)


def compare(fine: Raster, coarse: Raster) -> DataFrame:
    """(row, col, fine, coarse, difference, allowed, same) of every coarse cell.

    Allowed is the larger of 1 and half a unit in the last place of the coarse value as
    a 32-bit float, plus the rounding bound of the sum. Cells without values match if
    both lack them.
    """
    k = nesting(fine.spec, coarse.spec)
    sums = coarsen(fine.masked(), k).select("row", "col", F.col("value").alias("fine"))
    both = coarse.masked().cells.withColumnRenamed("value", "coarse").join(sums, ["row", "col"], "full")
    size = F.greatest(F.abs("coarse"), F.lit(2.0**-126))
    half_ulp = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 24)
    allowed = F.greatest(F.lit(1.0), half_ulp + F.lit(summation_bound(max(2, k * k))) * F.abs("fine"))
    difference = F.abs(F.col("fine") - F.col("coarse"))
    same = F.when(F.col("fine").isNull() | F.col("coarse").isNull(), F.col("fine").isNull() & F.col("coarse").isNull()).otherwise(difference <= allowed)
    return both.select("row", "col", "fine", "coarse", difference.alias("difference"), allowed.alias("allowed"), same.alias("same"))
