"""Exact-key assignment of a stream of hazards to a static table of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellfold.operators.tabular import key_report, normalize_columns, require_columns


def assign_stream(hazard: DataFrame, population: DataFrame, cell_columns: str | Sequence[str], population_column: str = "population") -> DataFrame:
    """A streaming ``hazard`` with counts of the static ``population``; stateless.

    The static side is checked once: keys complete and unique, counts finite and not
    negative. Stream rows without a match keep a null count, as a stream has no end at
    which to refuse them.
    """
    keys = normalize_columns(cell_columns, "cell_columns")
    require_columns(hazard, keys, "hazard")
    require_columns(population, (*keys, population_column), "population")
    value = F.col(population_column).cast("double")
    report = key_report(population, keys, value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)).first()
    if report["missing"] or report["repeated"]:
        raise ValueError("population needs complete and unique keys.")
    if report["v0"]:
        raise ValueError("the static population needs finite, non-negative counts.")
    return hazard.join(population.select(*keys, value.alias(population_column)), list(keys), "left")


def append_to(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream's rows below ``folder``; a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
