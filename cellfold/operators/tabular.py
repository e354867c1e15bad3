"""Exact-key one-to-one assignment of a table of counts to a table of hazards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfold.plans.materialize import keep


def normalize_columns(value: str | Sequence[str], parameter: str) -> tuple[str, ...]:
    """One or several column names as a tuple: not empty, no repeats."""
    names = (value,) if isinstance(value, str) else tuple(value)
    if not names:
        raise ValueError(f"{parameter} must name at least one column.")
    if not all(isinstance(n, str) and n for n in names):
        raise ValueError(f"{parameter} must hold non-empty column names.")
    if len(set(names)) < len(names):
        raise ValueError(f"{parameter} can't hold a column twice.")
    return names


def require_columns(frame: DataFrame, names: Sequence[str], who: str) -> None:
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError(f"{who} lacks required columns: {', '.join(map(repr, missing))}.")


def _key(name: str) -> Column:
    return F.col(f"`{name}`")


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, T.NumericType) else kind.typeName()


def missing_key(frame: DataFrame, keys: Sequence[str]) -> Column:
    """Of a row: a key is null or NaN."""
    tests = [_key(k).isNull() | (F.isnan(_key(k)) if isinstance(frame.schema[k].dataType, (T.FloatType, T.DoubleType)) else F.lit(False)) for k in keys]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


#: Of a joined row: true if it met a row of counts.
MATCH = "__matched"


def key_report(frame: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """One row: rows with a missing key, repeated keys, and sums over rows of ``values`` (0 or 1).

    Partial sums per key go into one shuffle, so hot keys stay spread until they are summed.
    """
    names = [f"v{i}" for i in range(len(values))]
    rows = frame.select(*[_key(k).alias(f"k{i}") for i, k in enumerate(keys)], missing_key(frame, keys).cast("long").alias("gap"), *[v.cast("long").alias(n) for v, n in zip(values, names, strict=True)])
    each = rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"), F.sum("gap").alias("gap"), *[F.sum(n).alias(n) for n in names])
    repeated = F.count_if((F.col("n") > 1) & (F.col("gap") == 0))
    return each.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("missing"), repeated.alias("repeated"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def assign_table(hazard: DataFrame, population: DataFrame, cell_columns: str | Sequence[str] = ("longitude", "latitude"), population_column: str = "population") -> DataFrame:
    """``hazard`` with the count of the population row that has exactly its keys.

    Every hazard row needs exactly one match; keys are unique and never missing on
    either side. Checks run at once, one aggregate a side, and in this order: names,
    missing keys, repeated keys, numeric, finite, non-negative, unmatched rows.
    """
    keys = normalize_columns(cell_columns, "cell_columns")
    if population_column in keys:
        raise ValueError("population_column can't also be a cell column.")
    require_columns(hazard, keys, "hazard")
    require_columns(population, (*keys, population_column), "population")
    if population_column in hazard.columns:
        raise ValueError(f"hazard already has a column {population_column!r}; choose another population_column.")
    for k in keys:
        if _family(hazard.schema[k].dataType) != _family(population.schema[k].dataType):
            raise ValueError(f"key column {k!r} has different types in hazard and population.")
    kind = population.schema[population_column].dataType
    numeric = isinstance(kind, T.NumericType) and not isinstance(kind, T.BooleanType)
    value = _key(population_column).cast("double") if numeric else F.lit(0.0)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    left = key_report(hazard, keys).first()
    right = key_report(population, keys, bad, ~bad & (value < 0), F.lit(1)).first()
    named = ", ".join(map(repr, keys))
    for who, report in (("hazard", left), ("population", right)):
        if report["missing"]:
            raise ValueError(f"{who} has missing values in key columns: {named}.")
    for who, report in (("hazard", left), ("population", right)):
        if report["repeated"]:
            raise ValueError(f"{who} has duplicate rows for key columns: {named}.")
    if not numeric and right["v2"]:
        raise ValueError(f"population column {population_column!r} must be numeric.")
    if right["v0"]:
        raise ValueError(f"population column {population_column!r} has values that aren't finite.")
    if right["v1"]:
        raise ValueError(f"population column {population_column!r} needs non-negative counts.")
    counts = population.select(*map(_key, keys), (value if numeric else F.lit(None).cast("double")).alias(population_column))
    joined = keep(matched(hazard, counts, keys, population_column))
    unmatched = joined.agg(F.count_if(F.col(MATCH).isNull())).first()[0]
    if unmatched:
        raise ValueError(f"{unmatched} hazard {'row' if unmatched == 1 else 'rows'} did not find {'its' if unmatched == 1 else 'their'} exact keys in the population.")
    return joined.drop(MATCH)


def matched(hazard: DataFrame, counts: DataFrame, keys: Sequence[str], population_column: str) -> DataFrame:
    """``hazard`` with the count of its keys in ``counts``; ``MATCH`` is null in rows without any."""
    own = counts.select(*[_key(k).alias(f"__key{i}") for i, k in enumerate(keys)], _key(population_column).alias("__count"), F.lit(True).alias("__found"))
    joined = hazard.join(own, [_key(k) == F.col(f"__key{i}") for i, k in enumerate(keys)], "left")
    return joined.select(*[_key(c) for c in hazard.columns], F.col("__count").alias(population_column), F.col("__found").alias(MATCH))
