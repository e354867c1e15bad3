"""Sums of doubles that don't depend on the order of rows.

A double is a few whole numbers, each times a power of 2**32. Whole numbers add up without rounding, in any
order and in any number of partial sums; only the end rounds, once, to the nearest double. So a total is the same
to the last bit under any partitioning, and after lost executors.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, and limbs that any double has at most.
BITS, LIMBS = 32, 4
#: Smaller values are scaled up by a power of two first, by so many limbs, so that no power of two underflows.
TINY, LIFT = 2.0**-800, 28
LIMB = "array<struct<k:int, v:decimal(12,0)>>"


def limbs(value: Column) -> Column:
    """The limbs (k, v) of a finite double: it is the sum of v * 2**(32 k), exactly.

    A limb is cut off with its sign, which leaves a rest that is a double again.
    """
    tiny = F.abs(value) < TINY
    scaled = F.when(tiny, value * F.lit(2.0 ** (BITS * LIFT // 2)) * F.lit(2.0 ** (BITS * LIFT // 2))).otherwise(value)
    # An exponent that is off by one where the logarithm rounds only moves bits to the next limb.
    top = F.when(scaled == 0, 0).otherwise(F.floor(F.log2(F.abs(scaled)) / BITS)).cast("int")
    lift = F.when(tiny, LIFT).otherwise(0)

    def step(acc: Column, i: Column) -> Column:
        unit = F.pow(F.lit(2.0), ((acc["top"] - i) * BITS).cast("double"))
        q = F.when(acc["rest"] >= 0, F.floor(acc["rest"] / unit)).otherwise(-F.floor(-acc["rest"] / unit)).cast("long")
        limb = F.struct((acc["top"] - i - lift).cast("int").alias("k"), q.cast("decimal(12,0)").alias("v"))
        return F.struct((acc["rest"] - q.cast("double") * unit).alias("rest"), acc["top"].alias("top"), F.concat(acc["limbs"], F.array(limb)).alias("limbs"))

    start = F.struct(scaled.alias("rest"), top.alias("top"), F.array().cast(LIMB).alias("limbs"))
    made = F.aggregate(F.sequence(F.lit(0), F.lit(LIMBS - 1)), start, step, lambda acc: acc["limbs"])
    return F.filter(made, lambda x: x["v"] != 0)


def nearest(totals: str) -> Column:
    """The double nearest to a sum of limbs; infinite beyond the largest."""

    def one(parts) -> float:
        whole = sum(Fraction(int(p["v"])) * Fraction(2) ** (BITS * p["k"]) for p in parts)
        try:
            return float(whole)
        except OverflowError:
            return float("inf") if whole > 0 else float("-inf")

    @F.pandas_udf("double")
    def run(sums: pd.Series) -> pd.Series:
        return sums.map(one)

    return run(totals)


def exact_sums(rows: DataFrame, keys: list[str], **values: Column | str) -> DataFrame:
    """``rows`` grouped by ``keys`` with the exact sum of each value, by the name of its argument.

    Nulls add nothing, and a group without values has null. A NaN makes its sum NaN; infinities add as doubles do. Sums of
    zeros are 0.0. Partial sums are made before the shuffle: a group sends at most some seventy limbs of a task.
    """
    names = list(values)
    value = {n: F.col(v).cast("double") if isinstance(v, str) else v.cast("double") for n, v in values.items()}
    by = [F.col(f"`{k}`") for k in keys]
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in value.items()])
    each = rows.select(*by, F.explode(listed).alias("e")).select(*by, "e.name", "e.value")
    finite = F.when(~odd(F.col("value")), F.col("value"))
    # A limb of zero stands for each value, so that sums of zeros are known too, and carries values that aren't finite.
    own = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("decimal(12,0)").alias("v")))
    parts = each.select(*by, "name", F.when(odd(F.col("value")), F.col("value")).alias("odd"), F.explode(F.when(F.col("value").isNull(), F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("decimal(12,0)").alias("v")))).otherwise(F.concat(own, F.coalesce(limbs(finite), F.array().cast(LIMB))))).alias("limb"))
    summed = parts.groupBy(*by, "name", F.col("limb.k").alias("k")).agg(F.sum("limb.v").alias("v"), F.max(F.when(F.col("limb.k") == 0, F.col("odd"))).alias("high"), F.min(F.when(F.col("limb.k") == 0, F.col("odd"))).alias("low"))
    told = summed.groupBy(*by).agg(*[c for n in names for c in (F.collect_list(F.when((F.col("name") == n) & F.col("v").isNotNull(), F.struct("k", "v"))).alias(f"__{n}"), F.max(F.when(F.col("name") == n, F.col("high"))).alias(f"__high_{n}"), F.min(F.when(F.col("name") == n, F.col("low"))).alias(f"__low_{n}"))])
    # The greatest and the least of values that aren't finite: NaN counts as the greatest.
    outs = [F.when(F.col(f"__high_{n}").isNotNull(), F.col(f"__high_{n}") + F.col(f"__low_{n}")).when(F.size(f"__{n}") > 0, nearest(f"__{n}")).alias(n) for n in names]
    return told.select(*by, *outs)
