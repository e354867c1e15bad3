"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's rows get the mean repetition rate that brings the source to its target
share. Each row's count is the inverse Poisson distribution at a uniform number
hashed from the row's id and the seed, so a rerun (or a lost executor) repeats the
same draw. Rows are exploded by their counts and shuffled globally.

A rate above ``PART`` is a sum of equal parts of at most ``PART``, each drawn on its
own: the sum of Poisson variables is one of the summed mean. So a distribution's table
is bounded, and the parts of one row are dealt to all partitions before they are
exploded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import cut, literal_table, unused

#: Sources up to this many are broadcast with their rates; beyond it the join shuffles.
BROADCAST_SOURCES = 2_000
#: Hex digits of the MD5 hash that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: The largest rate that is drawn at once.
PART = 256


def uniform(key: Column, seed: int, part: Column | None = None) -> Column:
    """A number in [0, 1) hashed from ``key`` and, after the first, the number of the part."""
    after = [] if part is None else [F.nullif(part, F.lit(0)).cast("string")]
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), *after)
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_steps(rate: Column) -> Column:
    """The cumulative distribution of a Poisson variable at 0, 1, 2 … up to far into its tail.

    Summed from logarithms, so that large rates don't underflow. A rate of 0 or less, or null,
    gives the one step 1.0: no draw exceeds 0.
    """
    last = F.ceil(rate + F.sqrt(rate) * 12 + 30).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = F.least(acc["sum"] + F.exp(log), F.lit(1.0))
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["steps"])).otherwise(F.array(F.lit(1.0)))


def replication_rates(docs: DataFrame, weights: Mapping[str, float] | DataFrame, source_col: str = "source", total: int | None = None, default_weight: float = 0.0) -> DataFrame:
    """(source, n, rate): rows of each source and its mean repetition rate.

    ``weights`` maps sources to relative weights (or is a table source, weight); they are
    scaled over the sources present. A source without a weight has ``default_weight``, and
    so has the null source. ``total`` is the expected size of the mix (the input's by default).
    An empty table has no sources; negative, null and NaN weights count as 0.
    """
    spark = docs.sparkSession
    if not isinstance(weights, DataFrame):
        weights = literal_table(spark, [(k, float(v)) for k, v in weights.items()], {"source": "string", "weight": "double"})
    given = weights.select(F.col("source").cast("string").alias("__s"), F.col("weight").cast("double").alias("__w")).where("__s is not null and not isnan(__w)")
    given = given.groupBy("__s").agg(F.greatest(F.sum("__w"), F.lit(0.0)).alias("__w"))
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n"))
    plain = F.coalesce("__w", F.lit(float(default_weight))).alias("weight")
    joined = counts.join(given, F.col("source") == F.col("__s"), "left").select("source", "n", plain)
    sums = joined.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    target = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * target / F.col("n")).otherwise(F.lit(0.0))
    return joined.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))  # one row of sums


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 17,
    total: int | None = None,
    default_weight: float = 0.0,
    copy_col: str | None = "copy",
    shuffle: bool = True,
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order.

    * ``copy_col`` tells a row's copies apart: 0, 1, … up to a rate of ``PART``, and
      numbers of the same kind with gaps beyond; None leaves it out.
    * Rows with a null id draw like the id "null"; rows with equal ids draw alike.
    * Rows of sources of weight 0 are left out: their rate is 0. Null sources are a source.
    * The order: rows are dealt to partitions and sorted there by a hash of seed, id
      and copy, so a source's or a row's copies spread evenly over partitions. Rows with
      equal ids and copies lie side by side, in no set order.
    * Texts play no part. All columns stay, whatever their names, except that a column
      ``copy_col`` is an error. An empty table gives an empty result.
    """
    if copy_col and copy_col in docs.columns:
        raise ValueError(f"output column {copy_col!r} already exists")
    name = unused(docs.columns, "of", "parts", "steps", "part", "n", "copy", "order")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rates = replication_rates(docs, weights, source_col, total, default_weight).where("rate > 0")
    parts = F.ceil(F.col("rate") / PART).cast("long")
    rates = cut(rates.select(F.col("source").alias(name["of"]), parts.alias(name["parts"]), poisson_steps(F.col("rate") / parts).alias(name["steps"])))
    sources, most = rates.agg(F.count("*"), F.coalesce(F.max(name["parts"]), F.lit(1))).first()
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))

    def draw(rows: DataFrame) -> DataFrame:
        """Rows with their part's number of copies: the number of steps at or below the draw."""
        u = uniform(key, seed, F.col(name["part"]))
        # The draw is a part of the start value, so it is hashed once, not for each step.
        start = F.struct(u.alias("u"), F.lit(0).cast("long").alias("n"))
        count = F.aggregate(name["steps"], start, lambda acc, s: F.struct(acc["u"].alias("u"), (acc["n"] + (s <= acc["u"]).cast("long")).alias("n")), lambda acc: acc["n"])
        rows = rows.select(*columns, name["parts"], name["part"], count.alias(name["n"])).where(F.col(name["n"]) > 0)
        copy = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(name["n"]) - 1), lambda k: k * F.col(name["parts"]) + F.col(name["part"])))
        return rows.select(*columns, copy.alias(name["copy"]))

    rated = docs.join(F.broadcast(rates) if sources <= BROADCAST_SOURCES else rates, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(name["of"])))
    mixed = draw(rated.where(F.col(name["parts"]) == 1).withColumn(name["part"], F.lit(0).cast("long")))
    if most > 1:
        many = rated.where(F.col(name["parts"]) > 1).withColumn(name["part"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(name["parts"]) - 1)))
        mixed = mixed.union(draw(many.repartition(F.xxhash64(key, F.col(name["part"])))))
    if shuffle:
        # A random deal would change if a lost partition were computed anew; a hash does not.
        mixed = mixed.withColumn(name["order"], F.xxhash64(F.lit(seed), key, F.col(name["copy"])))
        mixed = mixed.repartition(F.col(name["order"])).sortWithinPartitions(name["order"])
    return mixed.select(*columns, *([F.col(name["copy"]).alias(copy_col)] if copy_col else []))
