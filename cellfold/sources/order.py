"""Rows in the order of the input.

Spark has no order of rows, but files have: a row's file and its place there are hidden columns of a
scan. Rows that come from no file, or from files without such places, are in the order in which
Spark reads them. Positions are 0, 1, 2, … in that order; a result keeps them like any other column,
so it can be sorted by them at the end, and errors name them if they are the ``row_id``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.plans.materialize import keep

#: Files up to this many have their offsets broadcast; beyond it the join shuffles.
BROADCAST_FILES = 100_000
#: Bits of a row's place in its partition in ``monotonically_increasing_id``.
PLACE = 33


def with_position(frame: DataFrame, name: str = "position") -> DataFrame:
    """``frame`` with the position of each row in the order of its input.

    Of a scan of Parquet, also after filters and new columns, that order is by the files' paths and the rows' places in
    them. A column of that name is an error; no rows stay no rows.
    """
    if name.lower() in (c.lower() for c in frame.columns):
        raise ValueError(f"column {name!r} already exists")
    file, place = _inner(frame, "file"), _inner(frame, "place")
    try:
        rows = frame.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        known = rows.schema is not None
    except AnalysisException:
        known = False
    if not known:
        return _numbered(keep(frame.withColumn(place, F.monotonically_increasing_id())), place, name)
    counts = keep(rows.groupBy(file).agg(F.count("*").alias("n"), F.max(place).alias("last")))
    files, whole = counts.agg(F.count("*"), F.coalesce(F.every(F.col("n") == F.col("last") + 1), F.lit(True))).first()
    if not whole:
        # Some rows are gone, so places have gaps: the rest is sorted and numbered.
        n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(n, file, place).sortWithinPartitions(file, place).drop(file, place)
        return _numbered(keep(ordered.withColumn(place, F.monotonically_increasing_id())), place, name)
    offset = _inner(frame, "offset")
    offsets = _offsets(counts, file).withColumnRenamed("offset", offset)
    joined = rows.join(F.broadcast(offsets) if files <= BROADCAST_FILES else offsets, file)
    return joined.withColumn(name, F.col(offset) + F.col(place)).drop(file, place, offset)


def _inner(frame: DataFrame, name: str) -> str:
    taken, found = {c.lower() for c in frame.columns}, f"__{name}"
    while found in taken:
        found += "_"
    return found


def _offsets(counts: DataFrame, key: str) -> DataFrame:
    """(key, offset): rows before each file or partition, in order of the keys; one row for each of them."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def _numbered(kept: DataFrame, place: str, name: str) -> DataFrame:
    """Positions from partition numbers and places within them, by counts of the partitions."""
    part, offset = _inner(kept, "part"), _inner(kept, "offset")
    rows = kept.withColumn(part, F.shiftright(place, PLACE))
    offsets = _offsets(rows.groupBy(part).agg(F.count("*").alias("n")), part).withColumnRenamed("offset", offset)
    position = F.col(offset) + F.col(place).bitwiseAND(F.lit((1 << PLACE) - 1))
    # A row for each partition: as many as the session made.
    return rows.join(F.broadcast(offsets), part).withColumn(name, position).drop(part, place, offset)
