"""Keeping a DataFrame that several eager checks and the result read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    A local session without one gets a temporary folder; elsewhere that is an error, as
    executors would lose the data with their machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='cellfold-')}")
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_sorted(df: DataFrame, *order: str) -> DataFrame:
    """``df`` computed once, as Parquet in ranges of ``order`` in the shared folder.

    A later filter on these columns skips the row groups outside it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
