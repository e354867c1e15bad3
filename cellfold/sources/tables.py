"""Tables of hazards and counts in files: Parquet, ORC, JSON lines and CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix. CSV needs a ``schema``: keys are compared exactly, so their types aren't guessed."""
    suffix = os.path.splitext(str(path).rstrip("/"))[1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema, such as 'cell string, population double'.")
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    if suffix in (".json", ".jsonl"):
        return reader.json(path)
    return reader.orc(path) if suffix == ".orc" else reader.parquet(path)


def write_table(frame: DataFrame, path: str) -> None:
    """A table in the format of its suffix; null keys and counts stay null."""
    suffix = os.path.splitext(str(path).rstrip("/"))[1].lower()
    writer = frame.write.mode("errorifexists")
    if suffix == ".csv":
        writer.option("header", True).csv(path)
    elif suffix in (".json", ".jsonl"):
        writer.json(path)
    elif suffix == ".orc":
        writer.orc(path)
    else:
        writer.parquet(path)
