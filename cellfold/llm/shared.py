"""The shared scratch folder, and helpers that several operators need."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the session names none, a local session gets a temporary one; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cellfold-")
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new name for a folder below the shared one (not created)."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def split_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``few`` on ``key``, a key of ``few``.

    The hash as a second key makes both sides shuffle, so that the rows of a hot key can
    be split over tasks.
    """
    second = f"__{key}2"
    twice = lambda df: df.withColumn(second, F.hash(key))
    return twice(rows).join(twice(few), [key, second], how).drop(second)


#: Bytes of a batch of rows on the way to Python and back.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by ``most`` bytes where the session has a higher bound (64 MB by default).

    Whole texts go to Python, and a task holds a batch several times on both sides. This
    sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``; results don't change.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_of(spark, spark.conf.get(name)) > most:
        spark.conf.set(name, f"{most}b")


def freed(made=None):
    """``made`` as it is, once the memory that this process no longer uses is back with the system.

    Workers live on from task to task, and the allocators of Arrow and C keep what a task
    has freed: up to a hundred MB each, beside which the next stages must find room.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
    return made


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, which leaves no freed memory with the worker."""

    def whole(batches):
        yield from run(batches)
        freed()

    return whole


def size_of(spark: SparkSession, text: str) -> int:
    """Bytes of a size as Spark reads it: 64m, 1g, 8388608b or a plain number."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def unused(columns: list[str], *wanted: str) -> dict[str, str]:
    """Names for inner columns that no column of an input has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = {}
    for name in wanted:
        inner = f"__{name}"
        while inner in taken:
            inner += "_"
        out[name] = inner
    return out


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder URI, on the driver or an executor."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small table from literals, in DataFrame operations only; ``columns`` maps names to types."""
    typed = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items(), strict=True)]) for row in rows]
    empty = F.array().cast(f"array<struct<{','.join(f'{c}:{t}' for c, t in columns.items())}>>")
    return spark.range(1).select(F.inline(F.array(*typed) if typed else empty))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
