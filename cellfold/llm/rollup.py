"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch is a table of signed changes: an insert adds a document's count, a delete
takes it away, a revision adds the difference of the new and the old count. Each
batch is aggregated and written under a name of its own attempt in a folder that all
executors share; renaming the folder to the batch's name commits it, so of two writers
of one batch only one does. ``compact`` adds the batches committed since to the last
totals and writes these with the names of all batches that they hold; readers take the
last totals and the batches after them. A batch that is sent again, whole or after a
failure, changes nothing.

Renaming must be atomic, as on HDFS or a POSIX file system.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add ``counts(source, lang, tokenizer, n_tokens)``; a null count is 0."""
    return _changes(counts, F.lit(1), F.coalesce("n_tokens", F.lit(0)))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take ``counts`` away."""
    return _changes(counts, F.lit(-1), -F.coalesce("n_tokens", F.lit(0)))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes from ``n_tokens`` to ``new_tokens``; the number of documents stays."""
    return _changes(counts, F.lit(0), F.coalesce("new_tokens", F.lit(0)) - F.coalesce("n_tokens", F.lit(0)))


def _changes(counts: DataFrame, documents: Column, tokens: Column) -> DataFrame:
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


class TokenRollup:
    """Rollups below ``folder``: a folder of Parquet files for each batch and each totals.

    Null sources, languages and tokenizers are groups of their own. A batch without
    changes, or of empty tables, commits and adds nothing. Repeated changes count each
    time within a batch. Groups whose documents and tokens are both 0 are left out of the
    totals. Other columns of changes are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, prefix: str) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(self._path("")) if s.isDirectory())
        return sorted(f.removeprefix(prefix) for f in found if f.startswith(prefix))

    def _place(self, attempt: str, name: str) -> bool:
        """Rename an attempt's folder; False, and the attempt is removed, if the name is taken."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(attempt), self._path(name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            self._fs().delete(self._path(attempt), True)
            return False
        return True

    def _last(self) -> tuple[int, set[str]]:
        """The number of the last totals (0: none) and the batches that they hold."""
        last = max(map(int, self._folders("totals-")), default=0)
        held = self.spark.read.schema("batch string").parquet(f"{self.folder}/totals-{last}/batches").collect() if last else []
        return last, {r.batch for r in held}

    def batches(self) -> list[str]:
        """Names of all committed batches."""
        return sorted({*self._folders("batch-"), *self._last()[1]})

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Write a batch; False, and nothing done, if a batch of that name is committed."""
        if not re.fullmatch(r"[A-Za-z0-9._=]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        both = reduce(DataFrame.unionByName, changes) if changes else self.spark.createDataFrame([], SCHEMA)
        attempt = f"attempt-{uuid.uuid4().hex}"
        _summed(both).write.parquet(f"{self.folder}/{attempt}")
        return self._place(attempt, f"batch-{batch}")

    def _rows(self, last: int, names: set[str]) -> DataFrame:
        paths = [f"{self.folder}/totals-{last}/rows"] * (last > 0) + [f"{self.folder}/batch-{b}" for b in sorted(names)]
        return _summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def compact(self) -> bool:
        """Add the batches committed since to the last totals; False if there is none, or another writer was first.

        Folders of batches that the totals before held already are removed, with those totals.
        """
        last, held = self._last()
        new = set(self._folders("batch-")) - held
        if not new:
            return False
        attempt = f"attempt-{uuid.uuid4().hex}"
        self._rows(last, new).write.parquet(f"{self.folder}/{attempt}/rows")
        self.spark.createDataFrame([(b,) for b in sorted(held | new)], "batch string").coalesce(1).write.parquet(f"{self.folder}/{attempt}/batches")
        if not self._place(attempt, f"totals-{last + 1}"):
            return False
        for old in [f"batch-{b}" for b in held & set(self._folders("batch-"))] + [f"totals-{last}"] * (last > 0):
            self._fs().delete(self._path(old), True)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens): the last totals and the batches after them."""
        last, held = self._last()
        return self._rows(last, set(self._folders("batch-")) - held).where("documents <> 0 or tokens <> 0")


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def pattern_counts(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """``keep`` columns, tokenizer and n_tokens: matches of each tokenizer's pattern in whole texts.

    Null and empty texts have 0 tokens; one pass over the texts for all tokenizers. Repeated
    rows stay; an empty table gives an empty result; a kept column that has the name of an
    output column is an error.
    """
    if clash := {"tokenizer", "n_tokens"} & set(keep):
        raise ValueError(f"output column {sorted(clash)[0]!r} already exists")
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens")) for name, p in tokenizers.items()]
    return docs.select(*keep, F.explode(F.array(*each)).alias("each")).select(*keep, "each.*")
