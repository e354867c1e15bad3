"""A training corpus in four stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.llm.bpe import bpe_encode
from cellfold.llm.mixing import mix_sources
from cellfold.llm.queries import MIX_SEED, TOXIC, WEIGHTS, pattern, table, vocabulary
from cellfold.llm.shared import bounded_batches, fresh_dir, unused
from cellfold.llm.simhash import simhash_representatives
from cellfold.llm.toxicity import fit, score

#: SQL can't train or run the toxicity network; tests hold the stages against plain Python.
ORACLE_SQL = None

#: Bytes of a batch of texts: executors also hold what earlier stages left in their processes.
BATCH_BYTES = 2 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejecting one.

    Null and empty texts are scored like any other, whole texts by all their windows.
    Repeated rows stay or go together; without labels the score is a constant below the
    rejecting one. All columns stay, whatever their names. An empty table stays empty.
    """
    bounded_batches(spark, BATCH_BYTES)
    model = fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "score")["score"]
    return score(docs, model, score_col=name).where(F.col(name) < TOXIC).drop(name)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Null, empty and wordless texts are near-duplicates of each other. Of rows that repeat
    an id one stays; rows with a null id all stay. All columns stay, whatever their names.
    An empty table stays empty.
    """
    bounded_batches(spark, BATCH_BYTES)
    return simhash_representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order.

    A null source is a source of its own; sources that aren't named, and the null one, have
    the weight 1. Texts play no part; rows with equal ids (null is an id) are repeated as
    often. All columns stay, whatever their names. An empty table stays empty.
    """
    return mix_sources(docs, WEIGHTS, seed=MIX_SEED, default_weight=1.0, copy_col=None)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in place of its text, their number, and whether they decode to the text.

    Null and empty texts have no ids. Rows and all other columns stay; columns named
    n_tokens, ids or exact in the input are an error. An empty table stays empty.
    """
    bounded_batches(spark, BATCH_BYTES)
    kept = [c for c in docs.columns if c != "text"]
    if clash := {"n_tokens", "ids", "exact"} & set(kept):
        raise ValueError(f"output column {sorted(clash)[0]!r} already exists")
    name = unused(docs.columns, "whole", "decoded")
    rows = docs.withColumn(name["whole"], F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = bpe_encode(rows, vocabulary("byte_bpe_50k.tiktoken"), pattern(), decoded_col=name["decoded"], keep=[*kept, name["whole"]])
    exact = F.sha2(name["decoded"], 256) == F.col(name["whole"])
    return coded.select(*[F.col(f"`{c}`") for c in kept], F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
