import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from cellfold.llm.similar import read_shingles, sharing_sets
from cellfold.llm.toxicity import Words

from tests.conftest import SF


def held(spark):
    """MB of each Python worker that ran one of a few small tasks."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"mb": pa.array([sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10])})

    return [r.mb for r in spark.range(0, 8, 1, 4).mapInArrow(run, "mb long").collect()]


def test_workers_give_back_what_a_task_freed(spark):
    texts = spark.range(0, 4800, 1, 4).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda k: F.concat(F.lit("w"), F.hash("id", k)))).alias("text"))
    before = max(held(spark))
    assert sharing_sets(texts, read_shingles(5), "bigint", 4, 0.8).count() == 0
    assert max(held(spark)) < before + 60


def test_words_of_training_take_little_more_than_they_hold():
    distinct = [f"word{k * 7919}ing" for k in range(60_000)]
    tracemalloc.start()
    try:
        kept = Words(distinct)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * sum(x.nbytes for x in (kept.at, kept.grams, kept.sizes, kept.starts))


def test_stages_bound_batches_of_texts(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), spark.conf.get(name)
    try:
        for key, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, docs, SF)
            assert key == "source_mixing" or spark.conf.get(name) == f"{corpus_pipeline.BATCH_BYTES}b"
    finally:
        spark.conf.set(name, before)
