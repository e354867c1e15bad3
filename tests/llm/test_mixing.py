import hashlib
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellfold.llm.mixing import mix_sources, poisson_steps, replication_rates
from cellfold.llm.queries import ORACLES, op3_token_counts, op8_document_fingerprints, op9_url_filter, op10_source_mixing

from tests.conftest import SF, comparable


def draw(key, rate, seed):
    u = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) / 16**13
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("rate", [0.01, 1.0, 37.5, 900.0, 5000.0])
def test_steps(spark, rate):
    steps = spark.range(1).select(poisson_steps(F.lit(rate)).alias("s")).first()[0]
    assert all(b >= a for a, b in zip(steps, steps[1:])) and steps[-1] == pytest.approx(1.0, abs=1e-9)
    for k in {0, 1, int(rate), int(rate + 3 * rate**0.5) + 1}:
        assert steps[k] == pytest.approx(sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1)), abs=1e-9)


@pytest.mark.parametrize("rate", [0.0, -1.0, None])
def test_no_rate_draws_nothing(spark, rate):
    assert spark.range(1).select(poisson_steps(F.lit(rate).cast("double")).alias("s")).first()[0] == [1.0]


def test_rates_and_draws(spark):
    rows = [(i, "t", "en", "big" if i % 4 else "small", 1, "c") for i in range(2000)] + [(None, "t", "en", "big", 1, "c"), (9, "t", "en", None, 1, "c"), (10, None, "en", "unknown", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string")
    rates = {r.source: r.rate for r in replication_rates(docs, {"small": 3.0, "big": 1.0, "absent": 9.0}).collect()}
    n = Counter(r[3] for r in rows)
    assert rates == {"small": pytest.approx(0.75 * len(rows) / n["small"]), "big": pytest.approx(0.25 * len(rows) / n["big"]), "unknown": 0.0, None: 0.0}
    found = mix_sources(docs, {"small": 3.0, "big": 1.0}, seed=5)
    assert found.columns == [*docs.columns, "copy"]
    counts = Counter((r.doc_id, r.source) for r in found.collect())
    want = {(r[0], r[3]): draw("null" if r[0] is None else r[0], rates[r[3]], 5) for r in rows if rates[r[3]]}
    assert counts == Counter({k: v for k, v in want.items() if v})
    shares = Counter(r.source for r in found.collect())
    assert shares["small"] / sum(shares.values()) == pytest.approx(0.75, abs=0.04)


def test_order_is_global_and_repeatable(spark):
    docs = spark.createDataFrame([(i, "a" if i < 500 else "b") for i in range(1000)], "doc_id long, source string")
    first = [(r.doc_id, r.copy) for r in mix_sources(docs, {"a": 1.0, "b": 1.0}).collect()]
    assert first == [(r.doc_id, r.copy) for r in mix_sources(docs, {"a": 1.0, "b": 1.0}).collect()]
    head = [i for i, _ in first[: len(first) // 4]]
    assert 0.3 < sum(i < 500 for i in head) / len(head) < 0.7


def test_empty_clash_and_total(spark, empty_docs, odd_docs):
    assert mix_sources(empty_docs, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="fp"):
        mix_sources(odd_docs, {"a": 1.0}, copy_col="fp")
    assert mix_sources(odd_docs, {"a": 1.0}, copy_col=None, total=3000).columns == odd_docs.columns
    assert 2500 < mix_sources(odd_docs.where("source = 'a'").dropDuplicates(["doc_id"]), {"a": 1.0}, total=3000).count() < 3500
    assert mix_sources(odd_docs, {}).count() == 0


def test_null_sources_are_a_source(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(2000)], "doc_id long, source string")
    rates = {r.source: r.rate for r in replication_rates(docs, {"a": 3.0}, default_weight=1.0).collect()}
    assert rates == {"a": pytest.approx(1.5), None: pytest.approx(0.5)}
    found = Counter(r.source for r in mix_sources(docs, {"a": 3.0}, default_weight=1.0).collect())
    assert found[None] == sum(draw(i, 0.5, 17) for i in range(0, 2000, 2)) and found["a"] == sum(draw(i, 1.5, 17) for i in range(1, 2000, 2))


def test_large_rates(spark):
    """One row of a source stands for half of a large mix: parts of bounded rate, spread over partitions."""
    docs = spark.createDataFrame([(0, "one"), *((i, "many") for i in range(1, 1001))], "doc_id long, source string")
    start = time.perf_counter()
    found = mix_sources(docs, {"one": 1.0, "many": 1.0}, total=1_200_000)
    one = found.where("source = 'one'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("copy").alias("copies"))
    sizes = [r.n for r in one.collect() if r.n == r.copies]
    assert sum(sizes) == pytest.approx(600_000, rel=0.01) and max(sizes) < 2 * sum(sizes) / 4
    assert found.where("source = 'one'").select("copy").distinct().count() == sum(sizes)
    assert found.where("source = 'many'").count() == pytest.approx(600_000, rel=0.01) and time.perf_counter() - start < 120
    steps = replication_rates(docs, {"one": 1.0}, total=10**9).where("rate > 0").select(F.size(poisson_steps(F.col("rate") / F.ceil(F.col("rate") / 256))).alias("n"), "rate").first()
    assert steps.rate == 10**9 and steps.n < 1000


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a", "x", "y", "z") for i in range(50)], "doc_id long, source string, __of string, __N string, __order string")
    found = mix_sources(docs, {"a": 1.0})
    assert found.columns == [*docs.columns, "copy"] and sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in mix_sources(docs.select("doc_id", "source"), {"a": 1.0}).collect())
    assert {(r["__of"], r["__N"], r["__order"]) for r in found.collect()} == {("x", "y", "z")}


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7}") for i in range(300)], "doc_id long, source string")
    first = sorted(map(tuple, mix_sources(docs, {}, default_weight=1.0, total=900).collect()))
    monkeypatch.setattr("cellfold.llm.mixing.BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mix_sources(docs, {}, default_weight=1.0, total=900).collect())) == first


@pytest.mark.parametrize("name,query", [("op10_source_mixing", op10_source_mixing), ("op3_token_counts", op3_token_counts)])
def test_queries(spark, duck, name, query):
    assert comparable(query(spark, SF).toPandas()) == comparable(duck.sql(ORACLES[name]).df())


def test_native_plans(spark):
    for query in (op8_document_fingerprints, op9_url_filter, op10_source_mixing):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
