import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cellfold.llm.bpe import load
from cellfold.llm.components import forest
from cellfold.llm.queries import MIX_SEED, QUERIES, TOXIC, WEIGHTS, pattern, vocabulary
from cellfold.llm.toxicity import fit

from tests.conftest import SF

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_contract(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "source_mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    for name in names[:-1]:
        given, made = stages[name]
        assert made.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    queries = entry.queries()
    assert queries["pipeline"] is corpus_pipeline.run and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))
    assert set(QUERIES) <= set(queries)


def test_toxicity_stage(spark, stages):
    given, made = stages["toxicity"]
    rows = given.collect()
    scores = fit(given, spark.read.parquet(f"{SF}/labels.parquet")).scores([r.text for r in rows])
    assert sorted(r.doc_id for r in made.collect()) == sorted(r.doc_id for r, s in zip(rows, scores) if s < TOXIC)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def test_simhash_stage(stages):
    """One document, that of the smallest id, of each component of Jaccard links over all pairs."""
    given, made = stages["simhash_near_dedup"]
    rows = sorted(given.collect(), key=lambda r: r.doc_id)
    sets = [shingle_set(r.text) for r in rows]
    a, b = np.array([(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]).reshape(-1, 2).T
    root = forest(a, b, len(rows)) == np.arange(len(rows))
    assert len(a) and sorted(r.doc_id for r in made.collect()) == [r.doc_id for r, k in zip(rows, root, strict=True) if k]


def test_mixing_stage(stages):
    given, made = stages["source_mixing"]
    rows = given.collect()
    n = Counter(r.source for r in rows)
    weight = {s: WEIGHTS.get(s, 1.0) for s in n}
    want = Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * len(rows) / n[r.source]
        u = int(hashlib.md5(f"{MIX_SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r] = k
    assert Counter(made.collect()) == +want


def test_bpe_stage(stages):
    given, made = stages["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=load(vocabulary("byte_bpe_50k.tiktoken"), pattern()).ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in given.collect()}
    rows = made.collect()
    assert len(rows) == given.count() and all(r.exact and r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_run_equals_its_stages(spark, stages):
    whole = corpus_pipeline.run(spark, SF)
    made = stages["byte_bpe"][1]
    assert whole.columns == made.columns and Counter((r.doc_id, r.n_tokens) for r in whole.collect()) == Counter((r.doc_id, r.n_tokens) for r in made.collect())


def test_stages_of_odd_documents(spark, odd_docs):
    """Nulls, empties, repeats, a long text and columns that clash with inner names, stage by stage."""
    docs = odd_docs.withColumns({"__score": F.lit("s"), "__whole": F.lit("w"), "__of": F.lit("o"), "id": F.lit(1), "root": F.lit("r"), "__text": F.lit("t"), "t": F.lit("u"), "y": F.lit(0)})
    whole = Counter(docs.collect())
    tox, simhash, mixing, bpe = (stage for _, stage in corpus_pipeline.STAGES)
    kept = tox(spark, docs, SF)
    assert kept.columns == docs.columns and Counter(kept.collect()) <= whole
    kept = simhash(spark, docs, SF)
    assert kept.columns == docs.columns and Counter(kept.collect()) <= whole
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 7, 8, 9, None], key=str)
    mixed = mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(whole)
    coded = bpe(spark, docs, SF)
    rows = coded.collect()
    assert coded.columns == [*(c for c in docs.columns if c != "text"), "n_tokens", "ids", "exact"] and len(rows) == docs.count()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows) and {r.doc_id for r in rows if r.n_tokens == 0} == {3, 4}
    with pytest.raises(ValueError, match="exact"):
        bpe(spark, odd_docs.withColumnRenamed("fp", "exact"), SF)


def test_stages_of_no_documents(spark, empty_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, SF).count() == 0
