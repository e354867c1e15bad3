import numpy as np
import pytest

import cellfold.llm.embed_dedup as emb
from cellfold.llm.components import forest
from cellfold.llm.queries import op6_embedding_near_dedup

from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string"


def brute(ids, vectors, labels, threshold=0.98):
    """(n_links, component) of rows by all pairs."""
    n = len(ids)
    good = [v is not None and len(v) and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v, lab in zip(vectors, labels)]
    a, b = [], []
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.float32(vectors[i]).astype(float), np.float32(vectors[j]).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    a.append(i)
                    b.append(j)
    label = forest(np.array(a, int), np.array(b, int), n)
    least = {}
    for i, c in enumerate(label):
        if ids[i] is not None:
            least[c] = min(ids[i], least.get(c, ids[i]))
    return np.bincount(np.array(a, int), minlength=n), [least.get(c) for c in label]


def cloud(n, dim=16, seed=1, noise=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    vectors = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * noise * rng.random((n, 1)) * 3
    return vectors.astype(np.float32), rng.integers(0, 2, n)


@pytest.mark.parametrize("block,small", [(emb.BLOCK, emb.SMALL), (7, 3)])
def test_like_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(emb, "BLOCK", block)
    monkeypatch.setattr(emb, "SMALL", small)
    vectors, labels = cloud(240)
    rows = [(i, v.tolist(), int(lab), "x") for i, (v, lab) in enumerate(zip(vectors, labels))]
    rows += [(900, rows[5][1], rows[5][2], "x"), (901, rows[5][1], rows[5][2], "x"), (902, rows[5][1], None, "x"), (903, None, 1, "x"), (904, [0.0] * 16, 1, "x"), (905, [float("nan")] * 16, 1, "x"), (906, [float("inf")] * 16, 1, "x"), (907, [None] * 16, 1, "x"), (908, [], 1, "x"), (909, [1.0, 2.0], 1, "x"), (910, [2.0, 4.0], 1, "x"), (911, [3e38] * 16, 0, "x")]
    found = {r.vec_id: r for r in emb.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    links, component = brute([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    assert len(found) == len(rows)
    reached = sum(found[r[0]].n_links for r in rows)
    assert all(found[r[0]].n_links <= n for r, n in zip(rows, links)) and reached >= 0.99 * links.sum()
    if reached == links.sum():
        assert [found[r[0]].component_id for r in rows] == component
    assert all(found[i].n_links == 0 and found[i].kept and found[i].component_id == i for i in (902, 903, 904, 905, 906, 907, 908))
    assert found[909].n_links == found[910].n_links == 1 and found[900].n_links >= 2


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (None, [0.0, 1.0], 2, "x"), (None, None, 1, "x")]
    found = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in emb.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(-1, 0, -1, True), (-1, 0, -1, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_empty_table(spark):
    assert emb.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_reaches_its_recall():
    rng = np.random.default_rng(3)
    for n in (100, 100_000):
        k, tables = emb.plan(n, 0.98)
        x = emb.unit(rng.standard_normal((2000, 32)))
        turn = rng.standard_normal(x.shape)
        turn = emb.unit(turn - (turn * x).sum(1, keepdims=True) * x)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * turn
        met = (emb.signatures(x, k, tables) == emb.signatures(y, k, tables)).any(axis=1)
        assert met.mean() > 0.995


def test_query(spark):
    rows = op6_embedding_near_dedup(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    links, component = brute([r.vec_id for r in table], [r.embedding for r in table], [r.label for r in table])
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert found == {r.vec_id: (n, c, r.vec_id == c) for r, n, c in zip(table, links, component)}
