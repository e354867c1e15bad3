import os
import random
import zlib

import numpy as np
import pytest

import cellfold.llm.toxicity as tox
from cellfold.llm.queries import op5_toxicity

from tests.conftest import SF

BAD, GOOD = ["vileword", "vilesome", "grudgest"], "the and of river stone light morning walk table paper window garden".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ing"]) for _ in range(rng.choice([8, 40, 150]))]
        labels.append(int(rng.random() < 0.3))
        if labels[-1]:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "er", "ed"])
        texts.append(" ".join(words))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return tox.train(*corpus(1200), epochs=6)


def test_windows_cover_all_words():
    sizes = [1, 5, tox.WINDOW, tox.WINDOW + 1, 200]
    texts, at = [], 0
    for n in sizes:
        texts.append(np.arange(at, at + n, dtype=np.int32))
        at += n
    rows, lengths, owner = tox.windows(texts)
    for i, text in enumerate(texts):
        mine = [set(r[:n].tolist()) for r, n, o in zip(rows, lengths, owner) if o == i]
        assert set().union(*mine) == set(text.tolist())
        assert all(a & b for a, b in zip(mine, mine[1:]))  # neighbours overlap


def test_gradients_are_right():
    model = tox.initial(3)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    rng = np.random.default_rng(0)
    x, lengths, y, weight = rng.standard_normal((5, 3, tox.WIDTH)), np.array([5, 3, 1]), np.array([1.0, 0, 1]), np.full(3, 1 / 3)

    def loss():
        grad = tox.gradients(model, x.astype(np.float32), lengths, y, weight)
        return grad

    grad, dx = loss()

    def value():
        states, w = np.zeros((5, 3, 2 * tox.STATE)), model.weights
        for d, half in (("f", slice(0, tox.STATE)), ("b", slice(tox.STATE, None))):
            h, gate = np.zeros((3, tox.STATE)), x @ w[f"W{d}"] + w[f"b{d}"]
            for t in range(5) if d == "f" else range(4, -1, -1):
                zr = 1 / (1 + np.exp(-(gate[t][:, : 2 * tox.STATE] + h @ w[f"U{d}"][:, : 2 * tox.STATE])))
                z, r = zr[:, : tox.STATE], zr[:, tox.STATE :]
                new = np.tanh(gate[t][:, 2 * tox.STATE :] + (r * h) @ w[f"U{d}"][:, 2 * tox.STATE :])
                h = np.where((t < lengths)[:, None], h + z * (new - h), h)
                states[t, :, half] = h
        logit = tox._pool(states, lengths, w)[0]
        return float((weight * (np.logaddexp(0, logit) - y * logit)).sum())

    for name in ("Wf", "Ub", "bf", "A", "a", "v", "o", "c"):
        w = model.weights[name]
        flat, g = w.reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            up = value()
            flat[i] = keep - eps
            down = value()
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-4


def test_held_out_accuracy(model):
    texts, labels = corpus(400, 9)
    predicted = model.scores(texts) >= 0.3
    assert (predicted == labels).mean() > 0.97


def test_unseen_forms_of_a_word(model):
    assert model.scores(["the river vilewords and stone"])[0] > 0.3 > model.scores(["the river and stone"])[0]


def test_last_word_of_a_long_text_counts(model):
    text = " ".join(["the river of light"] * 3000)
    assert model.scores([text])[0] < 0.3 < model.scores([f"{text} vileword"])[0]


def test_slices_change_nothing(model):
    texts = [*corpus(60, 4)[0], None, "", "\n\t", "!!!", "vileword"]
    whole = model.scores(texts)
    assert np.allclose(whole, model.scores(texts, words_at_once=50), atol=1e-5)
    assert np.allclose(whole[-5:-1], whole[-5]) and ((whole >= 0) & (whole <= 1)).all()


def test_huge_text(model):
    text = " ".join(["the river of light"] * 2000) + " vileword " + " ".join(["a stone walk"] * 2000)
    assert model.scores([text], words_at_once=500)[0] == pytest.approx(model.scores([text])[0], abs=1e-3)


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1]])
def test_training_without_both_labels(labels):
    scores = tox.train(["a b"] * len(labels), np.array(labels)).scores(["anything", None])
    assert ((scores > 0) & (scores < 1)).all() and scores[0] == scores[1]


def test_operator(spark, model, odd_docs, empty_docs):
    rows = tox.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert tox.score(empty_docs, model).count() == 0
    with pytest.raises(ValueError, match="fp"):
        tox.score(odd_docs, model, score_col="fp")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None), (8, 5), (1, 1)], "doc_id long, toxic int")
    assert tox.fit(odd_docs, labels).weights
    assert tox.fit(empty_docs, labels).scale == 0.0


def test_query(spark):
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_rows_of_the_tables(spark):
    """Ranking of held-out labelled documents of a real table, and of the longest of them."""
    folder = SF.replace("sf0.001", "sf0.1")
    if not os.path.exists(f"{folder}/labels.parquet"):
        pytest.skip("needs the larger tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    asked = docs.join(labels.where(tox.held_out("doc_id")).select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic")
    rows = tox.score(asked, tox.fit(docs, labels), keep=["doc_id", "toxic"]).collect()
    toxic, other = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    auc = (toxic[:, None] > other[None, :]).mean() + 0.5 * (toxic[:, None] == other[None, :]).mean()
    assert len(toxic) > 50 and auc > 0.93 and (other >= 0.3).mean() < 0.05 and (toxic >= 0.3).mean() > 0.6, (auc, (other >= 0.3).mean(), (toxic >= 0.3).mean())
    print("AUC", auc, "recall", (toxic >= 0.3).mean(), "false", (other >= 0.3).mean())
