"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is a row of words. A word's input is the sum of its own hashed vector (word
input) and the mean of its character n-grams' hashed vectors (character input). A
gated recurrent unit runs over a window's words in each direction; attention pools
the states; one output unit gives the window's logit. Overlapping windows cover the
whole text, and the text's score is that of its highest window, calibrated.

The network is trained in numpy, on a bounded sample of labelled documents, by
multiple instances: in a training step a document stands for its highest window.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from multiprocessing import get_context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import bounded_batches, freed, released, unused

#: Words of a window, and words from one window's start to the next.
WINDOW, STRIDE = 32, 24
#: Rows of the two hashed tables, the width of inputs, and the states of one direction.
WORD_ROWS, GRAM_ROWS, WIDTH, STATE = 1 << 14, 1 << 15, 16, 12
#: Character n-grams of a word, with its boundaries marked.
GRAMS = (3, 4, 5)
#: Bound of the training sample: documents, and characters of a document in it.
SAMPLE, SAMPLE_CHARS = 6000, 20_000
#: Share of a training window's words that are blanked, so that no one word is learned by heart.
DROPPED = 0.2
#: Words whose n-grams are looked up at a time.
CHUNK = 1 << 13
WORD = re.compile(r"[^\W_]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; a text without any has one empty word."""
    return WORD.findall((text or "").lower()) or [""]


def word_rows(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row of each word, n-gram rows of all words in a row, number of n-grams of each word).

    Words are marked with their boundaries; polynomial hashes of code points pick the rows.
    """
    marked = [f"<{w}>" if w else "<>>" for w in distinct]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    prime, golden = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))  # code points from here to the word's end
    rows, valid, h = [], [], points
    for n in range(2, max(GRAMS) + 1):
        h = h * prime + np.append(points[n - 1 :], np.zeros(n - 1, np.uint64))[: len(points)]
        if n in GRAMS:
            rows.append(((h + np.uint64(n)) * golden >> np.uint64(40)) % np.uint64(GRAM_ROWS))
            valid.append(left >= n)
    valid = np.stack(valid, axis=1)
    grams = np.stack(rows, axis=1)[valid].astype(np.int64)
    # Powers by place within the word make the whole word's hash.
    place = (np.arange(len(points)) - np.repeat(starts, sizes)).astype(np.uint64)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), prime, np.uint64))
    whole = np.add.reduceat(points * powers[place.astype(np.int64)], starts)
    return ((whole * golden >> np.uint64(40)) % np.uint64(WORD_ROWS)).astype(np.int64), grams, np.add.reduceat(valid.sum(1), starts)


@dataclass
class Model:
    """The network's arrays; ``weights`` holds all of them by name."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def gates(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The inputs' share of each direction's gates: computed once for each distinct word."""
        parts = [_gates(self.weights, *word_rows(distinct[i : i + CHUNK])) for i in range(0, len(distinct), CHUNK)]
        return tuple(np.concatenate(side) for side in zip(*parts, strict=True))

    def window_logits(self, gf: np.ndarray, gb: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows: ``at`` (windows, WINDOW) numbers words in the rows of ``gf`` and ``gb``."""
        w, n, longest = self.weights, len(at), int(lengths.max())
        states = np.zeros((longest, n, 2 * STATE), np.float32)
        for d, gate, order in (("f", gf, range(longest)), ("b", gb, range(longest - 1, -1, -1))):
            h, u, half = np.zeros((n, STATE), np.float32), w[f"U{d}"], slice(0, STATE) if d == "f" else slice(STATE, None)
            for t in order:
                here = (t < lengths)[:, None]
                g = gate[at[:, t]]
                zr = _sigmoid(g[:, : 2 * STATE] + h @ u[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(g[:, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
                h = np.where(here, h + z * (new - h), h)
                states[t, :, half] = h
        return _pool(states, lengths, w)[0]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's logit of each whole text."""
        cut = [words(t) for t in texts]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        gf, gb = self.gates(list(number))
        at, lengths, owner = windows([np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)) for ws in cut])
        out = np.full(len(texts), -np.inf, np.float32)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            np.maximum.at(out, owner[part], self.window_logits(gf, gb, at[part], lengths[part]))
        return out

    def scores(self, texts: list[str | None], words_at_once: int = 200_000) -> np.ndarray:
        """Calibrated scores of whole texts, in slices of bounded size."""
        out, start = np.zeros(len(texts)), 0
        while start < len(texts):
            size, stop = 0, start
            while stop < len(texts) and (stop == start or size < 4 * words_at_once):
                size += len(texts[stop] or "")
                stop += 1
            part = texts[start:stop]
            if stop - start == 1 and size > 16 * words_at_once:  # a huge text: windows of one slice of words at a time
                ws = words(part[0])
                step = max(1, words_at_once // STRIDE) * STRIDE
                last = max(0, -(-(len(ws) - WINDOW) // STRIDE)) * STRIDE
                # Each slice has the windows that begin in it, and no others.
                best = max(float(self.logits([" ".join(ws[i : i + step + WINDOW - STRIDE])])[0]) for i in range(0, last + 1, step))
                logit = np.array([best])
            else:
                logit = self.logits(part)
            out[start:stop] = 1 / (1 + np.exp(-np.clip(self.scale * logit.astype(float) + self.shift, -30, 30)))
            start = stop
        return out


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers padded with 0, lengths, text) of all overlapping windows of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = k * STRIDE
    lengths = np.minimum(WINDOW, sizes[owner] - begin)
    flat = np.concatenate([*texts, np.zeros(1, np.int32)])
    offset = (np.cumsum(sizes) - sizes)[owner] + begin
    steps = np.arange(WINDOW)
    at = np.where(steps < lengths[:, None], flat[np.minimum(offset[:, None] + steps, len(flat) - 1)], 0)
    return at, lengths, owner


def _pool(states: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray]):
    """Attention over (time, windows, state): logits, and what the gradient needs."""
    keys = np.tanh(states @ w["A"] + w["a"])
    energy = keys @ w["v"]
    energy[np.arange(len(states))[:, None] >= lengths[None, :]] = -1e9
    share = np.exp(energy - energy.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tn,tnk->nk", share, states)
    return pooled @ w["o"] + w["c"], (keys, share, pooled)


def initial(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"word": normal(0.1, WORD_ROWS, WIDTH), "gram": normal(0.3, GRAM_ROWS, WIDTH)}
    for d in "fb":
        w |= {f"W{d}": normal(WIDTH**-0.5, WIDTH, 3 * STATE), f"U{d}": normal(0.5 * STATE**-0.5, STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, np.float32)}
    w |= {"A": normal((2 * STATE) ** -0.5, 2 * STATE, STATE), "a": np.zeros(STATE, np.float32), "v": normal(1.0, STATE), "o": normal((2 * STATE) ** -0.5, 2 * STATE), "c": np.array(-2.0, np.float32)}
    return Model(w)


def gradients(model: Model, x: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted log loss of windows ``x`` (time, windows, width), and of ``x`` itself."""
    w, (T, n, _) = model.weights, x.shape
    states, kept = np.zeros((T, n, 2 * STATE), np.float32), {}
    for d, half in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
        h, u = np.zeros((n, STATE), np.float32), w[f"U{d}"]
        gate = x @ w[f"W{d}"] + w[f"b{d}"]
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            here = (t < lengths)[:, None]
            zr = _sigmoid(gate[t][:, : 2 * STATE] + h @ u[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            new = np.tanh(gate[t][:, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
            kept[d, t] = (h, z, r, new, here)
            h = np.where(here, h + z * (new - h), h)
            states[t, :, half] = h
    logit, (keys, share, pooled) = _pool(states, lengths, w)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "gram")}
    d_logit = ((1 / (1 + np.exp(-logit)) - target) * weight).astype(np.float32)
    g["c"], g["o"] = d_logit.sum(), pooled.T @ d_logit
    d_pooled = d_logit[:, None] * w["o"]
    d_share = np.einsum("nk,tnk->tn", d_pooled, states)
    d_states = share[:, :, None] * d_pooled
    d_energy = share * (d_share - (share * d_share).sum(0))
    g["v"] = np.einsum("tn,tnk->k", d_energy, keys)
    d_keys = d_energy[:, :, None] * w["v"] * (1 - keys**2)
    g["A"], g["a"] = np.einsum("tni,tnj->ij", states, d_keys, optimize=True), d_keys.sum((0, 1))
    d_states += d_keys @ w["A"].T
    dx = np.zeros_like(x)
    for d, half in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
        u, dh = w[f"U{d}"], np.zeros((n, STATE), np.float32)
        for t in range(T - 1, -1, -1) if d == "f" else range(T):
            h, z, r, new, here = kept[d, t]
            dh = dh + d_states[t, :, half]
            live = np.where(here, dh, 0)
            d_new = live * z * (1 - new**2)
            d_z = live * (new - h) * z * (1 - z)
            d_rh = d_new @ u[:, 2 * STATE :].T
            d_r = d_rh * h * r * (1 - r)
            d_gate = np.concatenate((d_z, d_r, d_new), axis=1)
            g[f"b{d}"] += d_gate.sum(0)
            g[f"W{d}"] += x[t].T @ d_gate
            g[f"U{d}"][:, : 2 * STATE] += h.T @ d_gate[:, : 2 * STATE]
            g[f"U{d}"][:, 2 * STATE :] += (r * h).T @ d_new
            dx[t] += d_gate @ w[f"W{d}"].T
            dh = np.where(here, dh * (1 - z) + d_rh * r + d_gate[:, : 2 * STATE] @ u[:, : 2 * STATE].T, dh)
    return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.step = rate, {}, {}, 0

    def update(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        at = ... if rows is None else rows
        rate = self.rate if rows is None else 2 * self.rate  # hashed rows are seldom touched
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        t = min(self.step, 500)
        value[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def train(texts: list[str], labels: np.ndarray, epochs: int = 5, least_steps: int = 240, rate: float = 0.006, seed: int = 5) -> Model:
    """Fit the network; labels are 0 or 1. Without both labels the score is their constant rate.

    Batches hold 16 to 128 documents; small samples go round more often, for at least
    ``least_steps`` steps.

    The last tenth of the sample, after shuffling, is kept apart to calibrate the score.
    """
    labels = np.asarray(labels, np.float32)
    model, rng = initial(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        model.scale, model.shift = 0.0, float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(texts))
    aside, fit = order[: max(1, len(order) // 10)], order[max(1, len(order) // 10) :]
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(x, len(number)) for x in words(t)], np.int32) for t in texts]
    vocabulary, adam, w = Words(list(number)), Adam(rate), model.weights
    del number
    batch = min(128, max(16, len(fit) // 48))
    epochs = max(epochs, -(-least_steps * batch // max(1, len(fit))))
    for epoch in range(epochs):
        adam.rate = rate * min(1.0, 1.6 * (1 - epoch / epochs))
        shuffled = rng.permutation(fit)
        for i in range(0, len(shuffled), batch):
            docs = shuffled[i : i + batch]
            if i % (8 * batch) == 0:  # windows are ranked by a network at most 8 steps old
                near = np.unique(np.concatenate([ids[d] for d in shuffled[i : i + 8 * batch]]))
                gf, gb = np.empty((2, len(near), 3 * STATE), np.float32)
                for j in range(0, len(near), CHUNK):
                    gf[j : j + CHUNK], gb[j : j + CHUNK] = _gates(w, *vocabulary.rows(near[j : j + CHUNK]))
            at, lengths, owner = windows([ids[d] for d in docs])
            local = np.minimum(np.searchsorted(near, at), len(near) - 1)
            logit = np.concatenate([model.window_logits(gf, gb, local[j : j + 4096], lengths[j : j + 4096]) for j in range(0, len(at), 4096)])
            noise = 1.0 if epoch < epochs / 5 else 0.1  # at first any window may stand for its document
            rank = np.lexsort((logit + noise * rng.standard_normal(len(logit)), owner))
            best = rank[np.r_[owner[rank][1:] != owner[rank][:-1], True]]
            part, size = at[best].T, lengths[best]
            distinct, back = np.unique(part, return_inverse=True)
            back = back.reshape(part.shape)
            word_at, grams, sizes = vocabulary.rows(distinct)
            x = _inputs(w, word_at, grams, sizes)[back].astype(np.float32)
            shown = (rng.random(part.shape) >= DROPPED)[:, :, None].astype(np.float32)
            x *= shown
            grad, dx = gradients(model, x, size, labels[docs], np.full(len(docs), 1 / len(docs), np.float32))
            dx *= shown
            norm = max(1.0, np.sqrt(sum(float((v**2).sum()) for v in grad.values())))
            adam.step += 1
            for name, value in grad.items():
                adam.update(name, w[name], value / norm)
            d_word = np.zeros((len(distinct), WIDTH), np.float32)
            live = np.arange(len(part))[:, None] < size[None, :]
            np.add.at(d_word, back[live], dx[live] / norm)
            for name, at_rows, each in (("word", word_at, d_word), ("gram", grams, np.repeat(d_word / sizes[:, None], sizes, axis=0))):
                touched, inverse = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(total, inverse, each)
                adam.update(name, w[name], total, touched)
    logit = model.logits([texts[i] for i in aside]).astype(float)
    model.scale, model.shift = calibrate(logit, labels[aside])
    return model


def _inputs(w: dict, word_at: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Input vectors of words, given their rows in the two tables."""
    mean = np.add.reduceat(w["gram"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
    return w["word"][word_at] + mean


def _gates(w: dict, word_at: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = _inputs(w, word_at, grams, sizes)
    return x @ w["Wf"] + w["bf"], x @ w["Wb"] + w["bb"]


class Words:
    """The distinct words of a training sample, with their rows in the two tables."""

    def __init__(self, distinct: list[str]):
        parts = [[x.astype(np.int32) for x in word_rows(distinct[i : i + CHUNK])] for i in range(0, len(distinct), CHUNK)]
        self.at, self.grams, self.sizes = map(np.concatenate, zip(*parts, strict=True))
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def rows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, n-gram rows, numbers of n-grams) of some words."""
        sizes = self.sizes[pick].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.at[pick], self.grams[np.arange(ends[-1]) + np.repeat(self.starts[pick] - (ends - sizes), sizes)], sizes


def calibrate(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits that fit labels best, near 1 and 0 where there are few labels.

    Newton steps of bounded length on the log loss with a penalty for leaving (1, 0).
    """
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - labels) * logit).sum() + 4.0 * (a - 1), (p - labels).sum() + 0.5 * b])
        h = np.array([[(s * logit**2).sum() + 4.0, (s * logit).sum()], [(s * logit).sum(), s.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / np.abs(step).max(initial=1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(min(max(a, 0.2), 3.0)), float(b)


# -------------------------------------------------------------------- operator
def held_out(doc_id: str) -> Column:
    """Of a row: crc32 of its id as text leaves 2 on division by 4 (null ids: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, **options) -> Model:
    """Train on at most ``sample`` labelled documents of at most ``sample_chars`` characters.

    The other settings were chosen among rows that aren't held out, by the rows of them
    with remainder 3. Longer documents are left out of training only, to bound memory.

    The sample takes the smallest xxhash64 of the id among labelled rows that aren't
    held out; null ids, null labels and labels other than 0 and 1 are left out. Only
    their ids meet the documents, so no other text moves. Of repeated ids the largest
    label and the smallest text count; without labelled documents, or with one label
    only, the score is a constant. Null texts aren't trained on; other columns are ignored.
    The sample goes to one task, which trains in a process of its own: neither the driver nor the
    task's worker keeps what training takes. A task that is run again trains the same network.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    short = docs.where(F.length(text_col) <= sample_chars).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    drawn = known.join(short.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = short.join(F.broadcast(drawn), "id").groupBy("id").agg(F.max("y").cast("int").alias("y"), F.min("t").alias("t"))

    def learn(batches):
        texts, found = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            found += batch.column(1).to_pylist()
        batch = None
        freed()
        # The process shares this one's sample; a process that dies fails the task, which is tried again.
        fork = get_context("fork")
        here, there = fork.Pipe(duplex=False)
        process = fork.Process(target=lambda: there.send(train(texts, np.array(found), **options)))
        process.start()
        there.close()
        model = here.recv()
        process.join()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.scale, model.shift))], pa.binary())], names=["model"])

    bounded_batches(docs.sparkSession)
    made = rows.repartition(1).sortWithinPartitions("id").select("t", "y").mapInArrow(released(learn), "model binary").collect()
    return Model(*pickle.loads(made[0].model)) if made else train([], np.zeros(0, np.int64), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the score (0 to 1) of each whole text.

    One narrow pass. Null and empty texts are scored as a window of one empty word.
    Repeated rows stay; an empty table gives an empty result; a kept column that
    has the name of the score column is an error.
    """
    keep = docs.columns if keep is None else keep
    if score_col in keep:
        raise ValueError(f"output column {score_col!r} already exists")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.scale, model.shift))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = pa.array(own.scores(part.column(len(keep)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], values], names=[*keep, score_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(unused(keep, "text")["text"]))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(released(run), ", ".join([*fields, f"`{score_col}` double"]))
