import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellfold.llm.components import forest
from cellfold.llm.similar import sharing_sets, shingle_hashes
from cellfold.llm.simhash import fingerprint, simhash_representatives


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def jaccard(texts):
    sets = [shingle_set(t) for t in texts]
    return np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])


def smallest_of_components(near):
    a, b = np.nonzero(np.triu(near, 1))
    return set(np.flatnonzero(forest(a, b, len(near)) == np.arange(len(near))).tolist())


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash_representatives(docs).collect()}


def chains(rng, groups, length, passage=()):
    """Texts each of which is an edited former one; the group's smallest ids are often far apart."""
    out = []
    for _ in range(groups):
        text = words(rng, rng.choice([90, 150, 200]))
        for _ in range(length):
            out.append(" ".join([*text, *passage]))
            for _ in range(max(1, len(text) // 80)):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block,sample,rows,tokens", [(512, 2048, 1_000_000, 1 << 21), (4, 60, 3000, 900)])
def test_components_over_all_pairs(spark, monkeypatch, block, sample, rows, tokens):
    for name, value in (("BLOCK", block), ("SAMPLE_TEXTS", sample), ("ROWS", rows), ("TOKENS", tokens)):
        monkeypatch.setattr(f"cellfold.llm.similar.{name}", value)
    rng = random.Random(4)
    texts = chains(rng, 9, 9) + chains(rng, 3, 6, words(rng, 30)) + [" ".join(words(rng, 60)) for _ in range(20)]
    assert kept(spark, texts) == smallest_of_components(jaccard(texts) >= 0.8)


def test_copies_beyond_11_bits_and_strangers_within_3(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        text = words(rng, 120)
        texts += [" ".join(text), " ".join(text[:98])]
    same = words(rng, 3) * 400
    texts += [" ".join([*same, *words(rng, 40)]) for _ in range(2)]
    fps = np.array([fingerprint(t) for t in texts], np.uint64)
    bits, near = np.bitwise_count(fps[:, None] ^ fps[None, :]), jaccard(texts) >= 0.8
    assert (near & (bits > 11)).any() and (~near & (bits <= 3)).any()
    assert kept(spark, texts) == smallest_of_components(near)


@pytest.mark.parametrize("block", [1 << 18, 97, 13])
def test_shingle_hashes(monkeypatch, block):
    """Equal sets of shingles have equal hashes, others don't, wherever blocks of bytes end."""
    monkeypatch.setattr("cellfold.llm.similar.BYTES", block)
    rng, seen = random.Random(1), {}
    texts = [None, "", " \t", "A b", "a B  c d e", "a b c d e f a b c d e f", "x" * 700 + " y " + "z" * 900, " \t lead in\x0bg ok ok yes", "é É ü"]
    texts += [" ".join(rng.choice(["aa", "b", "Cc", "ddd", "e" * rng.randrange(1, 40)]) for _ in range(rng.randrange(200))) for _ in range(150)]
    for part, array in ((texts, pa.array(texts)), (texts[3:90], pa.array(texts)[3:90])):
        tokens, sizes = shingle_hashes(array, 5)
        ends = np.cumsum(sizes)
        for text, start, end in zip(part, ends - sizes, ends, strict=True):
            words = (text or "").encode().lower().split()
            want = frozenset(b" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)])
            got = tokens[start:end].tolist()
            assert got == sorted(set(got)) and len(got) == len(want) and seen.setdefault(want, got) == got
    assert len(set(map(tuple, seen.values()))) == len(seen)


def test_sharing_sets(spark):
    """Those stay that share 0.8 of their elements with any other sets; a frequent element is sent once a batch."""
    rng = random.Random(3)
    sets = [sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(1, 40))}) for _ in range(60)]
    sets += [s[: len(s) - rng.randrange(3)] or s for s in sets[:30]] + [sorted({*s[:-1], 7}) for s in sets[40:]]
    count = Counter(x for s in sets for x in s)

    def read(batches):
        for batch in batches:
            yield batch.column(0), np.asarray(batch.column(1).flatten()), np.array([len(x) for x in batch.column(1)])

    want = {i for i, s in enumerate(sets) if sum(count[x] > 1 for x in s) >= 0.8 * len(s) - 1e-9}
    for parts in (1, 3, 50):
        frame = spark.createDataFrame(list(enumerate(sets)), "id long, set array<long>").repartition(4, "id")
        found = sharing_sets(frame, read, "bigint", parts, 0.8).collect()
        assert {r.id for r in found} == want and len(found) == len(want) and all(r.n == len(sets[r.id]) for r in found)
    assert sharing_sets(frame.limit(0), read, "bigint", 3, 0.8).count() == 0
