import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from cellfold.llm import prefix_trie as module
from cellfold.llm.prefix_trie import DIGEST, Minima, RangeMin, common, nearest_smaller, prefix_trie, rebuilt_conversations
from cellfold.llm.queries import op13_prefix_trie

from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, seq string, lead int"


def digest(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).digest()[:DIGEST]


def plain(turns):
    """The nodes by walking every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = tuple(own.get(c - c % 100, [])[:h] + t[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    below = defaultdict(int)
    for p in members:
        if p:
            below[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), below[p], leaves[p], saved[p], sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()],
        key=repr,
    )


def frame(spark, turns, parts=3):
    return spark.createDataFrame([(*t, "clash", 1) for t in turns], TURNS).repartition(parts)


def rows(found):
    return sorted((tuple(r) for r in found.select(module.NODES).collect()), key=repr)


ODD = [
    (0, 1, "user", "hello"), (0, 2, "assistant", "hi"), (0, None, "system", "be kind"), (0, 3, None, None), (0, 3, None, None), (0, 4, "user", "é😀"),
    (1, 1, "user", "hello"), (2, 5, "user", ""), (3, 1, "user", "x" * 100_000), (199, 1, "user", "no lead"), (199, 2, "user", "more"), (200, 1, "user", "hello"), (200, 1, "user", "also one"),
    (None, 1, "user", "nobody"), (None, None, None, None), (7, None, None, None), (8, 0, "userh", "i"), (9, 0, "user", "hi"), (10, 1, "user", "hello"), (11, 1, "user", "hello"), (12, 1, "user", "hello"),
]


@pytest.mark.parametrize("block", [1, 4, None])
def test_odd_rows(spark, block):
    found = prefix_trie(rebuilt_conversations(frame(spark, ODD)), block)
    assert found.columns == module.NODES and rows(found) == plain(ODD)


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 6), (3, 25), (4, 100)])
def test_random_tries(spark, seed, block):
    """Few distinct turns, so that nodes span many blocks; groups of equal conversations; a long chain."""
    rng = random.Random(seed)
    turns = []
    for c in range(260):
        n = rng.choice([0, 1, 2, 3, 5, 9, 14])
        turns += [(c, t, "user", rng.choice("aab") * (t + 1)) for t in range(n)]
    turns += [(c, t, "user", "a" * (t + 1)) for c in range(300, 360) for t in range(8)]
    turns += [(400, t, "user", "a" * (t + 1)) for t in range(90)] + [(401, t, "user", "a" * (t + 1)) for t in range(120)]
    assert rows(prefix_trie(rebuilt_conversations(frame(spark, turns)), block)) == plain(turns)


def test_no_conversations(spark):
    assert prefix_trie(rebuilt_conversations(frame(spark, [(None, 1, "a", "b")]).where("conv_id > 0"))).count() == 0


def test_one_turnless(spark):
    """Conversation 4 takes its first turns from conversation 0, which isn't there, and has no turn of its own beyond them."""
    turns = [(4, 0, "user", "only")]
    assert zlib.crc32(b"4") % 6 > 0 and rows(prefix_trie(rebuilt_conversations(frame(spark, turns)))) == plain(turns) == [(4, 0, None, 1, 0, 1, 0, sha256(b"4").hexdigest())]


def test_hot_members_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 50)
    turns = [(c, 0, "user", "same") for c in range(0, 90_000, 100)]
    assert rows(prefix_trie(rebuilt_conversations(frame(spark, turns, 5)))) == plain(turns)


def test_nearest_smaller():
    rng = random.Random(5)
    for _ in range(200):
        v = [rng.randrange(5) for _ in range(rng.randrange(1, 20))]
        left, right = nearest_smaller(v)
        assert left == [max((i for i in range(k) if v[i] < v[k]), default=-1) for k in range(len(v))]
        assert right == [min((i for i in range(k + 1, len(v)) if v[i] < v[k]), default=len(v)) for k in range(len(v))]
        low = Minima([(x, 1, 1, 1, 1, 1, x) for x in v])
        for b in range(len(v)):
            for d in range(1, 6):
                stop = min((i for i in range(b + 1, len(v)) if v[i] < d), default=len(v))
                assert low.ends(b, d) == stop and low.between(b, stop, d)[-1] == v[b + 1 : stop].count(d)
                if any(x < d for x in v[:b]):
                    assert low.owner(b, d) == max(i for i in range(b) if v[i] < d)


def test_range_minima():
    import numpy as np

    values = np.random.default_rng(3).integers(0, 99, 77)
    start, stop = zip(*[(i, j) for i in range(77) for j in range(i + 1, 78)], strict=True)
    assert RangeMin(values).of(np.array(start), np.array(stop)).tolist() == [values[i:j].min() for i, j in zip(start, stop, strict=True)]


def test_common():
    a, b = b"a" * DIGEST, b"b" * DIGEST
    assert (common(b"", a), common(a, a + b), common(a + a, a + b), common(a[:-1] + b"x", a), common(a * 9, a * 7)) == (0, 1, 1, 0, 7)


def test_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(op13_prefix_trie(spark, SF)) == plain(turns)
