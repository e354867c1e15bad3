import math
import re
from collections import Counter

import pytest

from cellfold.llm.lexical import STEP, TERM, Opened, Segment, build_index, search, terms_of
from cellfold.llm.queries import op11_lexical_search

from tests.conftest import SF

DOCS = "doc_id long, text string, item_id string, score double"


def split(text):
    return re.findall(TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item, in Python's integers."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, df = sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 10 + 90 * bag.total() * len(bags) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(split(text)) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = "item_id long, text string, doc_id long"


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 1013} Common" for i in range(60_000))
    docs = [(1, "The cat, the CAT!"), (1, "the cat"), (2, None), (3, ""), (4, " ,;\n\t"), (None, "cat dog"), (5, long_text), (6, "İstanbul ÉTÉ été 日本語😀 x y"), (7, "dog"), (8, "dog"), (9, "a_b-c'd.e"), (10, "x" * 2_500_000)]
    items = [(1, "cat dog"), (2, None), (3, ""), (4, "unseen words"), (5, "Common w7 w8 the été ÉTÉ"), (5, "dog dog DOG"), (None, "日本語😀 a b"), (7, "x" * 2_500_000)]
    frame = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in docs], DOCS).repartition(3)
    found = search(build_index(frame, segment_terms=500), spark.createDataFrame([(*x, 9) for x in items], ITEMS), k=3)
    assert rows(found) == plain(docs, items, 3)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"


def test_ties_over_segments(spark):
    """More equal scores than ranks, in many segments: the smallest ids win."""
    docs = [(i, "same words here") for i in range(200)] + [(i, f"same {i}") for i in range(200, 260)]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS).repartition(7)
    items = [(1, "words"), (2, "same 201 words")]
    found = search(build_index(frame, segment_terms=20), spark.createDataFrame([(*x, 0) for x in items], ITEMS))
    assert rows(found) == plain(docs, items)


def test_blocks_of_items(spark):
    docs = [(i, f"alpha{i % 5} beta{i % 7} gamma") for i in range(60)]
    index = build_index(spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS))
    items = [(i, f"alpha{i % 5} beta{i % 3}") for i in range(20)]
    assert rows(search(index, spark.createDataFrame([(*x, 0) for x in items], ITEMS), block_bytes=60)) == plain(docs, items)


def test_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a", None, None)], DOCS)
    some = spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert [search(build_index(d), i).count() for d, i in ((docs, some), (full, items), (full, some))] == [0, 0, 1]


def test_bounds_hold():
    segment = Segment(50, 5000)
    for i in range(50):
        segment.add(i, b" ".join([b"a"] * (i + 1) + [b"b%d" % (i % 4)] * 3 + [b"z%d" % j for j in range(i * 4)]))
    wanted = [b"a", b"b1", b"nothing", b"z3"]
    opened = Opened(segment.row(), wanted)
    import numpy as np

    weights = np.array([7, 5000, 9, 300])
    low, high = opened.bounds([0, 1, 2, 3], weights)
    exact = opened.exact([0, 1, 2, 3], weights, np.ones(50, bool))
    assert (low <= exact).all() and (exact <= high).all() and (high - low < weights.sum() * STEP).all() and (low > 0).all()


def test_slices_cut_between_terms():
    text = ("ab1 " * 700_000).encode()
    assert sum(map(len, terms_of(text))) == 700_000 and {t for part in terms_of(text) for t in part} == {b"ab1"}


@pytest.mark.parametrize("column", ["doc_ids", "terms", "fine"])
def test_index_is_a_table(spark, column):
    index = build_index(spark.createDataFrame([(1, "a b", None, None)], DOCS))
    assert (index.documents, index.terms) == (1, 2) and index.segments(column).count() == 1


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op11_lexical_search(spark, SF)) == plain(docs, items)
