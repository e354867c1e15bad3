import hashlib

import pytest
from pyspark.sql import functions as F

import cellfold.llm.multiset as ms
from cellfold.llm.queries import op8_document_fingerprints

from tests.conftest import SF


def edits(rows):
    """(id, n_chars, sha256 of the edited text) of rows in order."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[: len(text) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_odd_rows(odd_docs, buckets):
    rows = ms.edited_fingerprints(odd_docs, buckets=buckets).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted(edits((r.doc_id, r.text) for r in odd_docs.collect()), key=key)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint != by[9].fingerprint and by[3].fingerprint == by[4].fingerprint == "0" * 640
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert by[1].near_next == 1.0 and by[3].near_edited == 1.0


def test_empty_and_single(spark, empty_docs):
    assert ms.edited_fingerprints(empty_docs).count() == 0
    one = ms.edited_fingerprints(empty_docs.sparkSession.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in one] == [(3, 6, hashlib.sha256(b"abcabc").hexdigest())] and one[0].near_next == 1.0


def vectors(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("other", F.lit(""))
    return {r.id: r for r in ms.fingerprint_pairs(frame, ["id"], "text", "other").collect()}


def test_order_of_paragraphs_and_incremental_change(spark):
    a, b, c = "first paragraph of words here", "second one, rather longer than the first", "third"
    found = vectors(spark, f"{a}\n{b}\n{c}", f"{c}\n{a}\n{b}", f"{a}\n{c}", b, f"{a}\n{b}\n{b}\n{c}")
    assert found[0].text_equal == found[1].text_equal and found[0].text_like == found[1].text_like
    assert found[0].text_equal != found[4].text_equal
    for name in ("text_equal", "text_like"):
        pair = spark.createDataFrame([(found[2][name], found[3][name], found[0][name])], "x array<long>, y array<long>, z array<long>")
        row = pair.select(ms.add_vectors(F.col("x"), F.col("y")).alias("sum"), ms.subtract_vectors(F.col("z"), F.col("y")).alias("less")).first()
        assert row["sum"] == found[0][name] and row["less"] == found[2][name]


def test_equality_vector_is_the_sum_of_digests(spark):
    text = "one\ntwo\n\none"
    want = [sum(int(hashlib.sha512(p.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for p in text.split("\n")) % 2**32 for i in range(16)]
    assert vectors(spark, text)[0].text_equal == want


def test_likeness_follows_shared_text(spark):
    words = [f"word{i}" for i in range(900)]
    whole = "\n".join(" ".join(words[i : i + 30]) for i in range(0, 900, 30))
    half = "\n".join([*whole.split("\n")[:15], *(" ".join(f"other{i + j}" for j in range(30)) for i in range(0, 450, 30))])
    found = vectors(spark, whole, half, "nothing of it\nat all in here " * 9)
    frame = spark.createDataFrame([(found[0].text_like, found[1].text_like, found[2].text_like)], "a array<long>, b array<long>, c array<long>")
    same, near, far = frame.select(ms.likeness(F.col("a"), F.col("a")), ms.likeness(F.col("a"), F.col("b")), ms.likeness(F.col("a"), F.col("c"))).first()
    assert same == 1.0 and 0.25 < near < 0.75 and far < 0.3


def test_range_buckets(spark):
    ids = spark.createDataFrame([(i * i,) for i in range(500)] + [(None,)], "id long")
    ranges = ms.RangeBuckets(ids, "id", 23)
    rows = ids.select("id", ranges.column().alias("b"), ranges.is_first().alias("f")).collect()
    known = sorted((r for r in rows if r.id is not None), key=lambda r: r.id)
    assert [r.b for r in known] == sorted(r.b for r in known) and len({r.b for r in known}) > 15
    assert sorted(r.id for r in known if r.f) == sorted(min(r.id for r in known if r.b == b) for b in {r.b for r in known} - {0})


def test_query(spark):
    rows = op8_document_fingerprints(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == edits(docs)
    texts = {}
    for r in rows:
        texts.setdefault(dict(docs)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in texts.values()) and len(set.union(*texts.values())) == len(texts)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
