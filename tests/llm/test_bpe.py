import hashlib
import random
import time

import numpy as np
import pytest

import cellfold.llm.bpe as bpe
from cellfold.llm.queries import op2_byte_bpe, pattern, vocabulary

from tests.conftest import SF

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    own = bpe.load(vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return own, tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=own.ranks, special_tokens={})


def texts(n=300):
    rng = random.Random(2)
    return ["".join(rng.choice("abcdeé 日本\n\t 1234ñ😀'sll!--") for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_like_the_library(pair):
    own, library = pair
    many = [*texts(), "a" * 3000, "\n" * 500, "<|endoftext|>", " " * 300 + "b", "", None]
    for ids, text in zip(own.encode_batch(many), many, strict=True):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert own.decode(ids) == (text or "").encode()


def test_long_text_in_slices(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "SLICE", 400)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    text = " ".join(texts(40))
    assert own.encode_batch([text, "x", text])[2].tolist() == library.encode_ordinary(text)


def test_long_pieces(pair):
    """Single pieces around the row width and beyond, and one of a megabyte in bounded time."""
    own, library = pair
    rng = random.Random(4)
    pieces = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "日本語é") for n in (1023, 1024, 1025, 2049, 5000)]
    pieces += ["a" * 4000, "=" * 3001, "\n" * 2500]
    for ids, text in zip(own.encode_batch(pieces), pieces, strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    start, whole = time.perf_counter(), "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert own.decode(own.encode_batch([whole])[0]) == whole.encode() and time.perf_counter() - start < 120


def test_pair_table():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 50_000, (2, 5000))
    keys = np.unique(left << 32 | right)
    table = bpe.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.get(keys >> 32, keys & 0xFFFFFFFF) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 50, 5000), keys)
    assert (table.get(other >> 32, other & 0xFFFFFFFF) == bpe.NONE).all()


def test_odd_rows(odd_docs, empty_docs, pair):
    path, pat = vocabulary("byte_bpe_50k.tiktoken"), pattern()
    rows = bpe.bpe_encode(odd_docs, path, pat, decoded_col="decoded").collect()
    assert len(rows) == odd_docs.count()
    whole = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.ids == pair[1].encode_ordinary(whole[r.doc_id] or "") and bytes(r.decoded) == (whole[r.doc_id] or "").encode() for r in rows)
    assert bpe.bpe_encode(empty_docs, path, pat).count() == 0
    with pytest.raises(ValueError, match="fp"):
        bpe.bpe_encode(odd_docs, path, pat, ids_col="fp")
    with pytest.raises(ValueError, match="fp"):
        bpe.bpe_decode(bpe.bpe_encode(odd_docs, path, pat), path, pat, decoded_col="fp")
    nulls = bpe.bpe_encode(odd_docs.limit(1), path, pat).selectExpr("doc_id", "cast(null as array<int>) ids")
    assert [bytes(r.decoded) for r in bpe.bpe_decode(nulls, path, pat).collect()] == [b""]
    assert bpe.bpe_decode(bpe.bpe_encode(empty_docs, path, pat), path, pat).count() == 0
    again = bpe.bpe_decode(bpe.bpe_encode(odd_docs, path, pat), path, pat).collect()
    assert all(bytes(r.decoded) == (whole[r.doc_id] or "").encode() for r in again)


def test_query(spark, pair):
    rows = op2_byte_bpe(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = pair[1].encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("given, kept", [("64m", 8 << 20), ("1g", 8 << 20), ("4m", 4 << 20), ("1000000", 1_000_000), ("8388608b", 8 << 20)])
def test_arrow_bound_reads_units(spark, given, kept):
    from cellfold.llm.shared import bounded_batches, size_of

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, given)
        bounded_batches(spark)
        assert size_of(spark, spark.conf.get(name)) == kept
    finally:
        spark.conf.set(name, before)


def test_memory_of_distinct_pieces():
    """Many distinct pieces are encoded and remembered in bounded memory: about 100 bytes each, and some 15 MB on the way."""
    import tracemalloc

    own, rng = bpe.load(vocabulary("byte_bpe_50k.tiktoken"), pattern()), random.Random(6)
    own.known.clear()
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(60_000))
    pieces = own.pattern.findall(text)
    tracemalloc.start()
    try:
        own._remember(set(pieces))
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(own.known) > 59_000 and held < 110 * len(own.known) and peak - held < 20 << 20
