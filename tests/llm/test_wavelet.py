import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

import cellfold.llm.wavelet as wave
from cellfold.llm.queries import op7_token_shards, vocabulary
from cellfold.llm.shared import fresh_dir

from tests.conftest import SF

tokenizers = pytest.importorskip("tokenizers")


def shard(ids, sizes=None):
    out = io.BytesIO()
    wave.write_shard(out, np.asarray(ids, np.uint32), [1], np.array([len(ids)] if sizes is None else sizes))
    return wave.Shard(out.getvalue())


@pytest.mark.parametrize("n,top,bits", [(0, 5, 64), (1, 1, 64), (1, 0, 64), (257, 3, 64), (3000, 50_000, 64), (3000, 2**31, 4096), (70_000, 40, 1 << 16)])
def test_lookups(monkeypatch, n, top, bits):
    monkeypatch.setattr(wave, "BLOCK_BITS", bits)
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    s = shard(ids)
    assert (s.ids() == ids).all()
    rng = random.Random(1)
    for i in (rng.randrange(n) for _ in range(20 if n else 0)):
        token, low, high = int(ids[i]), *sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        places = np.flatnonzero(ids == token)
        assert s.access(i) == token
        assert s.count(token) == len(places) and s.count(token, low, high) == ((places >= low) & (places < high)).sum()
        k = rng.randrange(len(places))
        assert s.occurrence(token, k) == places[k]
        with pytest.raises(IndexError):
            s.occurrence(token, len(places))
    assert s.count(1 << 40) == 0
    with pytest.raises(IndexError):
        s.access(n)


def test_not_a_shard():
    with pytest.raises(ValueError):
        wave.Shard(b"something else")


@pytest.fixture(scope="module")
def encoder():
    return wave.PartEncoder(vocabulary("word_bpe_49k.json"))


def library(encoder, texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_like_the_library(encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcéÉΣσ 日本\n\t \x1f\x85 12Ñ😀<|endoftext|>'s'll!!--.,;:»«\x01Iİ̇K") for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += ["", None, "<|endoftext|>a <|ENDOFTEXT|>, X. don't. 'S ...", "a." * 400, "word " * 5000]
    ids, sizes = encoder.encode(pa.array(texts))
    want = library(encoder, texts)
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_slices_of_a_batch(encoder):
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], names=["t"])
    parts = list(wave.slices(batch, 0, 10))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert sum(encoder.encode(p.column(0))[1].sum() for p in parts) == encoder.encode(batch.column(0))[1].sum()


@pytest.mark.parametrize("limit", [wave.REMEMBERED_BYTES, 1000, 0])
def test_known_parts_are_not_encoded_again(monkeypatch, limit):
    """Ids are the same whatever is remembered, and the library is asked for new parts only."""
    monkeypatch.setattr(wave, "REMEMBERED_BYTES", limit)
    own, asked, rng = wave.PartEncoder(vocabulary("word_bpe_49k.json")), [], random.Random(8)
    whole = own._encode_distinct
    monkeypatch.setattr(own, "_encode_distinct", lambda parts: asked.extend(parts.to_pylist()) or whole(parts))
    slices = [[" ".join(rng.choice(["One", "two,", "3rd!", "é", "<|endoftext|>", f"w{rng.randrange(60)}"]) for _ in range(30)) for _ in range(10)] + ["", None] for _ in range(6)]
    for texts in (*slices, slices[0]):
        ids, sizes = own.encode(pa.array(texts))
        want = library(own, texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    before = len(asked)
    own.encode(pa.array(slices[0]))
    assert (len(asked) > before) == (limit < wave.SLICE_BYTES)


def test_parts_of_plain_letters(encoder):
    """Parts of a-z alone, beside parts that hold a line's end or other letters, give the library's ids."""
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["a", "x" * 500, "é", "ß", "ok\u00a0no", "aé"]
    ids, sizes = encoder.encode(pa.array(parts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(encoder, parts)


def expected(encoder, rows):
    """Documents in order: (id, start, size, crc)."""
    out, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, _), ids in zip(ordered, library(encoder, [t for _, t in ordered])):
        ids = [*ids, 1]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("limit", [1 << 21, 20])
def test_odd_rows(spark, encoder, odd_docs, limit):
    found = wave.token_shards(spark, odd_docs, vocabulary("word_bpe_49k.json"), shard_ids=limit)
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()]
    want = expected(encoder, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(rows, key=lambda r: r[1]) == want


def test_arrays_and_table(spark, encoder, odd_docs):
    shards = wave.write_token_shards(odd_docs, fresh_dir(spark, "ids"), vocabulary("word_bpe_49k.json"), end_id=7)
    rows = wave.read_token_shards(shards, arrays=True).collect()
    assert sum(r.ids for r in shards.collect()) == sum(r.n_tokens for r in rows) and all(r.ids[-1] == 7 and len(r.ids) == r.n_tokens for r in rows)


def test_empty_table(spark, empty_docs):
    assert wave.token_shards(spark, empty_docs, vocabulary("word_bpe_49k.json")).count() == 0


def test_query(spark, encoder):
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op7_token_shards(spark, SF).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [(i, s, n, c) for s, i, n, c in rows] == expected(encoder, docs)


def test_other_vocabularies_are_applied_to_whole_texts(encoder):
    """A vocabulary that keeps case and blanks isn't cut at blanks."""
    path = vocabulary("byte_bpe_50k.json")
    own, texts = wave.PartEncoder(path), ["Hello  World, again", None, "", " x\n\ny ", "Ünï 日本"]
    assert encoder.by_parts and not own.by_parts
    ids, sizes = own.encode(pa.array(texts))
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_starts_follow_ranges_and_parts(spark):
    docs = spark.createDataFrame([(i, f"word{i} here", "x", 1) for i in range(300)], "doc_id long, text string, bucket string, start int")
    rows = wave.token_shards(spark, docs, vocabulary("word_bpe_49k.json"), shard_ids=40, ranges=7).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(300)) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(300)]
