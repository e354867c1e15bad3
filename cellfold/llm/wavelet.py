"""Token ids of a shard of documents as a wavelet matrix in one compressed file.

Plane by plane from the highest bit, the matrix keeps each id's bit and then moves
ids with a 0 before ids with a 1 (Claude and Navarro, 2012). Planes are packed and
compressed in blocks; a directory holds each block's place and the ones before it,
so that access, counting and occurrence lookup decompress one block per plane, and
reading a whole shard back undoes the planes from the lowest bit.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.multiset import RangeBuckets
from cellfold.llm.shared import bounded_batches, cut, fresh_dir, open_fs, partitions

MAGIC = b"CFWM1\n"
#: Bits of a block; ids after which a shard is closed; rows in a range of ids.
BLOCK_BITS, SHARD_IDS = 1 << 16, 1 << 21
#: Bytes of text encoded at a time; of distinct parts and their ids that a process remembers.
SLICE_BYTES, REMEMBERED_BYTES = 16 << 20, 48 << 20


# ---------------------------------------------------------------------- format
def write_shard(out: BinaryIO, ids: np.ndarray, doc_ids: list, sizes: np.ndarray) -> int:
    """Write one shard; returns its bytes."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    body, offsets, ones, zeros = [], [], [], []
    at, current = 0, ids
    for level in range(levels - 1, -1, -1):
        bit = current & current.dtype.type(1 << level) != 0
        packed = np.packbits(bit, bitorder="little")
        total = 0
        for i in range(0, len(packed), BLOCK_BITS // 8):
            block = packed[i : i + BLOCK_BITS // 8]
            data = pack(block.tobytes())
            offsets.append(at)
            ones.append(total)
            body.append(data)
            at += len(data)
            total += int(np.bitwise_count(block).sum())
        zeros.append(len(ids) - total)
        current = np.concatenate((current[~bit], current[bit]))
    docs = pack(json.dumps(doc_ids).encode())
    directory = pack(np.array([*offsets, at], "<u8").tobytes() + np.array(ones, "<u8").tobytes() + np.asarray(sizes, "<u8").tobytes())
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "blocks": len(ones), "documents": len(sizes), "docs": len(docs), "directory": len(directory), "block_bits": BLOCK_BITS}).encode()
    data = b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, directory, *body])
    out.write(data)
    return len(data)


class Shard:
    """A shard read from its bytes: planes stay compressed until a block is asked for."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", data[at - 4 : at])[0]
        head = json.loads(data[at : at + size])
        at += size
        self.n, self.levels, self.zeros, self.bits = head["n"], head["levels"], head["zeros"], head["block_bits"]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = json.loads(self._unpack(data[at : at + head["docs"]]))
        at += head["docs"]
        table = np.frombuffer(self._unpack(data[at : at + head["directory"]]), "<u8").astype(np.int64)
        at += head["directory"]
        self._offsets, self._ones = table[: head["blocks"] + 1], table[head["blocks"] + 1 : 2 * head["blocks"] + 1]
        self.sizes = table[2 * head["blocks"] + 1 :]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._body, self._per_level = memoryview(data)[at:], -(-self.n // self.bits)
        self._block = lru_cache(maxsize=64)(self._load)

    def _load(self, block: int) -> np.ndarray:
        raw = self._unpack(bytes(self._body[self._offsets[block] : self._offsets[block + 1]]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level * self._per_level + i // self.bits)[i % self.bits])

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i == 0:
            return 0
        block = level * self._per_level + (i - 1) // self.bits
        return int(self._ones[block]) + int(self._block(block)[: (i - 1) % self.bits + 1].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) such bit of a plane."""
        first = level * self._per_level
        ones = self._ones[first : first + self._per_level]
        before = ones if bit else np.arange(self._per_level) * self.bits - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        found = np.flatnonzero(self._block(first + block)[: self.n - block * self.bits] == bit)
        return block * self.bits + int(found[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in places ``low`` up to before ``high``."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            blocks = [self._load(level * self._per_level + b) for b in range(self._per_level)]
            bit = np.concatenate([*blocks, np.zeros(0, np.uint8)])[: self.n] != 0
            above, z = np.empty_like(values), self.zeros[level]
            above[~bit] = values[:z]
            above[bit] = values[z:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = above
        return values.astype(np.uint32)


# ------------------------------------------------------------------- tokenizer
#: How a vocabulary must prepare texts to be applied to their parts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


class PartEncoder:
    """A tokenizers-library vocabulary applied to the white-space-separated parts of texts.

    This suits vocabularies that drop white space and case (``NORMALIZER``, ``SPLIT``): no
    token spans white space, so equal parts have equal ids, and each distinct part of a
    slice of texts is encoded once, and not again while ``REMEMBERED_BYTES`` hold it. Any other vocabulary is applied to whole texts.
    Parts of letters go to the library many at a time; tokens that end a word tell
    them apart; those of a-z only pass the normalizer and the splits unchanged, so the library gets them
    without either. Others are set apart by a control character that has a token of its own;
    those that hold it, or the mark of a special token, go one at a time.
    """

    MARK, SPECIAL = "\x01", "<|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # distinct parts gain nothing from the library's cache of parts
            model._resize_cache(0)
            self.tokenizer.model = model
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        facts = json.loads(self.tokenizer.to_str())
        suffix = facts["model"].get("end_of_word_suffix")
        before = (facts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_parts = (facts["normalizer"] or {}).get("normalizers") == NORMALIZER and len(before) == 2 and before[0] == SPLIT and BYTES.items() <= before[1].items()
        self.plain = Tokenizer(model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _recall(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each part) of distinct parts; only new ones are encoded."""
        at = pc.index_in(parts, value_set=self.known[0])
        fresh = parts.filter(pc.is_null(at))
        known, flat, sizes = self.known
        if len(fresh):
            ids, n = self._encode_distinct(fresh)
            pick = np.asarray(at.fill_null(0)).astype(np.int64)
            pick[np.asarray(pc.is_null(at))] = len(known) + np.arange(len(fresh))
            known, flat, sizes = pa.concat_arrays([known, fresh]), np.concatenate((flat, ids)), np.concatenate((sizes, n))
        else:
            pick = np.asarray(at)
        if known.nbytes + flat.nbytes + sizes.nbytes <= REMEMBERED_BYTES:
            self.known = known, flat, sizes
        else:
            self._forget()
        return gather(flat, sizes, pick)

    def _run(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._cut(parts, self.plain.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids)

    def _letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._cut(parts, self._run([" ".join(parts)])[0].ids)

    def _cut(self, parts: list[str], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(ids, np.uint32)
        last = np.flatnonzero(self.closing[ids])
        if len(last) != len(parts):  # lower case or composition cut a part in two
            return self._marked(parts)
        return ids, np.diff(last, prepend=-1)

    def _marked(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self._run([f" {self.MARK} ".join(parts)])[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        if self.mark is None or len(at) != len(parts) - 1:
            return self._single(parts)
        return np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1

    def _single(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._run(parts)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encode_distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each part)."""
        special = pc.or_(pc.match_substring(parts, self.SPECIAL), pc.match_substring(parts, self.MARK))
        letters = np.where(np.asarray(pc.match_substring_regex(parts, "^[a-z]+$")), 0, np.where(np.asarray(pc.utf8_is_alpha(parts)), 1, 2))
        kind = np.where(np.asarray(special), 3, letters)
        order = np.argsort(kind, kind="stable")
        flat, sizes, grouped, bounds = [], [], parts.take(pa.array(order)), np.searchsorted(kind[order], [0, 1, 2, 3, 4])
        for k, run in enumerate((self._plain, self._letters, self._marked, self._single)):
            for i in range(bounds[k], bounds[k + 1], 1024):
                ids, n = run(grouped.slice(i, min(1024, bounds[k + 1] - i)).to_pylist())
                flat.append(ids)
                sizes.append(n)
        sizes = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return gather(np.concatenate([*flat, np.zeros(0, np.uint32)]), sizes, back)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). Null texts have none."""
        if not self.by_parts:
            return self._single(pc.fill_null(texts.cast(pa.string()), "").to_pylist())
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        offsets = np.asarray(words.offsets).astype(np.int64)
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        distinct = coded.dictionary
        # ASCII case is dropped by the vocabulary, and closing marks after a letter or digit are tokens apart.
        plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, self.SPECIAL)))
        lower = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        closed = pc.and_(plain, pc.match_substring_regex(lower, r"[0-9a-z][.,;:!?]+$"))
        core = pc.if_else(closed, pc.ascii_rtrim(lower, ".,;:!?"), lower)
        tail = pc.if_else(closed, pc.replace_substring_regex(lower, r"^.*[0-9a-z]", ""), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids, sizes = self._recall(both.dictionary)
        n, pick = len(distinct), np.asarray(both.indices)
        ids, sizes = gather(ids, sizes, np.stack((pick[:n], pick[n:]), axis=1).ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        ids, each = gather(ids, sizes, np.asarray(coded.indices))
        bounds = np.concatenate(([0], np.cumsum(each)))[offsets - offsets[0]]
        return ids, np.diff(bounds)


def gather(flat: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` of these sizes, put one after another in the order of ``pick``, and their sizes."""
    starts, each = (np.cumsum(sizes) - sizes)[pick], sizes[pick]
    ends = np.cumsum(each)
    return flat[np.repeat(starts - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)], each


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Parts of a batch whose texts have about ``limit`` bytes; at least one row each."""
    ends = np.asarray(pc.cumulative_sum(pc.binary_length(batch.column(column)).fill_null(0).cast(pa.int64())))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=2)
def part_encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


# -------------------------------------------------------------------- operator
def write_token_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, ranges: int | None = None) -> DataFrame:
    """Encode whole texts and write shards in ascending order of ids; returns their table.

    The table has (bucket, part, path, documents, ids, start): shards in order of
    (bucket, part), and the ids of all shards before each. Documents of equal ids are
    in order of their texts; null ids come first; null texts count as empty. Every
    document ends with ``end_id``. An empty table writes nothing; other columns are ignored,
    whatever their names. All documents of one id are in one range.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    bucket = RangeBuckets(rows, "id", ranges or 4 * partitions(spark)).column()
    dealt = rows.select(bucket.alias("bucket"), "id", "text").repartition(partitions(spark), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", F.asc_nulls_first("id"), "text")

    def write(batches):
        encoder, (fs, where), task = part_encoder(path), open_fs(folder), TaskContext.get()
        state = {"bucket": None, "part": 0, "size": 0}
        held, done = [], []

        def flush() -> None:
            if not held:
                return
            name = f"ids-{state['bucket']:06d}-{state['part']:06d}-{task.taskAttemptId()}.wm"
            fs.create_dir(where, recursive=True)
            doc_ids, ids, sizes = ([x[k] for x in held] for k in range(3))
            sizes = np.concatenate(sizes)
            with fs.open_output_stream(f"{where}/{name}") as out:
                write_shard(out, np.concatenate(ids), [d for ds in doc_ids for d in ds], sizes)
            done.append((state["bucket"], state["part"], f"{folder}/{name}", len(sizes), int(sizes.sum())))
            held.clear()
            state["part"] += 1
            state["size"] = 0

        for batch in batches:
            for piece in slices(batch, 2):
                ids, sizes = encoder.encode(piece.column(2))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                ends = np.cumsum(sizes + 1)
                bucket, doc_ids, start = np.asarray(piece.column(0)), piece.column(1).to_pylist(), 0
                while start < len(ends):
                    if bucket[start] != state["bucket"]:
                        flush()
                        state |= {"bucket": int(bucket[start]), "part": 0}
                    before = ends[start - 1] if start else 0
                    stop = int(np.searchsorted(bucket, bucket[start], "right"))
                    stop = min(stop, int(np.searchsorted(ends, before + shard_ids - state["size"])) + 1)
                    held.append((doc_ids[start:stop], ids[before : ends[stop - 1]], sizes[start:stop] + 1))
                    state["size"] += int(ends[stop - 1] - before)
                    if state["size"] >= shard_ids:
                        flush()
                    start = stop
        flush()
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "part", "path", "documents", "ids"])

    # Cut at once: the table then names files that exist, and nothing is written twice.
    shards = cut(dealt.mapInArrow(write, "bucket int, part int, path string, documents long, ids long"))
    # A running sum over the ranges, whose number is a parameter, and one within each range.
    former = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges_before = shards.groupBy("bucket").agg(F.sum("ids").alias("n")).select("bucket", F.coalesce(F.sum("n").over(former), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    started = shards.withColumn("own", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(ranges_before, "bucket")
    return started.select(*shards.columns, (F.col("before") + F.col("own")).alias("start"))


def read_token_shards(shards: DataFrame, arrays: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from its shard.

    With ``arrays`` the ids follow as array<long>.
    """

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = open_fs(path)
                with fs.open_input_stream(where) as stream:
                    shard = Shard(stream.read())
                ids = shard.ids().astype("<u4")
                crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts + start), pa.array(shard.sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if arrays:
                    offsets = np.append(shard.starts, shard.n).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = shards.select("path", "start").repartition(partitions(shards.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays)


def token_shards(spark: SparkSession, docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write shards in the shared folder and read every document back from them."""
    return read_token_shards(write_token_shards(docs, folder or fresh_dir(spark, "token-ids"), path, **options))
