"""Ranked lexical search over a two-level quantised index.

An index is a table of segments, each some documents with their own sorted terms and
postings. A posting has two levels: a byte, its impact over ``STEP`` rounded up, and what
that rounding added, so that both together give the exact integer impact.

A search reads the bytes first. They bound each document's score from both sides: the
k-th largest lower bound of an item, over all segments, is a score that k documents
reach, so that a document whose upper bound is below it can't be among the first k. Every
other document is scored again with exact integers. Nothing else is left out.

Segments are independent rows: no posting is ever shuffled, and a hot term is spread over all of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellfold.llm.shared import bounded_batches, fresh_dir

#: A term, for the JVM: a run of characters that are ASCII letters or digits or no ASCII at all.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes of UTF-8, where all bytes of other characters are over 0x7F: A-Z lower-cased, the rest of ASCII blank.
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
#: Impacts are below this.
IMPACT = 10**6
#: Impacts of one byte.
STEP = -(-IMPACT // 255)
#: Terms, with repeats, from which a segment is full.
SEGMENT_TERMS = 1 << 20
#: Bytes of text that are split into terms at a time.
SLICE = 1 << 20
#: Bytes of the items' texts that are searched for in one pass.
BLOCK_BYTES = 8 << 20
#: Bytes of a row group of an index, which a task decodes at a time.
GROUP_BYTES = 16 << 20


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in slices of bounded size."""
    at, text = 0, text or b""
    while at < len(text):
        end = at + SLICE
        while end < len(text) and BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(BYTES).split()
        at = end


class Segment:
    """Documents that are made into one row of the index."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.found, self.of, self.lengths, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        size = 0
        for part in terms_of(text):
            self.found.append(np.fromiter(map(self.known.__getitem__, part), np.int32, len(part)))
            self.of.append(np.full(len(part), len(self.ids), np.int32))
            size += len(part)
        if size:
            self.ids.append(doc_id)
            self.lengths.append(size)
            self.size += size

    def row(self) -> dict:
        words = sorted(self.known)
        rank = np.empty(len(words), np.int64)
        rank[[self.known[w] for w in words]] = np.arange(len(words))
        n = len(self.ids)
        keys, tf = np.unique(rank[np.concatenate(self.found)] * n + np.concatenate(self.of), return_counts=True)
        docs = keys % n
        norm = np.array([10 + 90 * x * self.documents // self.terms for x in self.lengths])
        impact = 10**9 * tf // (1000 * tf + 8 * norm[docs])
        coarse = -(-impact // STEP)
        starts = np.searchsorted(keys, np.arange(len(words) + 1) * n)
        return {
            "doc_ids": self.ids, "terms": b" ".join(words), "starts": starts.astype(np.uint32).tobytes(), "docs": docs.astype(np.uint32).tobytes(),
            "coarse": coarse.astype(np.uint8).tobytes(), "fine": (coarse * STEP - impact).astype(np.uint16).tobytes(),
        }


SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "starts", "docs", "coarse", "fine"))])


@dataclass(frozen=True)
class LexicalIndex:
    """A written index: its folder, documents with at least one term, and all their terms with repeats."""

    spark: SparkSession
    path: str
    documents: int
    terms: int

    def segments(self, *columns: str) -> DataFrame:
        return self.spark.read.schema("doc_ids array<long>, terms binary, starts binary, docs binary, coarse binary, fine binary").parquet(self.path).select(*columns)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, segment_terms: int = SEGMENT_TERMS) -> LexicalIndex:
    """Index every whole text; the ids are longs.

    Texts without a term, null and empty ones included, are in no segment and count
    nowhere. Rows that repeat an id are documents of their own, and so are rows with a null
    id. A text of any length is in one segment. An empty table gives an index without segments.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or fresh_dir(spark, "lexical")
    text = F.col(f"`{text_col}`").cast("string")
    each = docs.select(F.regexp_count(text, F.lit(TERM)).cast("long").alias("n"))
    documents, terms = each.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches):
        segment = Segment(documents, terms)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment.add(doc_id, data.as_py())
                if segment.size >= segment_terms:
                    yield pa.RecordBatch.from_pylist([segment.row()], SCHEMA)
                    segment = Segment(documents, terms)
        if segment.size:
            yield pa.RecordBatch.from_pylist([segment.row()], SCHEMA)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.cast("binary").alias("text"))
    made = rows.mapInArrow(run, "doc_ids array<long>, terms binary, starts binary, docs binary, coarse binary, fine binary")
    made.write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(path)
    return LexicalIndex(spark, path, documents, terms)


class Opened:
    """A segment's row with the terms of a search found in it; ``wanted`` numbers them."""

    def __init__(self, row: dict, wanted: list[bytes]):
        self.row = row
        words = row["terms"].split(b" ")
        at = dict(zip(words, range(len(words)), strict=True))
        self.at = {k: at[w] for k, w in enumerate(wanted) if w in at}
        self.starts = np.frombuffer(row["starts"], np.uint32)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def df(self, k: int) -> int:
        return int(self.starts[self.at[k] + 1] - self.starts[self.at[k]])

    def part(self, name: str, kind: type, k: int) -> np.ndarray:
        start, end = self.starts[self.at[k]], self.starts[self.at[k] + 1]
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.row[name], kind, int(end - start), int(start) * size)

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and coarse impacts of term ``k``."""
        if k not in self.held:
            self.held[k] = self.part("docs", np.uint32, k), self.part("coarse", np.uint8, k).astype(np.int64)
        return self.held[k]

    def bounds(self, terms: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each document's score: an impact of byte c > 0 is over (c - 1) * STEP, up to c * STEP."""
        low, high = np.zeros((2, len(self.row["doc_ids"])), np.int64)
        for k in terms:
            if k in self.at and weights[k]:
                docs, coarse = self.postings(k)
                high[docs] += weights[k] * STEP * coarse
                low[docs] += weights[k] * np.maximum(coarse * STEP - (STEP - 1), 0)
        return low, high

    def exact(self, terms: list[int], weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The exact scores of ``chosen`` documents (a mask over all of the segment)."""
        score = np.zeros(len(chosen), np.int64)
        for k in terms:
            if k in self.at and weights[k]:
                docs, coarse = self.postings(k)
                mine = chosen[docs]
                score[docs[mine]] += weights[k] * (coarse[mine] * STEP - self.part("fine", np.uint16, k)[mine])
        return score[chosen]


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    return values if len(values) <= k else np.partition(values, len(values) - k)[len(values) - k :]


def _first(frame: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, ranked; each task first keeps its own first ``k``."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _search(index: LexicalIndex, asked: list[tuple], k: int) -> DataFrame:
    """Ranked documents of a block of (item_id, text)."""
    sets = [set().union(*terms_of(text)) for _, text in asked]
    wanted = sorted(set().union(*sets))
    number = {w: i for i, w in enumerate(wanted)}
    items = [sorted(number[w] for w in s) for s in sets]
    item_ids = [i for i, _ in asked]

    def opened(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield Opened(batch.slice(i, 1).to_pylist()[0], wanted)

    def count(batches):
        df = np.zeros(len(wanted), np.int64)
        for segment in opened(batches):
            for t in segment.at:
                df[t] += segment.df(t)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    df = np.zeros(len(wanted), np.int64)
    for row in index.segments("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def reach(batches):
        best = [np.zeros(0, np.int64)] * len(items)
        for segment in opened(batches):
            for i, terms in enumerate(items):
                low = segment.bounds(terms, weights)[0]
                best[i] = _largest(np.concatenate([best[i], low[low > 0]]), k)
        of = np.repeat(np.arange(len(items)), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([*best, np.zeros(0, np.int64)]))], names=["item", "low"])

    # Each task gives at most k lower bounds of an item, so that these stay few.
    lows = index.segments("doc_ids", "terms", "starts", "docs", "coarse").mapInArrow(reach, "item long, low long")
    least = np.ones(len(items), np.int64)
    for row in _first(lows, ["item"], [F.desc("low")], k).where(F.col("rank") == k).collect():
        least[row.item] = row.low

    def rescore(batches):
        for segment in opened(batches):
            ids = segment.row["doc_ids"]
            out = []
            for i, terms in enumerate(items):
                chosen = segment.bounds(terms, weights)[1] >= least[i]
                scores = segment.exact(terms, weights, chosen).tolist()
                found = sorted(((-s, ids[d] is None, ids[d] or 0) for s, d in zip(scores, np.flatnonzero(chosen).tolist(), strict=True) if s > 0))[:k]
                out += [(i, item_ids[i], None if null else d, -s) for s, null, d in found]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "item_id", "doc_id", "score"), x, strict=True)) for x in out], pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    scored = index.segments("doc_ids", "terms", "starts", "docs", "coarse", "fine").mapInArrow(rescore, "item long, item_id long, doc_id long, score long")
    return _first(scored, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k).select("item_id", "rank", "doc_id", "score")


def search(index: LexicalIndex, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of each row of ``items``: item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores are in the order of doc_id, null last. Items
    go through the index in blocks of bounded size. Items without a term that some
    document has give no row; rows of ``items`` that repeat an id are ranked each for
    itself. No items or no documents give an empty result. Other columns play no part.
    """
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    if not index.documents or not blocks:
        return index.spark.range(0).selectExpr("id as item_id", "0 as rank", "id as doc_id", "id as score")
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_search(index, [tuple(r) for r in asked.where(of == b).collect()], k) for b in range(blocks)])
