"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut by the vocabulary's pattern; each distinct piece of a slice of texts
is encoded once. Pieces of like length share a matrix of token ids, one piece per
column. In each round every piece merges its leftmost pair of minimum rank: the
pair's rank comes from an open-addressing hash table, the merged id takes the
pair's place, and the cells after it move up by one. Finished pieces leave.

A piece of more than ``LONG`` bytes is a matrix of its own, cut into rows of ``LONG``
cells: the rows' minima tell the leftmost pair of minimum rank, merged cells die in
place, and a round touches the rows of its neighbours only.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import bounded_batches, released, unused

NONE = np.int32(np.iinfo(np.int32).max)
#: Cells of a piece matrix, characters of text per slice, pieces remembered.
CELLS, SLICE, REMEMBERED = 1 << 18, 1 << 20, 200_000
#: Bytes of a piece that is still merged beside others.
LONG = 1024


class PairTable:
    """Open addressing from (left id, right id) to the merged id; ``NONE`` where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]] = keys[todo[placed]]
            self.values[at[placed]] = values[todo[placed]]
            todo = np.delete(todo, placed)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] >= 0)) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = NONE
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class ByteBpe:
    """A vocabulary of byte strings by rank, with its pattern; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable((left << 32) | right, merged.astype(np.int32))
        self.merges = left, right, merged
        # Ids of a piece as the bytes of 32-bit numbers, a third of what a tuple takes.
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str):
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= SLICE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, SLICE // 8)):
            yield part

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't remembered yet."""
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        rest = []
        for i, data in enumerate(raw):
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[new[i]] = np.int32(whole).tobytes()
            elif len(data) > LONG:
                self.known[new[i]] = self._merge_long(data)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(raw[i]))
        start = 0
        while start < len(rest):
            # A bucket's longest piece has at most a quarter more bytes than its shortest.
            longest, stop = len(raw[rest[start]]) * 5 // 4 + 1, start
            while stop < len(rest) and len(raw[rest[stop]]) <= longest and (stop == start or (stop - start) * longest < CELLS):
                stop += 1
            for i, ids in zip(rest[start:stop], self._merge([raw[i] for i in rest[start:stop]]), strict=True):
                self.known[new[i]] = ids
            start = stop

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.ascontiguousarray(self.of_byte[flat].T)
        inside = np.arange(1, width)[:, None] < lengths[None, :]
        rank = np.full((width - 1, n), NONE, np.int32)
        rank[inside] = self.pairs.get(ids[:-1][inside], ids[1:][inside])
        at, out = np.arange(n), [b""] * n
        while len(at):
            col = np.arange(len(at))
            pos = rank.argmin(0) if len(rank) else np.zeros(len(at), np.int64)
            best = rank[pos, col] if len(rank) else np.full(len(at), NONE)
            if (done := best == NONE).any():
                cells, left = np.ascontiguousarray(ids[:, done].T), lengths[done].tolist()
                for i, k in enumerate(at[done].tolist()):
                    out[k] = cells[i, : left[i]].tobytes()
                keep = ~done
                ids, rank, at, lengths, pos, best = ids[:, keep], rank[:, keep], at[keep], lengths[keep], pos[keep], best[keep]
                if not len(at):
                    break
                col = np.arange(len(at))
            rows = np.arange(len(ids) - 1)[:, None] <= pos[None, :]
            ids = np.where(rows, ids[:-1], ids[1:])
            ids[pos, col] = best
            rank = np.where(rows[:-1], rank[:-1], rank[1:])
            lengths = lengths - 1
            near = pos < lengths - 1
            if len(rank):
                rank[pos[near], col[near]] = self.pairs.get(ids[pos[near], col[near]], ids[pos[near] + 1, col[near]])
                last = ~near & (pos < len(rank))
                rank[pos[last], col[last]] = NONE
            near = pos > 0
            rank[pos[near] - 1, col[near]] = self.pairs.get(ids[pos[near] - 1, col[near]], ids[pos[near], col[near]])
        return out

    @cached_property
    def of_pair(self) -> dict[tuple[int, int], int]:
        """The pair table for single pairs, which only long pieces need."""
        left, right, merged = (x.tolist() for x in self.merges)
        return dict(zip(zip(left, right, strict=True), merged, strict=True))

    def _merge_long(self, data: bytes) -> bytes:
        n, of_pair, none = len(data), self.of_pair, int(NONE)
        ids = self.of_byte[np.frombuffer(data, np.uint8)]
        rank = np.full(-(-n // LONG) * LONG, NONE, np.int32)
        rank[: n - 1] = self.pairs.get(ids[:-1], ids[1:])
        rows = rank.reshape(-1, LONG)
        least, ids = rows.min(1), ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            row = int(least.argmin())
            merged = int(least[row])
            if merged == none:
                break
            at = row * LONG + int(rows[row].argmin())
            gone, left = after[at], before[at]
            right = after[gone]
            ids[at], ids[gone], after[at] = merged, -1, right
            rank[gone], rank[at] = none, none
            if right < n:
                before[right] = at
                rank[at] = of_pair.get((merged, ids[right]), none)
            if left >= 0:
                rank[left] = of_pair.get((ids[left], merged), none)
            for k in {row, gone // LONG, max(left, 0) // LONG}:
                least[k] = rows[k].min()
        ids = np.array(ids, np.int32)
        return ids[ids >= 0].tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts; null and empty texts have none."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):
            size, stop = 0, start
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= SLICE):
                size += len(texts[stop] or "")
                stop += 1
            if size > SLICE:
                out.append(np.concatenate([self._ids(part) for part in self.pieces(texts[start])]))
            else:
                cut = [self.pattern.findall(t) if t else [] for t in texts[start:stop]]
                self._remember(set().union(*cut))
                out += [self._join(part) for part in cut]
            start = stop
        return out

    def _remember(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        self._learn(pieces)

    def _join(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        return np.frombuffer(b"".join([known[p] for p in pieces]), np.int32)

    def _ids(self, pieces: list[str]) -> np.ndarray:
        self._remember(set(pieces))
        return self._join(pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return ByteBpe(ranks, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with the ids of each whole text (array<int>).

    With ``decoded_col``, the bytes decoded from those ids follow. ``path`` must be
    readable on the executors. One narrow pass: no shuffle. Null texts count as
    empty and give no ids. Repeated rows stay; an empty table gives an empty
    result; a kept column that has the name of an output column is an error.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    if clash := {ids_col, decoded_col} & set(keep):
        raise ValueError(f"output column {sorted(clash)[0]!r} already exists")

    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = bpe.encode_batch(part.column(len(keep)).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
                columns = [*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = [*keep, ids_col]
                if decoded_col:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    names.append(decoded_col)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(unused(keep, "text")["text"]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{ids_col}` array<int>", *([f"`{decoded_col}` binary"] if decoded_col else [])])
    return rows.mapInArrow(released(run), schema)


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of each id array; null and empty arrays give empty bytes.

    Repeated rows stay and an empty table gives an empty result. A column that has the
    name ``decoded_col`` already is an error, and so is an id that isn't in the vocabulary.
    """
    if decoded_col in rows.columns:
        raise ValueError(f"output column {decoded_col!r} already exists")

    @F.pandas_udf("binary")
    def run(ids):
        bpe = load(path, pattern)
        return ids.map(lambda x: b"" if x is None else bpe.decode(np.asarray(x)))

    return rows.withColumn(decoded_col, run(ids_col))
