"""The prefix trie of conversations, from the Cartesian tree over their sorted sequences.

Distinct sequences of turns are sorted; L[k] is the number of turns that the k-th shares with
the one before. Between its nearest smaller values on both sides, each L[k] spans an
interval of sequences: a trie node of depth L[k], owned by the first of them. Equal values
with the same left neighbour are one node, a sequence's own turns beyond both neighbours
are nodes of their own, and the depths that a node skips over are filled in afterwards.
Counts are differences of running sums over the interval.

In parallel: the sorted sequences lie in blocks. Nearest smaller values within a block close most
nodes there. The others cross its end: the minima of the blocks tell in which block such a
node ends, and a row of that block gives what it holds up to there. A node that spans
thousands of blocks is one addition of running sums over blocks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellfold.llm.shared import bounded_batches, cut, partitions

#: Bytes of a turn's digest, the first of its SHA-256.
DIGEST = 16
#: Turns and sequences of a block at least, and blocks at most besides those that end a partition: the driver holds a few numbers of each.
BLOCK, BLOCKS = 1 << 17, 1 << 15
#: Bytes of joined ids that are hashed at a time.
CHUNK = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(turns: DataFrame, group: int = 100, modulus: int = 6) -> DataFrame:
    """(conv_id, seq, sizes): each conversation with its first turns from that which leads its group.

    ``seq`` holds the digests of the turns (role and text), ``sizes`` the code points of their
    texts. Turns are in order of ``turn``, null first; equal ones in that of their
    digests. A null role or text is empty; a row with a null conv_id belongs to no conversation. The first h
    = crc32(conv_id) % ``modulus`` turns are those of conversation conv_id - conv_id %
    ``group``, all if it has fewer, none if there is no such one. A conversation's digests are one
    row (28 bytes a turn); its texts aren't shuffled.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    each = turns.where("conv_id is not null").select(conv.alias("conv_id"), (conv - conv % group).alias("lead"), F.struct(F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    own = each.groupBy("lead", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = own.where("conv_id = lead").select("lead", F.slice("t", 1, modulus - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(modulus)).cast("int")
    empty = F.slice("t", F.lit(1), F.lit(0))
    taken = F.concat(F.coalesce(F.slice("head", F.lit(1), h), empty), F.slice("t", h + 1, F.greatest(F.size("t"), F.lit(1))))
    seq = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    return own.join(heads, "lead", "left").select("conv_id", taken.alias("t")).select("conv_id", seq.alias("seq"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def hashed_ids(members: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of each node's members, ascending and comma-joined.

    Ranges of (node, conv_id) join ids to chunks, so that a node that holds a third of all ids is spread
    over tasks; what is left to do in order is to hash its chunks, one after another.
    """
    n = partitions(members.sparkSession)

    def chunks(batches):
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (key != node or size >= CHUNK):
                    out.append((node, first, ",".join(ids).encode()))
                    ids, size = [], 0
                if not ids:
                    node, first = key, i
                ids.append(str(i))
                size += len(ids[-1]) + 1
            yield _batch(out, ("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary()))
        if ids:
            yield _batch([(node, first, ",".join(ids).encode())], ("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary()))

    def digests(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key == node and state:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.digest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.as_py())
            yield _batch(out, ("node", pa.binary()), ("ends", pa.binary()))
        if state:
            yield _batch([(node, state.digest())], ("node", pa.binary()), ("ends", pa.binary()))

    ranged = members.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ranged.mapInArrow(chunks, "node binary, first long, ids binary")
    return joined.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends binary")


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    same = np.frombuffer(a, np.uint8, n * DIGEST) == np.frombuffer(b, np.uint8, n * DIGEST)
    return int(np.argmin(same)) // DIGEST


# ---------------------------------------------------------------------- blocks

PACKED = [("block", pa.int64()), ("entry", pa.int32()), ("follow", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()), *((c, pa.binary()) for c in ("lcp", "lens", "sizes", "n", "least", "ends"))]
PACKED_DDL = "block long, entry int, follow int, head binary, tail binary, lcp binary, lens binary, sizes binary, n binary, least binary, ends binary"


def packed_blocks(sorted_seqs: DataFrame, limit: int) -> DataFrame:
    """Blocks of sorted (seq, sizes, n, least, ends): the arrays of a block in one row.

    ``block`` is in order of the sequences. ``entry`` and ``follow`` are the turns shared with the block
    before and after it, null at the borders of a partition, whose first and last
    sequences are ``head`` and ``tail``.
    """

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        rows, weight, entry, head, last = [], 0, None, None, None

        def made(follow, tail):
            lcp, lens, sizes, n, least, ends = zip(*rows, strict=True)
            flat = [x for s in sizes for x in s]
            arrays = [np.array(v, k).tobytes() for v, k in ((lcp, np.int64), (lens, np.int64), (flat, np.int64), (n, np.int64), (least, np.int64))]
            return _batch([(block, entry, follow, head, tail, *arrays, b"".join(ends))], *PACKED)

        for batch in batches:
            for seq, sizes, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = None if last is None else common(last, seq)
                if last is None:
                    head = seq
                if weight >= limit:
                    yield made(shared, None)
                    rows, weight, entry, head, block = [], 0, shared, None, block + 1
                rows.append((shared or 0, len(sizes), sizes, n, least, ends))
                weight += 1 + len(sizes)
                last = seq
        if rows:
            yield made(None, last)

    return sorted_seqs.select("seq", "sizes", "n", "least", "ends").mapInArrow(run, PACKED_DDL)


def _borders(blocks: DataFrame) -> dict[int, tuple[int, int]]:
    """Shared turns at both ends of each block, by block in order; -1 at the ends of all."""

    @F.pandas_udf("int")
    def shared(before, head):
        import pandas as pd

        return pd.Series([-1 if a is None else common(a, b) for a, b in zip(before, head, strict=True)], dtype="int32")

    # A row for each partition of the sort.
    ends = blocks.groupBy(F.shiftright("block", 32).alias("part")).agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    before = F.lag("tail").over(Window.orderBy("part"))
    first = {r.part: r.entry for r in ends.select("part", "head", before.alias("before")).select("part", shared("before", "head").alias("entry")).collect()}
    found = sorted(tuple(r) for r in blocks.select("block", "entry", "follow").collect())
    entries = [first[b >> 32] if entry is None else entry for b, entry, _ in found]
    return {b: (entry, after) for (b, _, _), entry, after in zip(found, entries, [*entries, -1][1:], strict=True)}


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """Places of the nearest smaller values to the left (-1 if none) and right (the length if none)."""
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        # Equal values stay under each other; the left neighbour of both is the same.
        if stack:
            left[k] = left[stack[-1]] if values[stack[-1]] == v else stack[-1]
        stack.append(k)
    return left, right


class RangeMin:
    """Minima of ranges, from minima of ranges of 2, 4, 8, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minima of [start, stop), none of which is empty."""
        level = np.frexp(np.maximum(stop - start, 1).astype(float))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][stop[at] - (1 << k)])
        return out


class Block:
    """A block's arrays with running sums and nearest smaller values; the place after its last is the next block's first."""

    def __init__(self, row: dict, entry: int, follow: int):
        get = lambda c: np.frombuffer(row[c], np.int64)
        self.lens, self.n, self.least, self.ends = get("lens"), get("n"), get("least"), row["ends"]
        self.size = len(self.lens)
        self.L = np.append(get("lcp"), follow)
        self.L[0] = entry
        self.start = np.concatenate([[0], np.cumsum(self.lens)])
        self.text = np.concatenate([[0], np.cumsum(get("sizes"))])
        left, right = nearest_smaller(self.L.tolist())
        self.left, self.right = np.array(left), np.array(right)
        whole = self.path(np.arange(self.size), self.lens)
        running = lambda x: np.concatenate([[0], np.cumsum(x)])
        own = whole - self.path(np.arange(self.size), np.maximum(self.L[:-1], 0))
        self.whole = whole
        self.sums = {"n": running(self.n), "text": running(self.n * whole), "own": running(own), "leaves": running(self.lens > self.L[1:])}
        self.minima = RangeMin(self.least)

    def path(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first turns of sequences."""
        return self.text[self.start[i] + depth] - self.text[self.start[i]]

    def total(self, name: str, start, stop):
        return self.sums[name][stop] - self.sums[name][start]

    def end_hash(self, i: int) -> bytes:
        return self.ends[32 * i : 32 * i + 32]

    def children(self, of: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Places in the block with the left neighbour ``of`` (-1: none) and the value ``depth``."""
        span = int(self.L.max()) + 3
        keys, counts = np.unique((self.left[:-1] + 1) * span + self.L[:-1] + 1, return_counts=True)
        wanted = (of + 1) * span + depth + 1
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (depth + 1 < span), counts[at], 0)

    def chain(self, at: int, step: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, next place) along nearest smaller values."""
        while 0 <= at < self.size + 1:
            after = int(step[at])
            yield at, after
            at = after

    def summary(self) -> tuple:
        """Minimum, how often, and totals."""
        inner = self.L[:-1]
        low = int(inner.min())
        return low, int((inner == low).sum()), *(int(self.sums[k][-1]) for k in ("n", "text", "own", "leaves")), int(self.least.min())

    def opened(self) -> Iterator[tuple]:
        """Nodes owned here that go on in the next block: depth and what the block holds of them."""
        for at, owner in self.chain(self.size, self.left):
            if owner < 0:
                return
            depth = np.arange(self.L[owner] + 1, self.L[at] + 1)
            path = self.path(np.full(len(depth), owner), np.maximum(depth - 1, 0))
            own = int(self.total("own", owner + 1, self.size) + self.whole[owner])
            n, text, leaves = (int(self.total(k, owner, self.size)) for k in ("n", "text", "leaves"))
            least = int(self.least[owner:].min())
            below = self.children(np.full(len(depth), owner), depth) + (self.lens[owner] > depth)
            for d, p, c in zip(depth.tolist(), path.tolist(), below.tolist(), strict=True):
                yield d, n, text, own - p, leaves, least, c, p, self.end_hash(owner) if d == self.lens[owner] else None

    def prefixes(self) -> Iterator[tuple]:
        """By depth, what the block holds of a node that comes from before and ends here."""
        for at, stop in self.chain(0, self.right):
            if stop >= self.size:
                return
            depth = np.arange(self.L[stop] + 1, self.L[at] + 1)
            below = self.children(np.full(len(depth), -1), depth)
            totals = [int(self.sums[k][stop]) for k in ("n", "text", "own", "leaves")]
            least = int(self.least[:stop].min())
            for d, c in zip(depth.tolist(), below.tolist(), strict=True):
                yield d, *totals, least, c, 0, None

    def entered(self) -> list[int]:
        """Depths of the nodes from before that have children here."""
        return sorted({d for d in self.L[self.left < 0].tolist() if d >= 0})

    def closed(self, entered: dict[int, int], opened: dict[int, int]) -> pa.RecordBatch:
        """The nodes owned here that end here; the two maps give the smallest member of nodes that cross a border."""
        inner = np.flatnonzero((self.left[:-1] >= 0) & (self.right[:-1] <= self.size))
        owner, depth = self.left[inner], self.L[inner]
        _, once = np.unique(owner * (int(self.L.max()) + 2) + depth, return_index=True)
        inner, owner, depth = inner[once], owner[once], depth[once]
        alone = np.arange(self.size)
        a = np.concatenate([owner, alone])
        z = np.concatenate([self.right[inner], alone + 1])
        high = np.concatenate([depth, self.lens])
        low = np.maximum(self.L[a], self.L[z])
        # Rows of nodes for the depths in between.
        count = np.maximum(high - low, 0)
        node = np.repeat(np.arange(len(a)), count)
        d = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + low[node] + 1
        top = d == high[node]
        a_, z_ = a[node], z[node]
        path = self.path(a_, np.maximum(d - 1, 0))
        n = self.total("n", a_, z_)
        saved = self.total("text", a_, z_) - n * path - (self.total("own", a_ + 1, z_) + self.whole[a_] - path)
        least = self.minima.of(a, z)
        below = np.where(top, self.children(a_, d) * (node < len(owner)) + (self.lens[a_] > d), 1)
        parent = least[node].astype(object)
        first = d == low[node] + 1
        parent[first] = self._parents(a_[first], z_[first], entered, opened)
        ends = [NO_ENDS] * len(node)
        for i in np.flatnonzero(d == self.lens[a_]).tolist():
            ends[i] = self.end_hash(int(a_[i])).hex()
        arrays = [least[node], d, parent.tolist(), n, below, self.total("leaves", a_, z_), saved]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in arrays), pa.array(ends, pa.string())], names=NODES)

    def _parents(self, a: np.ndarray, z: np.ndarray, entered: dict[int, int], opened: dict[int, int]) -> list[int | None]:
        """Smallest members of the nodes right above intervals [a, z)."""
        at = np.where(self.L[z] >= self.L[a], z, a)
        owner, stop, depth = self.left[at], self.right[at], self.L[at]
        inside = (owner >= 0) & (stop <= self.size)
        least = np.zeros(len(at), np.int64)
        least[inside] = self.minima.of(owner[inside], stop[inside])
        known = inside.tolist(), owner.tolist(), depth.tolist(), least.tolist()
        return [x if here else None if p < 0 else entered[p] if o < 0 else opened[p] for here, o, p, x in zip(*known, strict=True)]


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES_DDL = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODES)


# ---------------------------------------------------------------------- across blocks


class Minima:
    """Nearest smaller minima of blocks, and totals over ranges of blocks."""

    def __init__(self, summaries: list[tuple]):
        low, count, *totals, least = (np.array(c, np.int64) for c in zip(*summaries, strict=True))
        self.low = low.tolist()
        self.left, self.right = nearest_smaller(self.low)
        self.sums = [np.concatenate([[0], np.cumsum(t)]) for t in totals]
        self.least = RangeMin(least)
        self.at: dict[int, list[int]] = {}
        counts: dict[int, list[int]] = {}
        for b, (v, c) in enumerate(zip(self.low, count.tolist(), strict=True)):
            self.at.setdefault(v, []).append(b)
            counts.setdefault(v, []).append(c)
        self.counts = {v: [0, *accumulate(c)] for v, c in counts.items()}

    def ends(self, b: int, depth: int) -> int:
        """The first block after ``b`` with a value below ``depth``; the number of blocks if none."""
        b += 1
        while b < len(self.low) and self.low[b] >= depth:
            b = self.right[b]
        return b

    def owner(self, b: int, depth: int) -> int:
        """The last block before ``b`` with a value below ``depth``."""
        b -= 1
        while self.low[b] >= depth:
            b = self.left[b]
        return b

    def between(self, b: int, stop: int, depth: int) -> tuple:
        """Totals of the blocks after ``b`` and before ``stop``, their smallest member and how often they have ``depth``."""
        totals = [int(s[stop] - s[b + 1]) for s in self.sums]
        least = int(self.least.of(np.array([b + 1]), np.array([stop]))[0]) if stop > b + 1 else None
        at = self.at.get(depth, [])
        inside = self.counts[depth][bisect_left(at, stop)] - self.counts[depth][bisect_right(at, b)] if at else 0
        return *totals, least, inside


FACTS = [("kind", pa.int32()), ("block", pa.int64()), ("depth", pa.int64()), *((c, pa.int64()) for c in ("n", "text", "own", "leaves", "least", "below", "path")), ("ends", pa.binary())]
FACTS_DDL = "kind int, block long, depth long, n long, text long, own long, leaves long, least long, below long, path long, ends binary"
SUMMARY, OPENED, PREFIX, ENTERED = range(4)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def prefix_trie(rebuilt: DataFrame, block: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, seq, sizes), one row each.

    A node is a distinct sequence of the first ``depth`` turns, from the root (0); its members are
    the conversations that start with it, turnless ones being members of the root.
    conv_id is the smallest of n_convs members, parent_conv_id that of the node above (null above
    the root); n_children, n_leaves (of its subtree, itself included), saved_tokens (code points of last
    turns in the subtree times members beyond the first) and ends_sha256 (of the ids, ascending and
    comma-joined, of the members that end there) follow. conv_id must be unique and not null. No conversations
    give no nodes. ``block`` is the size of a block in turns and sequences; the result doesn't depend on it.
    """
    spark = rebuilt.sparkSession
    bounded_batches(spark)
    rebuilt = cut(rebuilt.select("conv_id", "seq", "sizes", F.unhex(F.substring(F.sha2("seq", 256), 1, 32)).alias("node")))
    distinct = rebuilt.groupBy("node").agg(F.any_value("seq").alias("seq"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    seqs = cut(distinct.join(hashed_ids(rebuilt), "node").drop("node"))
    weight = seqs.agg(F.coalesce(F.sum(1 + F.size("sizes").cast("long")), F.lit(0))).first()[0]
    limit = block or max(BLOCK, -(-weight // BLOCKS))
    blocks = cut(packed_blocks(seqs.repartitionByRange(partitions(spark), "seq").sortWithinPartitions("seq"), limit))
    borders = _borders(blocks)
    number = {b: i for i, b in enumerate(borders)}

    def facts(batches):
        for row in _rows(batches):
            b = number[row["block"]]
            one = Block(row, *borders[row["block"]])
            low, count, n, text, own, leaves, least = one.summary()
            out = [(SUMMARY, b, low, n, text, own, leaves, least, count, 0, None)]
            out += [(OPENED, b, *x) for x in one.opened()]
            out += [(PREFIX, b, *x) for x in one.prefixes()]
            out += [(ENTERED, b, d, *[0] * 7, None) for d in one.entered()]
            yield _batch(out, *FACTS)

    known = cut(blocks.mapInArrow(facts, FACTS_DDL))
    of_blocks = known.where(F.col("kind") == SUMMARY).select("block", "depth", "below", "n", "text", "own", "leaves", "least").collect()
    minima = Minima([tuple(r)[1:] for r in sorted(of_blocks)]) if of_blocks else None

    def resolve(batches):
        """Where a node ends, and the block whose nodes are above it."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                stop = minima.ends(r["block"], r["depth"])
                n, text, own, leaves, least, below = minima.between(r["block"], stop, r["depth"])
                above = r["depth"] - 1
                up = None if above < 0 else r["block"] if above > minima.low[r["block"]] else minima.owner(r["block"], above)
                smallest = r["least"] if least is None else min(least, r["least"])
                out.append((OPENED, r["block"], r["depth"], r["n"] + n, r["text"] + text, r["own"] + own, r["leaves"] + leaves, smallest, r["below"] + below, r["path"], r["ends"], stop, up))
            yield _batch(out, *FACTS, ("stop", pa.int64()), ("up", pa.int64()))

    def owners(batches):
        for batch in batches:
            yield _batch([(b, d, minima.owner(b, d)) for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], ("block", pa.int64()), ("depth", pa.int64()), ("owner", pa.int64()))

    prefix = known.where(F.col("kind") == PREFIX).select(F.col("block").alias("stop"), "depth", *[F.col(c).alias(f"{c}2") for c in ("n", "text", "own", "leaves", "least", "below")])
    plus = lambda c: F.col(c) + F.coalesce(f"{c}2", F.lit(0))
    ended = known.where(F.col("kind") == OPENED).mapInArrow(resolve, f"{FACTS_DDL}, stop long, up long").join(prefix, ["stop", "depth"], "left")
    crossing = cut(
        ended.select(
            "block", "depth", "up", F.least("least", "least2").alias("conv_id"), plus("n").alias("n_convs"), plus("below").alias("n_children"), plus("leaves").alias("n_leaves"),
            (plus("text") - plus("n") * F.col("path") - plus("own")).alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    above = crossing.select(F.col("block").alias("up"), F.col("depth").alias("at"), F.col("conv_id").alias("parent_conv_id"))
    open_nodes = crossing.withColumn("at", F.col("depth") - 1).join(above, ["up", "at"], "left").select(NODES)

    # What each block has to know of nodes that cross its borders: their smallest members.
    pairs = lambda name: F.collect_list(F.struct("depth", "conv_id")).alias(name)
    from_before = known.where(F.col("kind") == ENTERED).where("block > 0").select("block", "depth").mapInArrow(owners, "block long, depth long, owner long")
    least = crossing.select(F.col("block").alias("owner"), "depth", "conv_id")
    entered = from_before.join(least, ["owner", "depth"]).groupBy("block").agg(pairs("entered"))
    opened = crossing.groupBy("block").agg(pairs("opened"))

    @F.udf("long")
    def numbered(b):
        return number[b]

    def nodes(batches):
        for row in _rows(batches):
            maps = [{p["depth"]: p["conv_id"] for p in row[c] or []} for c in ("entered", "opened")]
            yield Block(row, *borders[row["block"]]).closed(*maps)

    told = blocks.withColumn("number", numbered("block")).join(entered.withColumnRenamed("block", "number"), "number", "left").join(opened.withColumnRenamed("block", "number"), "number", "left")
    return told.drop("number", "head", "tail").mapInArrow(nodes, NODES_DDL).unionByName(open_nodes)
