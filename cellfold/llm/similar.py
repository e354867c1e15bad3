"""Links between texts of a Jaccard similarity or more of their word shingles: none is missed.

A set that is similar to another shares at least ``least_shared`` of its shingles with it.
So all shingles are first counted, packed to a few bytes each: a text of which fewer
shingles occur in any other text is similar to none and leaves.

Put the shingles of the remaining texts in one order. Of two similar sets, the first few
of each (a fifth of the set at 0.8) have a shingle in common. The order is by the number
of texts with a shingle, so prefixes hold the rarest.
Candidates are joined by one link to a shingle's first text each, never by lists of
pairs. The sets of such a component then meet in blocks, and a block gives a spanning
forest of the pairs that are similar indeed. A component of more than ``BLOCK`` texts
first meets one block; what that left in parts meets the rest, but for the largest part,
whose texts don't meet each other again.

A batch of texts sends each of its shingles once, so a shingle of all texts crowds no
partition of the first count; those frequent in a bounded sample come last in the order
of the second, and are spread.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.components import connected_components
from cellfold.llm.shared import cut, freed, partitions, released, split_join

#: Texts of which frequent shingles are counted, and the most that are held as frequent.
SAMPLE_TEXTS, FREQUENT = 2048, 100_000
#: Above any count of a shingle that isn't frequent; rows of shingles that are counted at a time.
OFTEN, ROWS = 1 << 40, 1_000_000
#: Shingles and texts of a batch of the first count; stands for no text of a batch.
TOKENS, TEXTS, NOBODY = 1 << 20, 60_000, 65_535
#: Bytes of text that are hashed at a time.
BYTES = 1 << 18
#: Texts of a block.
BLOCK = 512
#: Ids up to this many (8 MB) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


# ------------------------------------------------------------------- shingle sets
_PRIME = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of the texts in ``data`` that begin at ``begins``.

    Bytes are the digits of a number to an odd base, modulo 2**64, from sums over the block.
    """
    if len(_powers[0]) < len(data):
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(data), base, np.uint64)))
    word = ~_SPACE[data]
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    inner = begins[(begins > 0) & (begins < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * _powers[0][: len(data)]))
    return _mix((sums[stops + 1] - sums[starts]) * _powers[1][starts]), starts


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each whole text's word shingles, sorted, one text after another; their numbers.

    Words lie between ASCII blanks, A-Z lower-cased. A text of fewer words is one shingle, and
    so are null, empty and wordless texts, which are all equal.
    """
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    hashes, begins, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + BYTES)
        if stop < len(data):  # at a blank or a text's end: before the block's end, else after it
            blank = np.flatnonzero(_SPACE[data[at + 1 : stop]])
            close = ends[np.searchsorted(ends, stop, "right") - 1]
            stop = max(close, at + 1 + blank[-1] if len(blank) else 0)
            if stop <= at:
                stop, step = len(data), BYTES
                for k in range(at + BYTES, len(data), step):
                    if len(found := np.flatnonzero(_SPACE[data[k : k + step]])):
                        stop = k + found[0]
                        break
                stop = min(stop, ends[np.searchsorted(ends, at, "right")])
        h, first = _word_hashes(data[at:stop], ends - at)
        hashes.append(h)
        begins.append(first + at)
        at = stop
    words, first = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*begins, np.zeros(0, np.int64)])
    owner = np.searchsorted(ends, first, "right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    base, n = np.uint64(_PRIME), max(0, len(words) - shingle + 1)
    acc = np.zeros(n, np.uint64)
    for k in range(shingle):
        acc = acc * base + words[k : k + n]
    whole = owner[:n] == owner[shingle - 1 :][:n]
    short = np.flatnonzero(counts < shingle)
    begin, few = (np.cumsum(counts) - counts)[short], np.zeros(len(short), np.uint64)
    for k in range(shingle - 1):
        has = counts[short] > k
        few[has] = few[has] * base + words[begin[has] + k]
    tokens = np.concatenate((_mix(acc[whole]), _mix(few + counts[short].astype(np.uint64) + np.uint64(1)))).view(np.int64)
    owner = np.concatenate((owner[:n][whole], short))
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[: len(tokens)]
    return tokens[new], np.bincount(owner[new], minlength=len(texts))


def read_shingles(shingle: int):
    """A reader of Arrow batches (id, text): (ids, hashes, numbers of hashes) of bounded slices.

    A slice has at most 1,024 rows and, but for one long text, about 1 MB.
    """

    def read(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                limit = (size[at - 1] if at else 0) + (1 << 20)
                stop = min(at + 1024, max(at + 1, int(np.searchsorted(size, limit, "right"))))
                yield batch.column(0).slice(at, stop - at), *shingle_hashes(batch.column(1).slice(at, stop - at), shingle)
                at = stop

    return read


# ------------------------------------------------------------------- exact search
def least_shared(n: int, similarity: float) -> int:
    """Elements that a set of ``n`` shares with any similar set, at least."""
    return math.ceil(similarity * n - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two sorted sets: is their Jaccard similarity so much or more?"""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def runs(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of token, and where each token's run starts and ends."""
    order = np.lexsort((rows, tokens))
    tokens, rows = tokens[order], rows[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
    return rows, starts, np.append(starts[1:], len(tokens))[: len(starts)]


def similar_forest(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between similar sets that join what ``label`` does not join yet."""
    label, found, tried, seen = label.copy(), [], set(), set()
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    order = np.lexsort((back, counts[back], owner))
    first = np.cumsum([0, *map(len, sets)])
    own = np.concatenate([*[order[at : at + len(s) - least_shared(len(s), similarity) + 1] for at, s in zip(first, sets)], np.zeros(0, np.int64)]).astype(np.int64)
    rows, starts, ends = runs(back[own], owner[own])
    for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        run = rows[start:end]
        if (label[run] == label[run[0]]).all() or (key := run.tobytes()) in seen:
            continue
        seen.add(key)
        for i, x in enumerate(run.tolist()):
            for y in run[:i][label[run[:i]] != label[x]].tolist():
                if label[x] == label[y] or (y, x) in tried:
                    continue
                tried.add((y, x))
                if similar(sets[x], sets[y], similarity):
                    label[label == label[x]] = label[y]
                    found.append((y, x))
    return found


def sharing_sets(rows: DataFrame, read, kind: str, parts: int, similarity: float) -> DataFrame:
    """(id, n): the sets that share as many elements with other sets as with a similar one, and their sizes.

    ``read`` makes (ids, elements, sizes) of batches of ``rows``, ids in the first column.
    Elements are dealt to ``parts`` ranges of values. A batch of sets sends its distinct
    elements of a range as one row: 32 bits within the range, and the set's place in the
    batch. There it is told which of them other sets have too. Different elements of equal
    bits count as one, so a set may stay without need, but none leaves that has a similar one.
    """
    step = -(-(1 << 64) // parts)
    lows = np.array([k * step for k in range(parts)], np.uint64)
    shift = np.uint64(max(0, (step - 1).bit_length() - 32))
    told = f"batch long, ids array<{kind}>, sizes array<int>, shared array<int>, owner binary"

    def deal(batch: int, ids: pa.Array, sizes: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(tokens)
        tokens, owner = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
        times = np.diff(np.append(starts, len(tokens)))
        shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sizes))
        tokens, sender = tokens[starts], np.where(times == 1, owner[starts], NOBODY).astype(np.uint16)
        bounds = np.append(np.searchsorted(tokens, lows), len(tokens))
        bits = ((tokens - np.repeat(lows, np.diff(bounds))) >> shift).astype(np.uint32)
        some = np.flatnonzero(np.diff(bounds)).tolist()
        cuts = [(bounds[k], bounds[k + 1]) for k in some]
        head = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), pa.nulls(len(some), pa.list_(x.type))])
        # The first row tells the batch's ids; it is passed on as it is.
        columns = {
            "part": pa.array([batch % parts, *some], pa.int32()),
            "batch": pa.array([batch] * (len(some) + 1), pa.int64()),
            "ids": head(ids),
            "sizes": head(pa.array(sizes, pa.int32())),
            "shared": head(pa.array(shared, pa.int32())),
            "owner": pa.array([None, *(sender[a:b].tobytes() for a, b in cuts)], pa.binary()),
            "tokens": pa.array([None, *(bits[a:b].tobytes() for a, b in cuts)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def pack(batches):
        # A partition that is computed anew gives the same batches under the same numbers.
        number, held, ids, sizes, tokens = TaskContext.get().partitionId() << 32, 0, [], [], []
        for own, elements, lengths in read(batches):
            ids.append(own)
            sizes.append(lengths)
            tokens.append(elements.view(np.uint64))
            held += len(elements)
            if held > TOKENS or 1024 * (len(ids) + 1) > TEXTS:
                yield deal(number, pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(tokens))
                number, held, ids, sizes, tokens = number + 1, 0, [], [], []
        if ids:
            yield deal(number, pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(tokens))

    def compare(batches):
        held = defaultdict(list)
        for batch in batches:
            sent = pa.compute.is_valid(batch.column("tokens"))
            yield pa.RecordBatch.from_pydict({c: batch.filter(pa.compute.invert(sent)).column(c) for c in ("batch", "ids", "sizes", "shared", "owner")})
            rows = batch.filter(sent)
            for part, *row in zip(*(rows.column(c).to_pylist() for c in ("part", "batch", "tokens", "owner")), strict=True):
                held[part].append(row)
        for part in list(held):
            numbers, tokens, owner = zip(*held.pop(part), strict=True)
            _, back, counts = np.unique(np.frombuffer(b"".join(tokens), np.uint32), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(x) // 2 for x in owner])
            owner = np.frombuffer(b"".join(owner), np.uint16)
            common = (counts[back] > 1) & (owner != NOBODY)
            named = [o[c].tobytes() for o, c in zip(np.split(owner, ends[:-1]), np.split(common, ends[:-1]), strict=True)]
            kinds = {c: batch.column(c).type for c in ("ids", "sizes", "shared")}
            yield pa.RecordBatch.from_pydict({"batch": pa.array(numbers, pa.int64()), **{c: pa.nulls(len(named), t) for c, t in kinds.items()}, "owner": pa.array(named, pa.binary())})

    def decide(table):
        heads = table.filter(pa.compute.is_valid(table["ids"])).combine_chunks()
        if len(heads) != 1:
            raise RuntimeError("a batch of sets was told apart from its ids; the input must have a stable order")
        ids, sizes, shared = (heads[c].combine_chunks().flatten() for c in ("ids", "sizes", "shared"))
        owner = np.frombuffer(b"".join(table["owner"].drop_null().to_pylist()), np.uint16)
        shared = np.asarray(shared) + np.bincount(owner, minlength=len(shared))
        enough = pa.array(shared >= np.ceil(similarity * np.asarray(sizes) - 1e-9))
        return pa.table({"id": ids.filter(enough), "n": sizes.filter(enough).cast(pa.int64())})

    dealt = rows.mapInArrow(released(pack), f"part int, {told}, tokens binary").repartition(parts, "part")
    return dealt.mapInArrow(released(compare), told).groupBy("batch").applyInArrow(lambda table: freed(decide(table)), f"id {kind}, n long")


def shared_prefixes(rows: DataFrame, read, kind: str, frequent: tuple[np.ndarray, np.ndarray], parts: int, similarity: float) -> DataFrame:
    """(token, id): the shingles of each set's prefix that other sets have too.

    ``frequent`` holds sorted shingles and how often the sample has them.
    """
    shape = f"token long, id {kind}, n int, df long"

    def flat(batches):
        for ids, tokens, sizes in read(batches):
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(frequent[0], tokens), max(len(frequent[0]) - 1, 0))
            often = frequent[0][at] == tokens if len(frequent[0]) else np.zeros(len(tokens), bool)
            df = np.where(often, OFTEN + frequent[1][at], 0) if len(frequent[0]) else np.zeros(len(tokens), np.int64)
            # Each set also has a row that tells its size, dealt out like a shingle.
            marks = pa.array(np.arange(len(sizes)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((tokens, np.random.default_rng(1).integers(-(1 << 62), 1 << 62, len(sizes))))),
                    pa.concat_arrays([ids.take(pa.array(owner)), ids.take(marks)]),
                    pa.concat_arrays([pa.nulls(len(tokens), pa.int32()), pa.array(sizes.astype(np.int32))]),
                    pa.concat_arrays([pa.array(df, mask=df == 0), pa.nulls(len(sizes), pa.int64())]),
                ],
                names=["token", "id", "n", "df"],
            )

    def count(batches):
        taken = list(batches)
        if not taken:
            return
        table = pa.Table.from_batches(taken).combine_chunks()
        tokens = table.column("token").to_numpy()
        mark = table.column("n").is_valid().to_numpy()
        known = table.column("df").fill_null(0).to_numpy()
        _, back, counts = np.unique(tokens[~mark], return_inverse=True, return_counts=True)
        df = np.zeros(len(tokens), np.int64)
        df[~mark] = counts[back]
        df = np.where(known > 0, known, df)
        keep = np.flatnonzero(mark | (df > 1))
        out = table.set_column(3, "df", pa.array(df)).take(pa.array(keep))
        yield from out.to_batches(max_chunksize=1 << 18)

    # Frequent shingles are spread by set, others meet by shingle.
    spread = F.when(F.col("df").isNotNull(), F.xxhash64("token", "id")).otherwise(F.col("token"))
    dealt = rows.mapInArrow(released(flat), shape).withColumn("at", spread).repartition(parts, "at").drop("at")
    own = Window.partitionBy("id")
    ranked = dealt.mapInArrow(released(count), shape).withColumns({"size": F.max("n").over(own), "shared": F.count(F.when(F.col("n").isNull(), 1)).over(own)})
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.col("n").isNotNull(), "df", "token")))
    # Shingles of no other set come first: so many of the prefix are used up.
    return ranked.where(F.col("n").isNull() & (F.col("rank") <= F.col("shared") + 1 - F.ceil(F.lit(similarity) * F.col("size") - 1e-9))).select("token", "id")


def candidates(prefixes: DataFrame) -> DataFrame:
    """(a, b): links that join all ids of ``prefixes(token, id)`` that share a token."""
    prefixes = cut(prefixes)
    least = prefixes.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("token", "a")
    return split_join(prefixes, least, "token").where("a <> id").select("a", F.col("id").alias("b"))


def _hinted(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _meet(rows_of, read, units: DataFrame, kind: str, similarity: float) -> DataFrame:
    """(a, b): forests of the similar pairs among the ids of each unit of ``units(id, unit, root)``."""
    units = cut(units)
    n = max(1, units.count() // BLOCK)
    keyed = units.select("id", "root", F.pmod(F.xxhash64("unit"), F.lit(n)).alias("key"))

    def sets(batches):
        for ids, tokens, sizes in read(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(tokens))], names=["id", "set"])

    def match(table):
        sets = [np.asarray(s.values) for s in table.column("set").combine_chunks()]
        label = np.unique(np.asarray(table.column("root").combine_chunks().cast(pa.string())).astype(str), return_inverse=True)[1].ravel()
        found = np.array(similar_forest(sets, label, similarity), np.int64).reshape(-1, 2)
        ids = table.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(found[:, 0])), "b": ids.take(pa.array(found[:, 1]))})

    made = rows_of(units.select("id").distinct()).mapInArrow(released(sets), f"id {kind}, set array<long>")
    return cut(made.join(_hinted(keyed), "id").groupBy("key").applyInArrow(lambda table: freed(match(table)), f"a {kind}, b {kind}"))


def similar_links(rows: DataFrame, docs: DataFrame, read, similarity: float) -> DataFrame:
    """(a, b): links of the Jaccard ``similarity`` or more that keep every component whole.

    ``docs`` has a column ``id``, without nulls, and the sizes ``n`` of its sets; ``rows`` has
    ``id`` and what ``read`` makes (ids, sets' elements, sizes) of, for these ids and maybe more.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows_of = lambda ids: rows.join(_hinted(ids), "id", "left_semi")
    tokens = docs.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(docs.sparkSession), math.ceil(tokens / ROWS))
    docs = cut(sharing_sets(rows_of(docs.select("id")), read, kind, parts, similarity))
    n, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pick = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_TEXTS / max(n, 1)) * (1 << 20))


    def elements(batches):
        for _, tokens, _ in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens)], names=["h"])

    counted = rows_of(docs.where(pick).select("id")).mapInArrow(released(elements), "h long").groupBy("h").count()
    drawn = counted.where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas().sort_values("h")
    frequent = drawn["h"].to_numpy(np.int64), drawn["count"].to_numpy(np.int64)

    parts = max(partitions(docs.sparkSession), math.ceil(tokens / ROWS))
    prefixes = shared_prefixes(rows_of(docs.select("id")), read, kind, frequent, parts, similarity)
    clusters = connected_components(candidates(prefixes))
    sizes = clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = split_join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), sizes, "cluster")
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    # The first block meets every other one; a sole block meets itself.
    unit = lambda i, j: F.struct(F.col("cluster"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    each = lambda first, n: F.sequence(F.lit(first).cast("long"), F.col(n) - 1)
    head = F.when((F.col("blocks") > 1) & (F.col("block") == 0), F.transform(each(1, "blocks"), lambda j: unit(F.lit(0), j))).otherwise(F.array(unit(F.lit(0), F.col("block"))))
    links = _meet(rows_of, read, members.select("id", F.explode(head).alias("unit"), F.col("id").alias("root")), kind, similarity)

    # Of a large component's parts, all but the largest meet the whole component.
    large = cut(members.where("blocks > 2"))
    if large.isEmpty():
        return links
    roots = connected_components(links)
    large = cut(large.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    counts = large.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("cluster", F.col("main.root").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("rests"))
    apart = split_join(large, main, "cluster").withColumn("rest", F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("rests"))))
    # Block i of the rest meets block j of the main part, and block j of the rest from i on.
    to_main = F.transform(each(0, "rests"), lambda i: unit(i, -1 - F.col("block")))
    to_rest = F.transform(each(0, "rests"), lambda i: unit(F.least(i, "rest"), F.greatest(i, "rest")))
    from_rest = F.flatten(F.array(to_rest, F.transform(each(0, "blocks"), lambda j: unit(F.col("rest"), -1 - j))))
    rest = apart.select("id", F.explode(F.when(F.col("rest").isNull(), to_main).otherwise(from_rest)).alias("unit"), "root")
    return links.union(_meet(rows_of, read, rest, kind, similarity))
