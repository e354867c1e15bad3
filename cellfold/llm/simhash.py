"""SimHash near-duplicate groups by vantage-point trees over Hamming distance.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. Of the two halves
of the bits, at least one of a linked pair differs in at most ``RADIUS // 2`` bits; so
there is one vantage-point tree per half, searched with that smaller radius.
A tree's upper levels, fitted on a bounded sample, deal the distinct fingerprints into
shards; a fingerprint is resident in one shard and asks every shard that the triangle
bound cannot exclude. Inside a shard the tree goes on, in numpy, down to small blocks,
where whole fingerprints are compared. Where a half no longer tells fingerprints apart,
the tree goes on over the other half, searched with the whole radius.

For groups, a shard gives a spanning forest of the links it finds, never all its
pairs. To keep one document of each group of near-duplicates, these links count as they
are, and ``similar.py`` adds all links of similar texts, within the radius or beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.components import connected_components, forest
from cellfold.llm.shared import bounded_batches, cut, freed, released, split_join
from cellfold.llm.similar import BROADCAST_IDS, read_shingles, shingle_hashes, similar_links

SEED = 42
RADIUS = 3
SHINGLE = 3
#: The parts of the bits; each part is a metric of its own.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
#: Of similar texts: words of a shingle, and least Jaccard similarity.
SIMILAR_SHINGLE, SIMILAR = 5, 0.8
#: Distinct fingerprints that a shard should hold, and the most shards of a tree: beyond
#: SHARD * SHARDS fingerprints shards grow, at some ten bytes a fingerprint.
SHARD, SHARDS = 4096, 32_768
#: Sampled fingerprints for each shard; the sample that upper levels are fitted on has
#: at most SAMPLE * SHARDS (1 MB).
SAMPLE = 4
#: Bytes of text turned into words at a time, so a huge text needs bounded memory.
BLOCK = 1 << 22


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; null or wordless texts give 0."""
    if not text:
        return 0
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    ones, total, carry, start = np.zeros(64, np.int64), 0, [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK)
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        words = carry + data[start:stop].split()
        start = stop
        if len(words) >= shingle:
            hashes = _hashes(words, shingle)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    pairs = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row; the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return kept.mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def marked_texts(named: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, digest, n) of ``named(id, text)``: the fingerprint, 128 bits of the set of word shingles, and its size."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                fps = np.fromiter(map(fingerprint, part.column(1).to_pylist()), np.uint64, part.num_rows)
                tokens, sizes = shingle_hashes(part.column(1), shingle)
                ends = np.append(0, np.cumsum(sizes))
                digests = [xxhash.xxh3_128_digest(tokens[a:b].tobytes(), SEED) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "fp", "digest", "n"])

    return named.select("id", "text").mapInArrow(released(run), f"id {named.schema['id'].dataType.simpleString()}, fp long, digest binary, n long")


# ------------------------------------------------------------------------ tree
@dataclass(frozen=True)
class Node:
    """Fingerprints at most ``cut`` from ``point`` go left. A leaf has ``shard`` >= 0.

    Distances are over the tree's half of the bits, or, if ``other``, over the other half.
    """

    point: int = 0
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None
    shard: int = -1
    other: bool = False


def _distance(fps: np.ndarray, point, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(point)) & mask)


def _split(fps: np.ndarray, mask: np.uint64, rng: np.random.Generator) -> tuple[int, int, np.ndarray, bool] | None:
    """(vantage point, cut, distances, over the other half?).

    Of a few points the one whose distances spread most is taken, with a median cut.
    """
    for other in (False, True):
        best = None
        for point in fps[rng.integers(0, len(fps), 4)]:
            d = _distance(fps, point, ~mask if other else mask)
            if best is None or d.var() > best[2].var():
                best = (int(point), int(np.median(d)), d)
        point, middle, d = best
        for cut_at in (middle, middle - 1):
            if (d <= cut_at).any() and (d > cut_at).any():
                return point, cut_at, d, other
    return None


def fit_tree(sample: np.ndarray, mask: np.uint64, shards: int, seed: int = 7) -> Node:
    """A tree of at most ``shards`` leaves, numbered from left to right."""
    rng, count = np.random.default_rng(seed), [0]

    def grow(fps: np.ndarray, want: int) -> Node:
        found = _split(fps, mask, rng) if want > 1 and len(fps) > 1 else None
        if found is None:
            count[0] += 1
            return Node(shard=count[0] - 1)
        point, cut_at, d, other = found
        left = max(1, min(want - 1, round(want * float((d <= cut_at).mean()))))
        return Node(point, cut_at, grow(fps[d <= cut_at], left), grow(fps[d > cut_at], want - left), other=other)

    return grow(sample, shards)


def route(fps: np.ndarray, tree: Node, mask: np.uint64, part_radius: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, resident): where each fingerprint lives, and the shards behind its bounds.

    A pair needs to meet once only, so a fingerprint asks the shards from its own on.
    """
    rows, shards, homes = [], [], []

    def walk(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.shard >= 0:
            rows.append(at)
            homes.append(home)
            shards.append(np.full(len(at), node.shard, np.int64))
            return
        d = _distance(fps[at], node.point, ~mask if node.other else mask).astype(np.int64)
        reach = radius if node.other else part_radius
        inside = d <= node.cut
        go = inside | (d - reach <= node.cut)
        walk(node.left, at[go & (inside | ~home)], (home & inside)[go & (inside | ~home)])
        # What lives on the left asks the right side too; what lives on the right doesn't
        # ask the left side while it is still on its own path.
        go = ~inside | (d + reach > node.cut)
        walk(node.right, at[go], (home & ~inside)[go])

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(shards, np.int64), join(homes, bool)


def search(fps: np.ndarray, resident: np.ndarray, mask: np.uint64, part_radius: int, radius: int, found, block: int = 768) -> None:
    """Call ``found(a, b)`` with rows within ``radius``: a resident, b any, in bounded arrays.

    Sides of the tree that the bounds on the part exclude aren't compared.
    """
    rng = np.random.default_rng(11)

    def walk(res: np.ndarray, ask: np.ndarray) -> None:
        if not len(res) or not len(ask):
            return
        cut_here = _split(fps[res], mask, rng) if len(res) > block and len(ask) > block else None
        if cut_here is None:
            for i in range(0, len(res), 512):
                r = res[i : i + 512]
                for j in range(0, len(ask), 4096):
                    q = ask[j : j + 4096]
                    x, y = np.nonzero(np.bitwise_count(fps[r][:, None] ^ fps[q][None, :]) <= radius)
                    keep = r[x] != q[y]
                    if keep.any():
                        found(r[x][keep], q[y][keep])
            return
        point, cut_at, d, other = cut_here
        dq = _distance(fps[ask], point, ~mask if other else mask).astype(np.int64)
        reach = radius if other else part_radius
        walk(res[d <= cut_at], ask[dq - reach <= cut_at])
        walk(res[d > cut_at], ask[dq + reach > cut_at])

    walk(np.flatnonzero(resident), np.arange(len(fps)))


def links(fps: np.ndarray, resident: np.ndarray, mask: np.uint64, part_radius: int, radius: int = RADIUS) -> np.ndarray:
    """Component labels of a shard's fingerprints under links between residents and all."""
    label, waiting, size = np.arange(len(fps)), [], [0]

    def flush() -> None:
        if waiting:
            pairs = np.concatenate(waiting, axis=1)
            label[:] = forest(np.concatenate((pairs[0], np.arange(len(fps)))), np.concatenate((pairs[1], label)), len(fps))
            waiting.clear()
            size[0] = 0

    def found(a: np.ndarray, b: np.ndarray) -> None:
        waiting.append(np.stack((a, b)))
        size[0] += len(a)
        if size[0] > 1 << 21:
            flush()

    search(fps, resident, mask, part_radius, radius, found)
    flush()
    return label


# -------------------------------------------------------------------- operator
def link_forest(distinct: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that keep every component whole.

    ``n`` is their number. The trees' upper levels are fitted on about ``sample``
    fingerprints a shard, picked by a hash, so that a rerun fits the same trees; all
    fingerprints are dealt and compared.
    """
    part = radius // len(HALVES)
    shards = min(SHARDS, max(1, -(-n // shard)))
    trees = [Node(shard=0)] * len(HALVES)
    if shards > 1:
        pick = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, sample * shards / n) * (1 << 40))
        drawn = np.sort(distinct.where(pick).limit(2 * sample * shards).toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
        trees = [fit_tree(drawn, mask, shards) for mask in HALVES]

    def deal(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for t, (tree, mask) in enumerate(zip(trees, HALVES, strict=True)):
                rows, at, home = route(fps, tree, mask, part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(at), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=["tree", "shard", "fp", "home"])

    def match(key, table):
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        home = np.asarray(table.column("home").combine_chunks().cast(pa.int8())).astype(bool)
        label = links(fps, home, HALVES[key[0].as_py()], part, radius)
        linked = label != np.arange(len(fps))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "tree int, shard long, fp long, home boolean")
    return dealt.groupBy("tree", "shard").applyInArrow(lambda key, table: freed(match(key, table)), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    * fingerprint: 16 lowercase hex digits; null, empty and wordless texts have 0.
    * component_id: the smallest id that links of ``radius`` or fewer bits reach.
    * Rows with a null id get a row too, and the smallest id of the others in
      their component (null if there is none). Repeated rows stay repeated.
    * Other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    out = marked.join(_components(marked, id_col, radius), "fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``marked(id, fp)``."""
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected_components(link_forest(distinct, distinct.count(), radius))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return split_join(rooted, least, "root").select("fp", "component_id")


def simhash_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    similarity: float | None = SIMILAR,
    shingle: int = SIMILAR_SHINGLE,
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    * Texts are linked if their fingerprints differ in ``radius`` or fewer bits (by the
      trees), or if their sets of word shingles have the Jaccard ``similarity`` or more
      (by ``similar_links``). Components are taken once, over all links: a text that is
      dropped still links others. Without a ``similarity``, the bits alone decide.
    * Null, empty and wordless texts are equal, so one of them stays.
    * Of rows that repeat an id, the one with the smallest xxhash64 of its text (then of
      the whole row) is compared, and one row stays if its id does.
    * Rows with a null id can't be told apart by it, so all of them stay.
    * All columns stay, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    marks = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))
    repeated = cut(marks.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n > 1"))
    hints = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where("id is not null")
    if not repeated.isEmpty():
        # Only one text of a repeated id is compared, and once.
        once = hints(repeated.select(F.col("id").alias("__id"), F.col("h").alias("__h")))
        named = named.join(hints(repeated.select("id")), "id", "left_anti").union(
            named.join(once, (F.col("id") == F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        )
    dropped = hints(cut(_dropped(named, radius, similarity, shingle)).withColumnRenamed("id", id_col))
    kept = docs.join(dropped, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if repeated.isEmpty():
        return kept
    again = hints(repeated.select(F.col("id").alias(id_col)))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64(text), F.xxhash64(*plain))).alias("row")
    one = kept.join(again, id_col, "left_semi").groupBy(F.col(f"`{id_col}`").alias("__id")).agg(row).select("row.*")
    return kept.join(again, id_col, "left_anti").select(*one.columns).union(one)


def _dropped(named: DataFrame, radius: int, similarity: float | None, shingle: int) -> DataFrame:
    """(id): those of ``named(id, text)``, ids distinct, that have a smaller one in their component."""
    if similarity is None:
        marked = cut(fingerprints(named, "id"))
        return marked.join(_components(marked, "id", radius), "fp").where("id <> component_id").select("id")
    marked = cut(marked_texts(named, shingle))
    # Texts of equal sets are one; only its smallest id is compared, and that of each of its fingerprints.
    shapes = cut(marked.groupBy("digest", "fp").agg(F.min(F.struct("id", "n")).alias("least")).select("digest", "fp", "least.*"))
    first = cut(shapes.groupBy("digest").agg(F.min(F.struct("id", "n")).alias("least")).select("digest", "least.*"))
    equal = split_join(marked.select("id", "digest"), first.select("digest", F.col("id").alias("b")), "digest").where("id <> b").select(F.col("id").alias("a"), "b")
    close = _close(shapes.select("id", "fp"), radius)
    links = similar_links(named, first.select("id", "n"), read_shingles(shingle), similarity)
    return connected_components(equal.union(close).union(links)).where("node <> root").select(F.col("node").alias("id"))


def _close(marked: DataFrame, radius: int) -> DataFrame:
    """(a, b): ids that join all of ``marked(id, fp)`` whose fingerprints are linked."""
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("b")))
    forest_links = link_forest(distinct, distinct.count(), radius)
    for side in "ab":
        ends = distinct.select(F.col("fp").alias(side), F.col("b").alias(f"id_{side}"))
        forest_links = forest_links.join(ends, side)
    equal = split_join(marked, distinct, "fp").where("id <> b").select(F.col("id").alias("a"), "b")
    return equal.union(forest_links.select("id_a", "id_b"))
