"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Equal vectors of a label are one class. Classes' normalised vectors are projected on
random normal directions, shifted and quantised (Datar et al., 2004); in each table
the quantised projections, the label and the length name a bucket. The number of
projections grows with the logarithm of the number of classes, and the number of
tables follows from it so that a pair at the threshold meets with a set probability.

A bucket larger than ``BLOCK`` is cut into chunks, and every two chunks meet in a
group of their own, so no group grows with a bucket. A group checks its pairs and
gives sums of links and a spanning forest, never pairs. A pair that meets in several
tables counts in the first of them only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.components import connected_components, forest
from cellfold.llm.shared import cut, split_join

#: Width of a quantisation step, for unit vectors.
STEP = 2.0
#: Probability that a pair exactly at the threshold meets in some table.
RECALL = 0.9995
#: Rows of a chunk of a large bucket; rows of a task's group of buckets.
BLOCK, GROUP = 512, 32_768
#: Group size up to which pairs are listed by offset rather than multiplied as a matrix.
SMALL = 48
#: Cosines this close to the threshold are summed again, in the order that small groups use.
BAND = 1e-9


def meet_probability(distance: float, step: float = STEP) -> float:
    """Probability that two points at a distance fall in one quantisation step of a projection."""
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections in a table, tables) for ``n`` classes."""
    near, far = meet_probability(math.sqrt(2 - 2 * threshold)), meet_probability(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def valid(vector: Column, label: Column) -> Column:
    """Of a row: its vector can have links."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def signatures(rows: np.ndarray, k: int, tables: int, seed: int = 23) -> np.ndarray:
    """(rows, tables) 32-bit hashes of the quantised projections of unit rows."""
    rng = np.random.default_rng([seed, rows.shape[1], k, tables])
    directions, shifts = rng.standard_normal((rows.shape[1], k * tables)), rng.random(k * tables) * STEP
    cells = np.floor((rows @ directions + shifts) / STEP).astype(np.int64).reshape(len(rows), tables, k)
    h = np.zeros((len(rows), tables), np.uint64)
    for i in range(k):
        h = (h ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def _pairs(start: np.ndarray, size: np.ndarray, limit: int = 1 << 19):
    """Index pairs within many small groups of consecutive rows, in bounded arrays."""
    for gap in range(1, int(size.max(initial=0))):
        keep = size > gap
        start, size = start[keep], size[keep]
        many = size - gap
        stops = np.cumsum(many)
        at = 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(stops, stops[at] - many[at] + limit)))
            n = many[at:stop]
            a = np.repeat(start[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield a, a + gap
            at = stop


def _links(table: pa.Table, threshold: float, k: int, tables: int) -> pa.Table:
    """Sums of links (a, null, n) and forest edges (a, b, 0) of the groups of one task."""
    column = lambda name: table.column(name).combine_chunks()
    bucket, ci, cj, chunk, cid, weight, tab = (np.asarray(column(c)) for c in ("bucket", "ci", "cj", "chunk", "cid", "weight", "tab"))
    order = np.lexsort((cid, chunk, cj, ci, bucket))
    bucket, ci, cj, chunk, cid, weight, tab = (x[order] for x in (bucket, ci, cj, chunk, cid, weight, tab))
    # Each vector came once for each of its groups; lengths are equal within a group.
    vectors = column("vector").take(pa.array(order))
    ends = np.asarray(vectors.offsets)
    lengths, flat = np.diff(ends), np.asarray(vectors.values)
    ends = ends - ends[0]
    nodes, node = np.unique(cid, return_inverse=True)
    total, forest_a, forest_b, waiting = np.zeros(len(nodes), np.int64), [], [], [0]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        # Whether this table is the first that the pair meets in.
        first = ~((sigs[place[a]] == sigs[place[b]]) & (np.arange(tables) < tab[a][:, None])).any(1)
        a, b = a[first], b[first]
        np.add.at(total, node[a], weight[b])
        np.add.at(total, node[b], weight[a])
        forest_a.append(node[a])
        forest_b.append(node[b])
        waiting[0] += len(a)
        if waiting[0] > 1 << 21:
            squeeze()

    def squeeze() -> None:
        label = forest(np.concatenate(forest_a), np.concatenate(forest_b), len(nodes))
        forest_a[:], forest_b[:], waiting[0] = [np.arange(len(nodes))], [label], 0

    change = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(ci) != 0) | (np.diff(cj) != 0)])
    size = np.diff(np.r_[change, len(bucket)])
    for length in np.unique(lengths):
        pick = np.flatnonzero(lengths == length)
        distinct, back = np.unique(cid[pick], return_index=True, return_inverse=True)[1:]
        rows = unit(flat[ends[pick[distinct]][:, None] + np.arange(length)].astype(np.float64))
        sigs = np.concatenate([signatures(rows[i : i + 4096], k, tables) for i in range(0, len(rows), 4096)])
        place = np.full(len(lengths), -1)
        place[pick] = back
        mine = lengths[change] == length
        small = mine & (size <= SMALL) & (ci[change] == cj[change])
        for a, b in _pairs(change[small], size[small]):
            cosine = np.einsum("ij,ij->i", rows[place[a]], rows[place[b]])
            take(a[cosine >= threshold], b[cosine >= threshold])
        for g in np.flatnonzero(mine & ~small):
            at = np.arange(change[g], change[g] + size[g])
            own = chunk[at] == ci[at]
            left, right = at[own], (at if ci[at[0]] == cj[at[0]] else at[~own])
            for i in range(0, len(left), 1024):
                for j in range(0, len(right), 1024):
                    x, y = left[i : i + 1024], right[j : j + 1024]
                    cosine = rows[place[x]] @ rows[place[y]].T
                    p, q = np.nonzero(cosine >= threshold - BAND)
                    a, b, near = x[p], y[q], cosine[p, q] < threshold + BAND
                    keep = a < b if ci[at[0]] == cj[at[0]] else np.ones(len(a), bool)
                    near = np.flatnonzero(keep & near)
                    for s in range(0, len(near), 1 << 15):  # sums of one order decide a close call
                        part = near[s : s + (1 << 15)]
                        keep[part] = np.einsum("ij,ij->i", rows[place[a[part]]], rows[place[b[part]]]) >= threshold
                    for s in range(0, int(keep.sum()), 1 << 18):
                        take(a[keep][s : s + (1 << 18)], b[keep][s : s + (1 << 18)])
    if forest_a:
        squeeze()
    label = forest_b[0] if forest_b else np.arange(len(nodes))
    some, linked = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table(
        {
            "a": np.concatenate((nodes[some], nodes[linked])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[label[linked]], pa.int64())]),
            "n": np.concatenate((total[some], np.zeros(len(linked), np.int64))),
        }
    )


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    * Two rows are linked if their labels are equal and not null and the cosine of
      their vectors, in double precision, is ``threshold`` or more.
    * Vectors that are null, empty, zero, or hold null or non-finite components, and
      vectors of different lengths, have no links.
    * component_id is the smallest id reachable; a row with a null id has its
      component's smallest id. kept: the id equals component_id (nulls are equal).
    * Equal vectors with one label are all linked, so repeated rows are too; other
      columns are ignored; an empty table gives an empty result.
    """
    label, vector = F.col(f"`{label_col}`").cast("string"), F.col(f"`{vector_col}`")
    # Single precision is kept on the way; tasks compute in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.cast(kind).alias("vector"))
    rows = rows.withColumn("ok", valid(F.col("vector"), F.col("label")))
    keys = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64("vector", F.lit(1), "label").alias("h2")]
    good = rows.where("ok").select("id", "label", "vector", *keys)
    classes = good.groupBy("h1", "h2", "label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    classes = cut(classes.select("h1", "h2", F.xxhash64("label").alias("lab"), "vector", "first", "weight", F.monotonically_increasing_id().alias("cid")))
    found = cut(_matches(classes, threshold))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.select("h1", "h2", "first", "weight", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.join(links.withColumnRenamed("a", "cid"), "cid", "left")
    named = cut(named.select("h1", "h2", "first", F.coalesce("root", "cid").alias("root"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = split_join(named, least, "root").select("h1", "h2", "n_links", "component_id")
    # Rows that can't have links meet nothing (h2 is null), and are spread by their ids.
    out = rows.select("id", F.when(F.col("ok"), keys[0]).otherwise(F.xxhash64("id")).alias("h1"), F.when(F.col("ok"), keys[1]).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h2").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _matches(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of all groups of buckets."""
    k, tables = plan(classes.count(), threshold)

    def sign(batches):
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                vectors = part.column(2)
                ends = np.asarray(vectors.offsets)
                flat, lengths = np.asarray(vectors.values), np.diff(ends)
                cells = np.zeros((len(lengths), tables), np.uint64)
                for length in np.unique(lengths):
                    pick = np.flatnonzero(lengths == length)
                    rows = unit(flat[ends[pick][:, None] + np.arange(length)].astype(np.float64))
                    cells[pick] = signatures(rows, k, tables) ^ np.uint64(length) << np.uint64(32)
                mixed = (np.asarray(part.column(1)).view(np.uint64)[:, None] ^ cells) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)
                mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                cid = np.repeat(np.asarray(part.column(0)), tables)
                tab = np.tile(np.arange(tables, dtype=np.int32), len(lengths))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(tab), pa.array(mixed.reshape(-1).view(np.int64))], names=["cid", "tab", "bucket"])

    entries = classes.select("cid", "lab", "vector").mapInArrow(sign, "cid long, tab int, bucket long")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(split_join(entries, sizes, "bucket").select("cid", "tab", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks")))
    meetings = shared.agg(F.sum("chunks")).first()[0] or 0
    chunk = F.pmod(F.hash("cid"), F.col("chunks"))
    dealt = shared.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cid", "tab", "bucket", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    deals = max(1, -(-int(meetings) // GROUP))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("bucket", "ci", "cj"), F.lit(deals)))
    full = dealt.join(classes.select("cid", "vector", "weight"), "cid")
    match = lambda table: _links(table, threshold, k, tables)
    return full.groupBy("deal").applyInArrow(match, "a long, b long, n long")
