"""Connected components of a link table, by alternating star contractions.

The large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) are written as a partial-aggregate minimum joined
back to the edges, so no neighbour list is ever gathered in one task: a hub's
edges stay spread over splittable join partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import cut, split_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Nulls, self-links and repeated links are allowed and add nothing; an empty
    table gives an empty result. Each round is checkpointed to the shared folder.
    """
    state = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _digest(state)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        state = cut(_small_star(_large_star(state)))
        after = _digest(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    members = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """The number of edges and two sums of independent hashes of 31 bits each."""
    sums = [F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.lit(0)) for h in (F.xxhash64("u", "v"), F.xxhash64("v", F.lit(1), "u"))]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node in its closed neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = split_join(both.where("v > u"), least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels (smallest index reachable) of ``n`` points under links ``a``–``b``, in numpy."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
