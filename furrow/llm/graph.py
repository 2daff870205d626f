"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import cut

#: Edges up to which one task finds the components (16 bytes each, and some ten times that while it works); more take rounds of joins.
FEW = 500_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), in order, and for each the least node that links reach: roots hang on lesser roots, and every path is halved, until no edge joins two trees."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while ((above := root[root]) != root).any():
            root = above


def least_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if got:
        node, component = least_reached(*(np.concatenate(c) for c in zip(*got, strict=True)))
        for i in range(0, len(node), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 10_000]), pa.array(component[i : i + 10_000])], names=["node", "component"])


def star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star (every larger neighbour goes to the least neighbour) or small-star (every smaller one does) step.

    The least neighbour comes from a grouped minimum, which is summed up before the shuffle, and meets the
    edges in a plain join whose large partitions can be split: a node's neighbours never sit in one list.
    """
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    moved = both.join(least, both.u == least.c)
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (u, v) the least node that links reach. Alternating large-star and small-star steps until nothing changes; few edges, which are counted first, go to one task instead."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")), "graph")
    if edges.count() <= FEW:
        return cut(edges.coalesce(1).mapInArrow(least_batches, "node long, component long"), "graph")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    was = state(edges)
    for _ in range(most_rounds):
        edges = cut(star(star(edges, small=False), small=True), "graph")
        now = state(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = now
    raise RuntimeError("the components have not settled")
