"""Connected components of a graph of any size, as DataFrames.

Up to ONE_TASK links (counted first) are joined in one task, as arrays. Beyond that, large-star and small-star steps
alternate (each a grouped minimum, which combines before its shuffle, and an equi-join, which AQE splits at a
hub), so that the number of rounds grows with the logarithm of a component's diameter. Every round is cut
into the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, gathered, lean, release


#: Links of two 64-bit nodes that one task joins, some tens of MB there; more are joined by rounds of shuffles.
ONE_TASK = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(u):
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if parts:
            found = least_reachable(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(lean(run), "node long, component long")


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of links(a, b); no links, no rows."""
    edges = gathered(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if edges.count() <= ONE_TASK:
        return in_one_task(edges)
    state = None
    while True:
        # large star: each node's larger neighbours move to its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        edges = cut(
            moved.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    release(links.sparkSession)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
