"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Up to so many edges (16 MB) one task joins them; more are joined by shuffles.
FEW_EDGES = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, in order, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def components(edges: DataFrame, a: str = "a", b: str = "b", count: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge.

    count is the number of edges, or a bound of it, where that is known: few
    edges are joined in one task, as each round of the way below costs several
    shuffles, whose tasks the driver has to keep account of.

    That way alternates large-star and small-star steps until the edges are stars whose
    centre is the smallest node. Each step is a min-aggregate, combined before
    the shuffle, and a join of the edges with one row per node, so neither
    neighbours nor components are gathered anywhere. The number of rounds grows
    with the logarithm of the nodes (at most its square), so the loop ends.
    """
    if count is not None and count <= FEW_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [[np.asarray(c) for c in batch.columns] for batch in batches if batch.num_rows]
            if ends:
                found = smallest_reachable(*map(np.concatenate, zip(*ends, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])

        return edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").coalesce(1).mapInArrow(run, "node long, component long")
    steps = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).filter("u <> w").distinct()
    now = None
    while True:
        last = now
        now = stash(steps, "edges")
        if last is not None:
            discard(last)
        # stars: a node has one smaller neighbour or larger ones, not both
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("w", F.lit(0), F.lit(1)))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1")
        if not odd.limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("w").alias("component")).union(now.select("w", "w").distinct())
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = now.union(now.select("w", "u"))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["of"]).filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        # small star: the smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(low, large["u"] == low["of"])
        moved = small.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        steps = moved.union(low.select("of", "m")).distinct()
