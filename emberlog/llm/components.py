"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mins(edges: DataFrame, node: str) -> DataFrame:
    # written before it is joined, so that the join meets a plain exchange on
    # either side and a node with very many neighbours can be split
    return materialize(edges.groupBy(node).agg(F.min("other").alias("least")), "mins")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("node", "other").union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    least = _mins(both, "node").select("node", F.least("node", "least").alias("least"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).where("node != other")
    least = _mins(down, "node")
    hung = down.join(least, "node").where("other != least").select(F.col("other").alias("node"), F.col("least").alias("other"))
    return hung.union(least.select("node", F.col("least").alias("other"))).distinct()


def _connected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, root`` of the edges of all frames, by union and find; as by steps, roots have no row of their own."""
    pairs = np.concatenate([np.empty((0, 2), np.int64), *(f[["node", "other"]].to_numpy(np.int64) for f in frames)])
    nodes, at = np.unique(pairs, return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = nodes[np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))]
    hung = nodes != roots
    yield pd.DataFrame({"node": nodes[hung], "root": roots[hung]})


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """``node, root`` for each node of ``edges(node, other)``, root the least node reachable.

    Every step is a join or an aggregate over edges: nothing is gathered on the
    driver but the two numbers that tell whether a round changed anything.  Edges
    from a node to itself and repeated edges do no harm; no edges, no rows.

    Up to ``at_once`` different edges are connected by one task instead, which
    gives the same rows without a dozen jobs a round.  ``node`` is a long then.
    """
    edges = materialize(edges.where("node != other").distinct(), "edges")
    if at_once and edges.count() <= at_once:
        return materialize(edges.coalesce(1).mapInPandas(_connected, "node long, root long"), "roots")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select("node", F.col("other").alias("root"))
        before = now
