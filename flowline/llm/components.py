"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import materialise


def forest(links: np.ndarray) -> np.ndarray:
    """A spanning forest of integer pairs (n, 2): every node linked to its component's smallest node.

    Works by repeated minimum propagation with pointer jumping, so it needs a few vector passes.
    """
    if not len(links):
        return links.reshape(0, 2).astype(np.int64)
    nodes, flat = np.unique(links, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[child]], nodes[child]], 1).astype(np.int64)


def spanning(links: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The pairs of a minimum spanning forest of integer pairs (n, 2): at most one less than there are nodes, each a given pair.

    Boruvka's rounds: every component takes its lightest pair that leads out, and ties go by position.
    """
    links = links[np.argsort(weights, kind="stable")]
    if not len(links):
        return links
    nodes, flat = np.unique(links, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root, taken = np.arange(len(nodes)), np.zeros(len(links), bool)
    while len(out := np.flatnonzero(root[a] != root[b])):
        best = np.full(len(nodes), len(links))
        np.minimum.at(best, root[a[out]], out)
        np.minimum.at(best, root[b[out]], out)
        chosen = np.unique(best[best < len(links)])
        taken[chosen] = True
        merged = forest(np.stack([root[a[chosen]], root[b[chosen]]], 1))
        new = np.arange(len(nodes))
        new[merged[:, 0]] = merged[:, 1]
        root = new[root]
    return links[taken]


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (u, v); nodes without links are absent.

    Each round first hangs the larger neighbours of every node on its smallest neighbour, then does
    the same for the smaller ones (Kiveris et al., Connected Components in MapReduce and Beyond).
    It ends when a round changes nothing, within about the square of the logarithm of the longest path.
    Only one group-by minimum and one equi-join run per half round, so a node with very many links
    makes no group that must be held in memory.  Every round's links are written to the shared folder.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        # large star: neighbours above a node hang on the smallest of the node and its neighbours
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "edges")
        # small star: neighbours below a node, and the node, hang on the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does: count and sum of hashes (each modulo a prime, so that no sum overflows)."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s"), F.sum(F.xxhash64("v", "u") % 998_244_353).alias("t")).first()
    return (row["n"], row["s"], row["t"])
