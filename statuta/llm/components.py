"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: So many edges of forests are united in one task; more go by stars.
FEW = 200_000


def _forest(frames):
    """Edges of a spanning forest of a partition's edges, each to the smallest node of its tree."""
    up: dict[int, int] = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 2_000_000:  # a worker holds no more nodes; what is known goes on as edges
            out = [(x, root(x)) for x in up if root(x) != x]
            up.clear()
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    yield pd.DataFrame([(x, root(x)) for x in up if root(x) != x], columns=["a", "b"], dtype="int64")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node goes to its smallest one; small star: the node and its smaller neighbours do."""
    near = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("c"), "m")
    joined = near.join(least, F.col("a") == F.col("c"))
    out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), both long; root: the smallest node reachable.

    Loops and repeated edges change nothing; no edges give no rows. No step gathers a
    component: a node's edges are reduced by a partial aggregate and joined by node.
    """
    edges = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInPandas(_forest, "a long, b long"))
    if edges.limit(FEW + 1).count() <= FEW:  # one task reads them all
        edges = materialize(edges.coalesce(1).mapInPandas(_forest, "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    seen = None
    while True:
        edges = materialize(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen or not now["n"]:
            break
        seen = (now["n"], now["h"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
