"""Which records lead to given ones by links of any length, in few rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root: the smallest node of its component.

    Rounds of stars: first every larger neighbour of a node goes to the smallest one it knows,
    then every smaller one; a path of n nodes takes about log n rounds. Loops and repeats change
    nothing. A node's neighbours are reduced by a partial aggregate and joined by node.
    """
    edges, seen = written(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        for large in (True, False):
            near = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m") if large else F.col("m"))
            joined = near.join(least, F.col("a") == F.col("c"))
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
            edges = moved.filter("a <> b").distinct()
        edges = written(edges)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = (now["n"], now["h"])


def leading_to(links: DataFrame, ends: DataFrame, rounds: list | None = None) -> DataFrame:
    """The ids of ends and all that lead to one of them by links (id, target).

    Records that link to each other stand or fall together and become one. Then each round takes
    what links to an end, and a link to a record with a single link of its own is replaced by
    that one, so that unbranched chains are halved. A chain of n takes about log2(n) rounds;
    where every record of a path branches, a round takes one step of it. Each round begins from
    written tables. rounds: gets the number of links left in each round. Circles that reach no
    end, links of a record to itself and repeated links change nothing.
    """
    links = written(links.select("id", "target").filter("id <> target").distinct())
    back = links.select(F.col("target").alias("id"), F.col("id").alias("target"))
    groups = components(links.join(back, ["id", "target"]).filter("id < target").select(F.col("id").alias("a"), F.col("target").alias("b")))
    groups = written(groups.withColumnRenamed("node", "id"))

    def grouped(df: DataFrame, column: str) -> DataFrame:
        to = groups.select(F.col("id").alias(column), "root")
        return df.join(to, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

    left = written(grouped(grouped(links, "id"), "target").filter("id <> target").distinct())
    found = written(grouped(ends.select("id"), "id").distinct())
    while True:
        more = written(left.join(found.select(F.col("id").alias("target")), "target", "left_semi").select("id").distinct().join(found, "id", "left_anti"))
        if rounds is not None:
            rounds.append(left.count())
        if more.isEmpty():
            break
        found = written(found.union(more))
        left = left.join(found, "id", "left_anti")
        single = left.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("next")).filter("n = 1").select(F.col("id").alias("target"), "next")
        left = written(left.join(single, "target", "left").select("id", F.coalesce("next", "target").alias("target")).filter("id <> target").distinct())
    members = groups.join(found.withColumnRenamed("id", "root"), "root", "left_semi").select("id")
    return written(found.union(members).distinct())
