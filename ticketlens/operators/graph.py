"""Connected components as DataFrame joins (large-star / small-star contraction)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.plans.shared import forget, spread_join, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node that it sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return spread_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _finished(edges: DataFrame) -> DataFrame:
    """(b) of the stars that no further round can change: a root without smaller neighbours all of whose leaves have no other edge."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    leaves = edges.join(nodes.filter("up = 1 AND down = 0").select(F.col("v").alias("a")), "a", "left_semi").groupBy("b").agg(F.count("*").alias("leaves"))
    return leaves.join(nodes.filter("up = 0").select(F.col("v").alias("b"), "down"), "b").filter("leaves = down").select("b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of at least one edge; component is its smallest node.

    Null ends and loops are ignored; repeated edges and either direction mean the same. Components
    that have become stars leave after each round, so only what still changes goes on, and the number of edges never
    grows. Each round's edges are a table of known size in the shared folder, a node with
    a large share of the edges is spread over tasks, and the driver sees counts only.
    """
    a, b = F.col(src), F.col(dst)
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    stars = [now.limit(0)]
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        large = stored(_large_star(now))
        small = stored(_small_star(large))
        forget(large)
        marked = stored(small.join(_finished(small).withColumn("done", F.lit(True)), "b", "left").select("a", "b", F.coalesce("done", F.lit(False)).alias("done")))
        forget(small)
        now = marked.filter("NOT done").select("a", "b")
        stars.append(marked.filter("done").select("a", "b"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = reduce(DataFrame.union, stars)
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends.select(F.col("b"), F.col("b")).distinct())
