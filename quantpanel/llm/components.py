"""Connected components of an edge table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.llm.common import remove, stored

#: A node of more than max(HOT_LEAST, edges / HOT_SHARE) neighbours is hot; there are at most 2 x HOT_SHARE of them.
HOT_LEAST, HOT_SHARE = 1_000, 1_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """rows joined with least (a, m, n) on a; hot nodes, bounded in number, are broadcast and so are no key of an exchange."""
    hot = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))
    rest = rows.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
    return rows.join(hot, "a").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a long, b long); component is the smallest node that is reachable.

    Each round ties all neighbours of a node to its smallest neighbour, first the larger ones, then the smaller ones; rounds end
    when the edges are stars around the smallest nodes, which takes about the logarithm of the longest path. Every round is
    written to the shared folder, and the one before is deleted. Loops and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    up, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, state = None, _state(up)
    while state[0] and state != before:
        limit = max(HOT_LEAST, state[0] // HOT_SHARE)
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where("b > a"), least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # each node of `large` has few neighbours left, all smaller: those it was tied to
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        up, new = stored(tied.select("a", F.col("m").alias("b")).unionByName(tied.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        before, state = state, _state(up)
        remove(spark, path)
        path = new
    stars = up.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
