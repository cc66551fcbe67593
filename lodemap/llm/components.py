"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root (the smallest node reachable) of every node in ``edges`` (a, b: long); loops and repeats are allowed.

    Each round is a minimum per node (combined before the shuffle) and a join, so a hub of any degree is split over
    tasks. Edges stay distributed; only whether stars still move reaches the driver. If they do after ``most_rounds``, that is an error.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, cur = cur, written(small.where("a <> b").distinct(), "small-stars")
        discard(last)
        discard(large)
        heads = cur.select(F.col("b").alias("a")).distinct()
        moving = cur.groupBy("a").count().where("count > 1").select("a").unionByName(cur.join(heads, "a", "left_semi").select("a"))
        if moving.isEmpty():  # every node hangs on one head that hangs on none
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = cur.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) with further ``links`` (a, b), by way of the components of the roots that they join."""
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    apart = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    apart = written(apart, "links-between")
    if apart.isEmpty():
        return roots
    over = written(connected_components(apart), "joined-roots").select(F.col("node").alias("root"), F.col("root").alias("over"))
    old = roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    fresh = over.select(F.col("root").alias("node"), F.col("over").alias("root")).join(roots.select("node"), "node", "left_anti")
    return written(old.unionByName(fresh), "roots")
