"""Staleness over many inputs by a tree of digests: one for each folder, made from those below it.

A folder's digest is a sum over its children, so a folder of any size is aggregated before it is shuffled. Two trees are
compared from the root down, and only folders whose digests differ are entered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def hash_tree(files: DataFrame) -> DataFrame:
    """node, parent, depth, leaf, digest of files (path, hash; paths are unique) and of all their folders; the root is ``""``, at depth 0."""
    leaves = files.select(F.col("path").alias("node"), _parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit(True).alias("leaf"), F.col("hash").cast("string").alias("digest"))
    tree = staged(leaves, "hash-tree")
    level = tree.agg(F.max("depth")).first()[0] or 0
    made = [tree]
    for depth in range(level, 0, -1):
        below = made[0].where(F.col("depth") == depth)
        below = below if len(made) == 1 else below.unionByName(made[-1])
        part = lambda salt: F.sum(F.xxhash64("node", "digest", F.lit(salt)).cast("decimal(38,0)"))  # noqa: B023, E731
        up = below.groupBy(F.col("parent").alias("node")).agg(F.sha2(F.concat_ws(":", F.count("*"), part(0), part(1)), 256).alias("digest"))
        parent = F.when(F.col("node") == "", F.lit(None).cast("string")).otherwise(_parent(F.col("node")))
        made.append(staged(up.select("node", parent.alias("parent"), F.lit(depth - 1).alias("depth"), F.lit(False).alias("leaf"), "digest"), "hash-tree"))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def input_hash(tree: DataFrame) -> DataFrame:
    """digest of all inputs together: the root's."""
    return tree.where("node = '' and not leaf").select("digest")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) of files between two trees, by way of the folders that differ."""
    side = lambda t, c: t.select("parent", "node", "leaf", F.col("digest").alias(c))
    top = side(old, "a").where("node = '' and not leaf").join(side(new, "b").where("node = '' and not leaf").select("b", F.lit(1).alias("_")), F.lit(True), "full").where("not (a <=> b)")
    frontier = staged(top.select(F.lit("").alias("node")), "stale")
    found = None
    while not frontier.isEmpty():
        of = frontier.select(F.col("node").alias("parent"))
        a, b = side(old, "a").join(of, "parent", "left_semi"), side(new, "b").join(of, "parent", "left_semi")
        met = staged(a.join(b, ["parent", "node", "leaf"], "full").where("not (a <=> b)"), "stale")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
        files = met.where("leaf").select(F.col("node").alias("path"), change.alias("change"))
        found = files if found is None else found.unionByName(files)
        frontier = met.where("not leaf").select("node")
    return old.select(F.col("node").alias("path"), F.lit("").alias("change")).limit(0) if found is None else found
