"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``CELLS`` cells. Each shard owns ``virtual`` nodes at hashed cells; a key belongs to the first node at
or after its cell. Loads are bounded by shard, to the exact quota, so shards differ by one row at most. A shard keeps
what its nodes get up to its quota; only the surplus of a fuller shard, taken from its nodes in proportion to what they
got, the last of each in ring order, continues clockwise to the next free places, which an emptier shard spreads evenly
over its nodes. Because surplus and free places add up to the same, that walk has a closed form: from the node after
which the running surplus is smallest, the k-th overflowing key takes the k-th free place. Only tables of cells and
nodes (fixed size) are scanned in order; keys are ranked within their cells.

One more shard moves what it takes over, a key in ``shards`` + 1, and what is surplus with either number: some 0.4 times
the relative deviation of the shards' loads, 1 / sqrt(``virtual``), each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written

CELLS = 1 << 18
VIRTUAL = 512


def _nodes(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """cell, node (its place in ring order), shard, nth (which of its shard's nodes): fixed size, whatever the input."""
    pairs = spark.range(shards).select(F.col("id").alias("shard")).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    placed = pairs.withColumn("cell", F.pmod(F.xxhash64(F.lit("node"), "shard", "nth"), F.lit(CELLS)))
    order = Window.orderBy("cell", "shard", "nth")
    return placed.withColumn("node", F.row_number().over(order) - 1)


def _owners(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """cell, node: the first node at or after each cell, clockwise."""
    first = nodes.groupBy("cell").agg(F.min("node").alias("node"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    cells = spark.range(CELLS).select(F.col("id").alias("cell")).join(first, "cell", "left")
    return cells.select("cell", F.coalesce(F.last("node", ignorenulls=True).over(after), F.lit(0)).alias("node"))


def assign(keys: DataFrame, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to rows with a ``ring_key`` long column.

    Counts of shards differ by one at most. Rows with equal keys are told apart by their place only, so repeated rows
    each get a slot of their own; keys should be spread, a null key counts as a key. An empty input stays empty.
    """
    spark = keys.sparkSession
    kept = keys.columns
    nodes = written(_nodes(spark, shards, virtual), "nodes")
    owners = _owners(spark, nodes)
    hashed = keys.withColumn("_hash", F.xxhash64(F.coalesce("ring_key", F.lit(-1)))).withColumn("_cell", F.pmod("_hash", F.lit(CELLS)))

    counts = hashed.groupBy("_cell").count().select(F.col("_cell").alias("cell"), F.col("count").alias("n"))
    ring = owners.join(counts, "cell", "left").fillna(0, ["n"])
    up_to = Window.partitionBy("node").orderBy(F.col("_turn"), F.col("cell")).rowsBetween(Window.unboundedPreceding, -1)
    # cells past the last node belong to node 0 and come before its other cells
    last = nodes.agg(F.max("cell")).first()[0]
    ring = ring.withColumn("_turn", F.when(F.col("cell") > last, 0).otherwise(1))
    cells = written(ring.select("cell", "node", "n", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before")), "cells")

    loads = cells.groupBy("node").agg(F.sum("n").alias("load"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    per = nodes.join(loads, "node", "left").fillna(0, ["load"])
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    in_shard = Window.partitionBy("shard")
    so_far = in_shard.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_q", quota).withColumn("_l", F.sum("load").over(in_shard)).withColumn("_sum", F.sum("load").over(so_far))
    part = lambda whole, of, by: F.expr(f"cast({whole} as decimal(19,0)) * cast({of} as decimal(19,0)) div cast({by} as decimal(19,0))")
    per = per.withColumn("_over", F.greatest(F.col("_l") - F.col("_q"), F.lit(0))).withColumn("_under", F.greatest(F.col("_q") - F.col("_l"), F.lit(0)))
    per = per.withColumn("own", F.col("load") - part("_over", "_sum", "greatest(_l, 1)") + part("_over", "(_sum - load)", "greatest(_l, 1)"))
    per = per.withColumn("quota", F.col("own") + part("_under", "(nth + 1)", virtual) - part("_under", "nth", virtual))
    per = per.withColumn("base", F.coalesce(F.sum("quota").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_s", F.sum(F.col("load") - F.col("quota")).over(running))
    per = per.withColumn("_start", F.min_by("node", F.struct("_s", "node")).over(Window.partitionBy()))
    per = per.withColumn("_turned", F.pmod(F.col("node") - F.col("_start") - 1, F.lit(shards * virtual)))
    earlier = Window.orderBy("_turned").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("spill", F.coalesce(F.sum(F.col("load") - F.col("own")).over(earlier), F.lit(0)))
    per = per.withColumn("free", F.coalesce(F.sum(F.col("quota") - F.col("own")).over(earlier), F.lit(0)))
    per = written(per.select("node", F.col("shard").cast("int").alias("shard"), "load", "own", "quota", "base", "spill", "free"), "loads")

    # segments of the overflow: cut wherever a source node's surplus or a target node's free places begin
    source = per.where("load > own").select(F.col("spill").alias("at"), F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"))
    target = per.where("quota > own").select(F.col("free").alias("at"), F.lit(None).cast("long").alias("src"), F.col("node").alias("dst"))
    cuts = source.unionByName(target).groupBy("at").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
    along = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = cuts.select("at", F.last("src", True).over(along).alias("src"), F.last("dst", True).over(along).alias("dst"), F.lead("at").over(Window.orderBy("at")).alias("until"))
    a, b = per.alias("a"), per.alias("b")
    moved = parts.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).select(
        F.col("src").alias("node"),
        (F.col("a.own") + F.col("at") - F.col("a.spill")).alias("lo"),
        F.coalesce(F.col("a.own") + F.col("until") - F.col("a.spill"), F.col("a.load")).alias("hi"),
        F.col("b.shard").alias("shard"),
        (F.col("b.base") + F.col("b.own") + F.col("at") - F.col("b.free")).alias("slot0"),
    )
    stay = per.where("own > 0").select("node", F.lit(0).cast("long").alias("lo"), F.col("own").alias("hi"), "shard", F.col("base").alias("slot0"))
    places = written(stay.unionByName(moved), "places")  # at most three rows for each node

    within = Window.partitionBy("_cell").orderBy("_hash", *[F.col(f"`{c}`") for c in kept])
    ranked = hashed.withColumn("_r", F.row_number().over(within) - 1)
    where = F.broadcast(cells.select(F.col("cell").alias("_cell"), F.col("node").alias("_node"), F.col("before").alias("_before")))
    ranked = ranked.join(where, "_cell").withColumn("_k", F.col("_r") + F.col("_before"))
    joined = ranked.join(F.broadcast(places), (F.col("_node") == F.col("node")) & (F.col("_k") >= F.col("lo")) & (F.col("_k") < F.col("hi")))
    return joined.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("slot0") + F.col("_k") - F.col("lo")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL) -> DataFrame:
    """Contract rows: doc_id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null under this law).

    The ring key is doc_id; where it is null, a hash of the text. Null texts have no bytes. Rows that are repeated
    each take a place of their own. Other columns are ignored.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("ring_key"),
    )
    out = assign(slim, shards, virtual)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
