"""Service metrics maintained by changes: signed counts, so that distinct neighbours can also become fewer.

Held are the number of dependency rows of each pair of services (``pairs``: consumer_id, provider_id, n) and each
service's numbers of neighbours and interfaces (``degrees``: service_id, fan_in, fan_out, interface_count). A change is
joined with what it touches; nothing is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["service_id", "fan_in", "fan_out", "interface_count", "coupling_score", "risk_level"]


def pairs_of(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("consumer_id", "provider_id").agg(F.count("*").alias("n"))


def changed_pairs(pairs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs after ``changes`` (consumer_id, provider_id, sign: 1 or -1 a dependency row), pairs that came or went with ``crossing`` 1 or -1)."""
    delta = changes.groupBy("consumer_id", "provider_id").agg(F.sum("sign").alias("d"))
    met = pairs.join(delta, ["consumer_id", "provider_id"], "full").select("consumer_id", "provider_id", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))
    crossing = (F.col("n") > 0).cast("long") - (F.col("was") > 0).cast("long")
    return met.where("n > 0").select("consumer_id", "provider_id", "n"), met.select("consumer_id", "provider_id", crossing.alias("crossing")).where("crossing <> 0")


def changed_degrees(degrees: DataFrame, crossings: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """Degrees after pairs came or went, and after ``interfaces`` (service_id, sign) did."""
    zero = F.lit(0).cast("long")
    moves = crossings.select(F.col("provider_id").alias("service_id"), F.col("crossing").alias("i"), zero.alias("o"), zero.alias("f"))
    moves = moves.unionByName(crossings.select(F.col("consumer_id").alias("service_id"), zero.alias("i"), F.col("crossing").alias("o"), zero.alias("f")))
    if interfaces is not None:
        moves = moves.unionByName(interfaces.select("service_id", zero.alias("i"), zero.alias("o"), F.col("sign").cast("long").alias("f")))
    moves = moves.groupBy("service_id").agg(*[F.sum(c).alias(c) for c in "iof"])
    plus = lambda c, d: (F.col(c) + F.coalesce(d, zero)).alias(c)
    return degrees.join(moves, "service_id", "left").select("service_id", plus("fan_in", "i"), plus("fan_out", "o"), plus("interface_count", "f"))


def _scored(degrees: DataFrame, most: Column) -> DataFrame:
    i, o = F.col("fan_in"), F.col("fan_out")
    c = i * o / most
    level = F.when(i >= 10, "critical").when((i >= 5) & (o >= 3), "high").when((i >= 3) | (c > 0.5), "medium").otherwise("low")
    return degrees.select("service_id", i, o, "interface_count", c.alias("coupling_score"), level.alias("risk_level"))


def _largest(of: DataFrame) -> DataFrame:
    return of.agg(F.greatest(F.coalesce(F.max(F.col("fan_in") * F.col("fan_out")), F.lit(1)), F.lit(1)).alias("_most"))


def updated(metrics: DataFrame, degrees: DataFrame, pairs: DataFrame, synced: DataFrame, exact: bool = False) -> DataFrame:
    """METRICS after a sync of the services in ``synced`` (service_id), from degrees and pairs after it.

    By default only those services and their present neighbours get new rows, scored by the largest product among the
    rows that stood before: a maximum that has since moved, and rows of former neighbours, stay as they were until they
    are synced. ``exact`` gives all services what a full recomputation gives.
    """
    if exact:
        return _scored(degrees.join(F.broadcast(_largest(degrees)), F.lit(True)), F.col("_most"))
    a = pairs.join(synced.select(F.col("service_id").alias("provider_id")), "provider_id", "left_semi").select(F.col("consumer_id").alias("service_id"))
    b = pairs.join(synced.select(F.col("service_id").alias("consumer_id")), "consumer_id", "left_semi").select(F.col("provider_id").alias("service_id"))
    affected = synced.select("service_id").unionByName(a).unionByName(b).distinct()
    fresh = degrees.join(affected, "service_id", "left_semi").join(F.broadcast(_largest(metrics)), F.lit(True))
    return metrics.select(*METRICS).join(affected, "service_id", "left_anti").unionByName(_scored(fresh, F.col("_most")))
