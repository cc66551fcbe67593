"""Joins by keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

HOT = 1000


def sized(parts: DataFrame, of: str) -> DataFrame:
    """``parts`` (one row for each key), written, with ``hot``: has at least a HOT-th of all that ``of`` sums up to; HOT rows at most."""
    parts = written(parts, "sizes")
    total = parts.agg(F.sum(of)).first()[0] or 0
    return parts.withColumn("hot", F.col(of) * HOT >= total)


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with rows from ``sized``: hot ones are broadcast, so that their many partners stay where they are; the others are shuffled."""
    hot = F.broadcast(right.where("hot"))
    cold = left.join(hot.select(*on), on, "left_anti").join(right.where("not hot"), on)
    return left.join(hot, on).unionByName(cold).drop("hot")
