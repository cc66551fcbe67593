"""Registered queries: a plan over one folder of tables, and the same result in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.code_graph import CodeGraph
from ..operators.system_graph import SystemGraph
from ..sources.adapters import relation, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Relations and graphs over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = relation(self.spark, self.sf_dir, name)
        return self._made[name]

    @property
    def code(self) -> CodeGraph:
        return CodeGraph(self)

    @property
    def system(self) -> SystemGraph:
        return SystemGraph(self)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


def query(sql: str | None = None) -> Callable:
    """Register a function of a Source under its own name, with its oracle (relations may be named in it)."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_clause(sql)
        return f

    return add
