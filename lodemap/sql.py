"""The library through ``spark.sql``: its parsers as table functions, its relations as temporary views.

``register(spark, folder)`` makes ``extract_symbols``, ``extract_imports``, ``extract_parents`` and ``extract_calls``
(path, language, text) usable in FROM clauses, and, given a folder of tables, these and all relations as views.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .sources import structure
from .sources.adapters import RELATIONS, TABLES, relation

FUNCTIONS = {
    "extract_symbols": (structure.symbols_of, structure.SYMBOLS),
    "extract_imports": (structure.imports_of, structure.IMPORTS),
    "extract_parents": (structure.parents_of, structure.PARENTS),
    "extract_calls": (structure.calls_of, structure.CALLS),
}


def _table_function(find: Callable[[str, str], list[tuple]], schema: str):
    class Extract:
        def eval(self, path: str, language: str, text: str) -> Iterator[tuple]:
            for row in find(text or "", language or ""):
                yield (path, *row)

    return udtf(Extract, returnType=schema)


def register(spark: SparkSession, folder: str | None = None) -> None:
    """Nulls count as empty texts and unknown languages, which give no rows. Views are lazy: a query reads what it names."""
    for name, (find, schema) in FUNCTIONS.items():
        spark.udtf.register(name, _table_function(find, schema))
    if folder is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [t for t in TABLES if fs.exists(path(f"{folder}/{t}.parquet"))]
    for name in there:
        relation(spark, folder, name).createOrReplaceTempView(name)
    for name in RELATIONS:
        relation(spark, folder, name).createOrReplaceTempView(name)
