"""Shared intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, tuple[SparkSession, str]] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, one of our own, for a local master only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodemap-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _drop(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has already ended
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; removed when the driver exits."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if shared not in _roots:
        _roots[shared] = (spark, f"{shared}/lodemap-{uuid.uuid4().hex}")
        atexit.register(_drop, *_roots[shared])
    path = f"{_roots[shared][1]}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote and nothing reads any more."""
    ref, path = _paths.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        _drop(df.sparkSession, path)
