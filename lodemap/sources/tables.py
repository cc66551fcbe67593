"""Tables: staged intermediates, whole-table overwrite, upserts, appends, snapshot rings."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one of our own, for a local master only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodemap-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def shared_folder(spark: SparkSession) -> str:
    """A folder of this driver's own below the shared one; it goes when the driver exits."""
    shared = _shared(spark)
    if shared not in _folders:
        _folders[shared] = f"{shared}/staged-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[shared])
    return _folders[shared]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, goes when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over as many tasks as the session shuffles to: small files hold few bytes, but may mean much work for a parser."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last wins: rows of ``new`` (by ``order`` within it) replace rows of ``old`` of equal key."""
    fresh = new
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First wins: rows of ``new`` are added where no row of their key exists; within ``new`` the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Remove the keys in ``gone`` from the parents and, by their foreign key, from each child table."""
    dropped = gone.select(F.col(key)).distinct()
    kept = parents.join(dropped, key, "left_anti")
    return kept, {n: df.join(dropped.withColumnRenamed(key, fk), fk, "left_anti") for n, (df, fk) in children.items()}


def newest(df: DataFrame, order: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """The last ``most`` rows in descending ``order`` (per group ``by``): the retention rule of logs and snapshots."""
    if not by:
        return df.orderBy(*[F.desc(c) for c in order]).limit(most)
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def overwrite(df: DataFrame, path: str) -> None:
    """Whole-table rebuild: write beside the target, then swap, so readers never see half a table."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(fresh)
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    had = fs.exists(target)
    if had:
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def save_snapshot(df: DataFrame, path: str, stamp: str, keep: int = 20) -> list[str]:
    """Append a snapshot as the partition ``snapshot=stamp``; older ones beyond ``keep`` go. Returns the stamps kept."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/snapshot={stamp}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("snapshot=")), reverse=True)
    for name in found[keep:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return [n.partition("=")[2] for n in found[:keep]]
