"""Tables kept as a base and deltas, changed together by versions.

A table is a set of Parquet parts, each dealt out by key bucket: base parts hold a key once, delta parts hold rows that
replace those of equal key, or mark them gone. A change writes only what it changes. A version is one small manifest
that lists the parts of all tables; a commit writes its parts first and then adds the next manifest, which fails if
another writer added it before. So a reader sees all of a commit, over all tables, or nothing, and parts never change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
MOST_DELTAS = 4  # deltas of a bucket that a reader merges before it is compacted


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made for."""


@dataclass
class Change:
    """What a commit does to a table: ``upserts`` (one row a key) replace or add, ``deletes`` (key columns) remove; or all is replaced."""

    keys: list[str]
    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    replace: bool = False


class Store:
    """Versioned tables below one folder. Null keys equal each other."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self.path(f"{self.root}/_versions")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "applied": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/_versions/{version:012d}.json").first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table: base rows that no delta names, and of each key in the deltas the last one, unless gone."""
        return self._rows(self.manifest(version)["tables"][table]).drop("_bucket")

    def _rows(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        names, keys = schema.fieldNames(), entry["keys"]
        stored = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])

        def of(parts: list[dict]) -> DataFrame:
            none = self.spark.createDataFrame([], stored).withColumn("_seq", F.lit(0).cast("long"))
            read = [self.spark.read.schema(stored).parquet(f"{self.root}/{p['path']}").where(F.col("_bucket").isin(*self._live(p, buckets))).withColumn("_seq", F.lit(p["seq"]).cast("long")) for p in parts if self._live(p, buckets)]
            return reduce(DataFrame.unionByName, read, none) if not read else reduce(DataFrame.unionByName, read)

        base, deltas = (of([p for p in entry["parts"] if p["base"] is kind]) for kind in (True, False))
        if not any(self._live(p, buckets) for p in entry["parts"] if not p["base"]):
            return base.select(*names, "_bucket")
        last = deltas.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys], "_gone"), "_seq").alias("_row"))
        named = last.select("_bucket", *[F.col(k).alias(f"_of_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [base[k].eqNullSafe(named[f"_of_{k}"]) for k in keys], base["_bucket"] == named["_bucket"])
        kept = base.join(named, same, "left_anti").select(*names, "_bucket")
        fresh = last.where("not _row._gone").select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in names], "_bucket")
        return kept.unionByName(fresh)

    @staticmethod
    def _live(part: dict, buckets: list[int] | None) -> list[int]:
        return part["buckets"] if buckets is None else [b for b in part["buckets"] if b in buckets]

    def _write(self, table: str, rows: DataFrame, keys: list[str], seq: int, base: bool) -> dict | None:
        """Write rows (with _gone) as a part; None if there are none."""
        path = f"{table}/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{path}"))]
        live = sorted(int(n.partition("=")[2]) for n in found if n.startswith("_bucket="))
        return {"path": path, "seq": seq, "base": base, "buckets": live} if live else None

    def commit(self, changes: dict[str, Change], expected: int | None = None, applied: tuple[str, int] | None = None) -> int:
        """Apply changes to several tables as one version; returns it. Raises ``Conflict`` if ``expected`` (default: the version now) is no longer the newest.

        ``applied`` (name, number) notes a batch of a stream: one that is noted already is not applied again.
        """
        version = self.version() if expected is None else expected
        state = self.manifest(version)
        if applied and state["applied"].get(applied[0], -1) >= applied[1]:
            return version
        for table, change in changes.items():
            state["tables"][table] = self._changed(table, state["tables"].get(table), change, version + 1)
        if applied:
            state["applied"][applied[0]] = applied[1]
        self._publish(state | {"version": version + 1})
        return version + 1

    def _changed(self, table: str, entry: dict | None, change: Change, seq: int) -> dict:
        rows = change.upserts
        if entry is None or change.replace:
            schema = rows.schema if rows is not None else T.StructType.fromJson(entry["schema"])
            part = self._write(table, rows.withColumn("_gone", F.lit(False)), change.keys, seq, True) if rows is not None else None
            return {"keys": change.keys, "schema": schema.jsonValue(), "parts": [part] if part else []}
        schema = T.StructType.fromJson(entry["schema"])
        delta = rows.select(*schema.fieldNames(), F.lit(False).alias("_gone")) if rows is not None else None
        if change.deletes is not None:
            gone = change.deletes.select(*entry["keys"]).distinct()
            if rows is not None:
                fresh = rows.select(*[F.col(k).alias(f"_of_{k}") for k in entry["keys"]])
                gone = gone.join(fresh, reduce(lambda a, b: a & b, [gone[k].eqNullSafe(fresh[f"_of_{k}"]) for k in entry["keys"]]), "left_anti")
            marks = gone.select(*[F.col(f.name) if f.name in entry["keys"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(True).alias("_gone"))
            delta = marks if delta is None else delta.unionByName(marks)
        part = self._write(table, delta, entry["keys"], seq, False) if delta is not None else None
        return entry | {"parts": [*entry["parts"], *([part] if part else [])]}

    def _publish(self, state: dict) -> None:
        target = f"{self.root}/_versions/{state['version']:012d}.json"
        draft = f"{self.root}/_versions/.draft-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        once = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.path(draft), self.path(target), once)
        except Py4JJavaError as e:
            self.fs.delete(self.path(draft), False)
            if self.fs.exists(self.path(target)):
                raise Conflict(f"version {state['version']} is another writer's") from e
            raise

    def compact(self, table: str, most: int = MOST_DELTAS) -> int:
        """Rewrite the buckets of more than ``most`` deltas into base parts, as a version of its own; the newest version if there are none."""
        state = self.manifest()
        entry = state["tables"][table]
        deltas = [b for p in entry["parts"] if not p["base"] for b in p["buckets"]]
        full = sorted(b for b in set(deltas) if deltas.count(b) > most)
        if not full:
            return state["version"]
        part = self._write(table, self._rows(entry, full).drop("_bucket").withColumn("_gone", F.lit(False)), entry["keys"], state["version"] + 1, True)
        kept = [p | {"buckets": [b for b in p["buckets"] if b not in full]} for p in entry["parts"]]
        entry["parts"] = [p for p in kept if p["buckets"]] + ([part] if part else [])
        self._publish(state | {"version": state["version"] + 1})
        return state["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the ``keep`` newest versions, and the parts that only those name."""
        newest = self.version()
        names = range(max(1, newest - keep + 1), newest + 1)
        used = {p["path"] for v in names for e in self.manifest(v)["tables"].values() for p in e["parts"]}
        old = [v for v in (int(s.getPath().getName()[:12]) for s in self.fs.listStatus(self.path(f"{self.root}/_versions")) if s.getPath().getName()[0].isdigit()) if v not in names]
        tables = {t for v in [*old, *names] for t in self.manifest(v)["tables"]}
        for v in old:
            self.fs.delete(self.path(f"{self.root}/_versions/{v:012d}.json"), False)
        for t in tables:
            for s in self.fs.listStatus(self.path(f"{self.root}/{t}")):
                if f"{t}/{s.getPath().getName()}" not in used:
                    self.fs.delete(s.getPath(), True)


def retried(store: Store, change: Callable[[int], dict[str, Change]], tries: int = 5, applied: tuple[str, int] | None = None) -> int:
    """Commit what ``change`` makes of the newest version, anew after each conflict."""
    for k in range(tries):
        version = store.version()
        try:
            return store.commit(change(version), expected=version, applied=applied)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries must be positive")


def replace_owned(store: Store, owner: str, value: object, rows: dict[str, DataFrame]) -> int:
    """All rows of one owner (a service) in several tables replaced together: dependencies, interfaces and metrics of a sync.

    What the owner had and ``rows`` (table to its new rows) lacks, is removed; rows of other owners are not touched.
    """

    def change(version: int) -> dict[str, Change]:
        entries = store.manifest(version)["tables"]
        out = {}
        for table, fresh in rows.items():
            keys = entries[table]["keys"]
            had = store.read(table, version).where(F.col(owner).eqNullSafe(F.lit(value)))
            out[table] = Change(keys, upserts=fresh, deletes=had.select(*keys))
        return out

    return retried(store, change)
