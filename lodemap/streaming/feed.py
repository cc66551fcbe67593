"""Incremental maintenance of the code graph from a change feed, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import changed_files
from ..sources import source_code, structure
from ..sources.versioned import Change, Store, retried

FEED = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("path", T.StringType()), ("old_path", T.StringType()), ("text", T.StringType()), ("ts", T.TimestampType()))])


def watch(spark: SparkSession, folder: str, schema: T.StructType = FEED) -> DataFrame:
    """The change feed as a stream of new files in ``folder``; ignored paths and foreign extensions are passed over."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kept = ext.isin(*source_code.LANGUAGES) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*source_code.IGNORED) | p.startswith("."))
    return spark.readStream.schema(schema).parquet(folder).where(kept)


def debounced(feed: DataFrame, quiet: str = "500 milliseconds", late: str = "2 seconds", by: str | None = None) -> DataFrame:
    """started, ended, paths: the distinct paths of each burst that ``quiet`` ends, per value of ``by`` (a project), if given.

    In append mode a burst comes out once an event ``late`` after its end has been seen; later events of it are lost.
    All events of one feed meet in one task: ``debounce`` is for a feed that is too long for that.
    """
    every = F.concat(F.substring("path", 1, 0), F.lit("all"))  # streams take no session windows without a key
    bursts = feed.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), (F.col(by) if by else every).alias("feed"))
    return bursts.agg(F.sort_array(F.collect_set("path")).alias("paths")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "paths")


#: What ``debounce`` writes, in microseconds: a path of a burst, whose first and last events are at ``started`` and ``ended``.
BURSTS = "path string, started long, ended long, closed boolean"
#: So many stretches of quiet time are put in order by one task.
CHUNK = 4096
#: Stretches of more events than this are few enough for every task to know them, so that none has to take all events of one.
HEAVY = 200_000


def debounce(feed: DataFrame, out: str, checkpoint: str, quiet: str = "500 milliseconds", late: str = "2 seconds", once: bool = True) -> StreamingQuery:
    """``debounced`` for a feed of any length, written to ``out`` to be read by ``bursts``: its events are dealt out over all tasks.

    Events less than ``quiet`` apart are one burst, so a stretch of that length needs no more than its first and last; the paths
    follow when the bursts of the stretches are known. A batch leaves its bursts below its own number, whole: the next one takes up
    those that are still open, and a batch that comes again after a restart replaces what it left.
    """
    spark, path = feed.sparkSession, feed.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(out))  # also for a feed without events
    gap, wait = (F.expr(f"unix_micros(timestamp_micros(0) + interval {x})") for x in (quiet, late))

    def merge(batch: DataFrame, number: int) -> None:
        pieces = batch.where("ts is not null").select("path", F.unix_micros("ts").alias("first"), F.unix_micros("ts").alias("last"))
        seen = None
        if number:
            held = batch.sparkSession.read.schema(BURSTS).parquet(f"{out}/batch={number - 1}").where("not closed")
            seen = held.agg(F.max("ended")).first()[0]  # the burst of the newest event is never closed
            if seen is not None:
                pieces = pieces.where(F.col("first") + gap >= F.lit(seen) - wait)
            pieces = pieces.unionByName(held.select("path", F.col("started").alias("first"), F.col("ended").alias("last")))
        pieces = pieces.withColumn("stretch", F.col("first") - F.pmod("first", gap))
        found = _bursts(pieces.groupBy("stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")), gap).persist()
        newest, most = found.agg(F.max("ended"), F.max("n")).first()
        placed = pieces.join(found, "stretch")
        if most is not None and most > HEAVY:
            heavy = F.broadcast(found.where(F.col("n") > HEAVY))
            placed = pieces.join(heavy, "stretch").unionByName(pieces.join(heavy, "stretch", "left_anti").join(found, "stretch"))
        closed = F.col("ended") + gap < F.lit(newest) - wait
        paths = placed.select("path", "started", "ended").distinct()
        paths.withColumn("closed", closed).write.mode("overwrite").partitionBy("closed").parquet(f"{out}/batch={number}")
        found.unpersist()
        fs.delete(path(f"{out}/batch={number - 2}/closed=false"), True)

    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _bursts(stretches: DataFrame, gap: Column) -> DataFrame:
    """stretch, n, started, ended of its burst: one opens where nothing before lasts to ``gap`` ahead of it."""
    placed = stretches.withColumn("chunk", F.col("stretch") - F.pmod("stretch", gap * CHUNK))
    after = _so_far(placed, "last", "_before", -1)
    opened = after.withColumn("_opened", F.when(F.col("_before").isNull() | (F.col("first") > F.col("_before") + gap), F.col("first")))
    begun = _so_far(opened, "_opened", "started", 0)
    ends = begun.groupBy("started").agg(F.max("last").alias("ended"))
    return begun.select("stretch", "n", "started").join(ends, "started").select("stretch", "n", "started", "ended")


def _so_far(stretches: DataFrame, value: str, name: str, upto: int) -> DataFrame:
    """With the greatest ``value`` of all stretches up to the own one (0) or the one before it (-1): of a chunk's, then of the chunks before it."""
    chunks = stretches.groupBy("chunk").agg(F.max(value).alias("_most"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("chunk", F.max("_most").over(earlier).alias("_earlier"))
    own = Window.partitionBy("chunk").orderBy("stretch").rowsBetween(Window.unboundedPreceding, upto)
    return stretches.join(before, "chunk").withColumn(name, F.greatest(F.max(value).over(own), "_earlier")).drop("_earlier")


def bursts(spark: SparkSession, out: str) -> DataFrame:
    """started, ended, path: the closed bursts that ``debounce`` has written, a row for each distinct path; they end when ``quiet`` begins."""
    rows = spark.read.schema(BURSTS).parquet(out).where("closed")
    return rows.select(F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "path")


def rolling(feed: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """path, started, n: sliding counters of changes."""
    w = feed.withWatermark("ts", late).groupBy("path", F.window("ts", window, slide)).agg(F.count("*").alias("n"))
    return w.select("path", F.col("window.start").alias("started"), "n")


def plan_update(total_files: int, changes: int, has_base: bool = True, share: float = 0.3, least: int = 50) -> str:
    """full or incremental: full without a base, or if over ``share`` of the files and over ``least`` changed."""
    return "full" if not has_base or (changes > share * total_files and changes > least) else "incremental"


def update_plans(total: Column, changes: Column, share: float = 0.3, least: int = 50) -> Column:
    """``plan_update`` as a column over many projects that have a base."""
    return F.when((changes > share * total) & (changes > least), "full").otherwise("incremental")


def apply_changes(files: DataFrame, feed: DataFrame) -> DataFrame:
    """path, language, text after a batch of changes: the last change of each path wins; deletions and renames remove."""
    fresh, gone = effects_of(feed)
    return files.join(gone, "path", "left_anti").select("path", "language", "text").unionByName(fresh)


def effects_of(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, language, text of the files that a batch of changes leaves, path of all that it touches)."""
    ordered = feed.withColumn("_seq", F.struct("ts", "status"))
    text = ordered.groupBy("path").agg(F.max_by("text", "_seq").alias("text"))
    last = ordered.groupBy("path").agg(F.max_by("status", "_seq").alias("status"), F.max_by("old_path", "_seq").alias("old_path"))
    effects = changed_files(last)
    gone = effects.select("path").distinct()
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in source_code.LANGUAGES.items() for x in kv])
    fresh = effects.where("change <> 'deleted'").select("path").distinct().join(text, "path").select("path", kinds[ext].alias("language"), "text")
    return fresh, gone


def derive(files: DataFrame) -> dict[str, DataFrame]:
    """Symbols, imports, hierarchy and calls of the files; an incremental state derives what a full rebuild derives."""
    return {"symbols": structure.symbols(files), "imports": structure.imports(files), "hierarchy": structure.hierarchy(files), "calls": structure.calls(files)}


def maintain(feed: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every micro-batch into the stored files. ``save`` must replace the table as a whole (see ``tables.overwrite``)."""

    def merge(batch: DataFrame, _: int) -> None:
        save(apply_changes(load(), batch))

    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()


def maintain_store(feed: DataFrame, store: Store, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every micro-batch into a versioned table: a batch writes the rows that it changes, and none twice after a restart."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        fresh, gone = effects_of(batch)
        retried(store, lambda _: {table: Change(["path"], upserts=fresh, deletes=gone)}, applied=(f"feed:{table}", number))
        store.compact(table)
        batch.unpersist()

    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()
