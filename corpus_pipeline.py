"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage works on all that the one before it kept, and is written as Parquet before the next reads it. All but the
last return the columns of ``documents``; the last returns the packed pieces. Nulls in any column, empty texts and
repeated rows pass through every stage as its operator defines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm import linetree, packing, queries, setsketch, storage, toxicity, winnow

PERCENT = 80  # similarity of near-duplicates, on five-word shingles


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below 0.5."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text."""
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": length}
    return linetree.cleaned(docs).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text_key, by which the operators tell rows apart, and row: all columns of ``docs``, whatever they are called."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _joined(keyed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with doc_id (null equals null) and text_key of ``keys``."""
    keys = keys.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"))
    return keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["of_id"]) & (keyed["text_key"] == keys["of_key"]), how)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: smallest id (null last), text key and columns as JSON; rows without words stay."""
    groups = storage.written(setsketch.grouped(docs, PERCENT).where("pick is not null").select("doc_id", "text_key", "pick"), "near-groups")
    first = F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("text_key") == F.col("pick.text_key"))
    gone = groups.where(~first).select("doc_id", "text_key").distinct()
    twice = storage.written(groups.where(first).groupBy("doc_id", "text_key").count().where("count > 1").drop("count"), "repeated-rows")
    keyed = _keyed(docs)
    rest = _joined(keyed, gone.union(twice), "left_anti").select("row.*")
    if twice.isEmpty():
        return rest
    again = _joined(keyed, twice, "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.unionByName(again.select("row.*"))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    hit = winnow.scored(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_key").distinct()
    return _joined(_keyed(docs), hit, "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", reject_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the components and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole of ``documents``, each to what the one before wrote."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
