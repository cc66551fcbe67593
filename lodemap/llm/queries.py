"""Registered queries of this subpackage: thin contract views over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, gearcdc, linetree, media, packing, repair, ring, secrets, setsketch, spelling, suffix, toxicity, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back: payload, digests and stream features per row."""
    return media.media_digests(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped: counts and the digest of what stays, per row."""
    return linetree.line_report(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under a 100-byte string that also starts earlier, removed: counts and the digest of what stays, per row."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of benchmark windows that each document holds."""
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of each document, at 85 %."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document under the law ``rows``."""
    return ring.shard_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document, by a model fitted without the held-out fifth."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of secrets and the linked parts of credentials in each text."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of content-defined chunks in each text."""
    return gearcdc.repeated_chunks(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent word with the form and the root that it is a spelling variant of."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of what they make of each conversation, after damage."""
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written into the chat template, and what is read back from there."""
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linetree.REPORT_SQL, "op5_benchmark_decontamination": winnow.REPORT_SQL, "op13_chat_formatting": chat.REPORT_SQL}
