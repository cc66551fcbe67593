"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are word unigrams, bigrams and skip-grams (one word left out), hashed into ``2 ** BITS`` coordinates and
present or absent. Per-coordinate learning rates follow each coordinate's own gradients; the L1 term keeps only
coordinates whose evidence exceeds it, so the weights sent to the executors are few, and never more than 2 ** BITS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lower_ascii_table, mix64, rows_of, span_hash, word_spans
from .storage import written

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 1.0
EPOCHS = 3
TRAINING_ROWS = 20_000  # bound of the sample of labelled rows that a model is fitted on
_FLAG = np.ones(256, bool)
_FLAG[:0x30] = _FLAG[0x3A:0x41] = _FLAG[0x5B:0x61] = _FLAG[0x7B:0x80] = False
_LOWER = lower_ascii_table()


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of each text's distinct features, sorted by row; words are runs of letters and digits.

    ``wanted`` (a flag for each coordinate) leaves out the others.
    """
    start, end = word_spans(_FLAG[data], offs)
    words = span_hash(_LOWER[data], start, end)
    row = np.searchsorted(offs, start, "right") - 1
    grams, rows = [words], [row]
    for gap, salt in ((1, 0x51ED270B), (2, 0x7F4A7C15)):
        same = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, bool)
        pair = mix64(words[:-gap] * np.uint64(3) + words[gap:] * np.uint64(5) + np.uint64(salt)) if len(row) > gap else words[:0]
        grams.append(pair[same])
        rows.append(row[: len(same)][same])
    shift = np.uint64(64 - bits)
    place, at = np.concatenate(rows), np.concatenate(grams) >> shift
    if wanted is not None:
        keep = wanted[at]
        place, at = place[keep], at[keep]
    key = np.unique(place.astype(np.uint64) << np.uint64(32) | at)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fit(examples: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights of the coordinates, and the bias (which is not regularised by L1)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = np.zeros(2)
    positive = max(1, sum(labels))
    weight = (1.0, min(20.0, max(1.0, (len(labels) - positive) / positive)))  # rare labels count for more

    def weights(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni, L1)
            b = -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = (p - y) * weight[y]
            if g == 0:
                continue
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            bias += g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / ALPHA * b, g * g
    return weights(z, n, L1), float(-bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, their weights, bias) learnt from at most ``rows`` labelled documents outside the held-out fifth.

    The sample is the rows of smallest hash of the id, then of the text, so it does not depend on order; of the rows of
    one id and text one is taken, whatever their number. Documents are reduced to their features on the executors, where
    they stand; the reductions of the sample, at most ``rows`` of them, are shuffled to the one task that fits the
    model. Without any labelled rows, the model is the constant 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    held = texts.select("doc_id", "text_key").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "text_key").agg(F.max("toxic").alias("toxic"))
    sample = written(held.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(rows), "sample")
    texts = texts.join(F.broadcast(sample), ["doc_id", "text_key"]).select("doc_id", "text", "toxic", "text_key")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for i, j, data, offs in rows_of(batch, "text"):
                row, x = features(data, offs, bits)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                found += [x[edge[k] : edge[k + 1]].astype("<u4").tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "text_key", "toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: (hash_order(r[0]), r[2]))
        w, b = fit([np.frombuffer(x, "<u4") for *_, x in got], [y for _, y, _ in got], bits) if got else (np.zeros(1 << bits), 0.0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], b), pa.float64())], ["at", "w"])

    def hash_order(doc: int) -> int:
        return int(mix64(np.array([doc & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    reduced = texts.mapInArrow(reduce, "doc_id bigint, text_key bigint, toxic int, x binary").groupBy("doc_id", "text_key").agg(F.first("toxic").alias("toxic"), F.first("x").alias("x"))
    got = reduced.select("doc_id", "toxic", "x").repartition(1).mapInArrow(learn, "at bigint, w double").collect()  # at most 2 ** bits weights
    pairs = sorted((r["at"], r["w"]) for r in got)
    bias = next((w for a, w in pairs if a == -1), 0.0)
    pairs = [p for p in pairs if p[0] >= 0]
    return np.array([a for a, _ in pairs], np.int64), np.array([w for _, w in pairs]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, name: str = "score") -> DataFrame:
    """Add ``name`` (double, 0 to 1; in place of a column called so) to rows, from the words of ``text`` alone (null and empty texts: the bias)."""
    at, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights.astype(np.float64), bias))
    names = [c for c in docs.columns if c != name]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])  # workers take no dots in names
    text = f"c{names.index('text')}"
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        dense[sent.value[0]] = sent.value[1]
        wanted = dense != 0
        for batch in batches:
            sums = np.full(batch.num_rows, sent.value[2])
            for i, j, data, offs in rows_of(batch, text):
                row, x = features(data, offs, bits, wanted)
                sums[i:j] += np.bincount(row, dense[x], j - i)
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return plain.mapInArrow(apply, schema).toDF(*names, name)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted. Repeated rows repeat their result; a null id is not held out."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(slim, train(docs, labels, rows)).drop("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
