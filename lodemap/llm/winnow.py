"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words, the smallest hash of ``GRAM`` words is kept, so two texts that share a window
share one of its fingerprints. Benchmark items of fewer words than a window are one window of their own length, whose
fingerprint is the hash of all its words. Fingerprints of documents pass a membership filter of bounded size made
from the benchmark's, then join them; each hit is extended word by word to the windows that it proves, on the words
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lower_ascii_table, mix64, rows_of, sliding_min, span_hash, word_grams, word_spans
from .storage import written

WINDOW, GRAM = 10, 5
LEAST_BITS, MOST_BITS = 16, 26  # of the membership filter: 8 MB at most
_LOWER = lower_ascii_table()
_FLAG = np.ones(256, bool)
_FLAG[:0x30] = _FLAG[0x3A:0x41] = _FLAG[0x5B:0x61] = _FLAG[0x7B:0x80] = False
_MARK = "fp bigint, size int, pos int, before string, after string"


def _selected(grams: np.ndarray, row: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Flags of the grams that are the minimum of some window of ``window`` words of one text (all ties)."""
    w = window - gram + 1
    n = len(grams)
    if n < w:
        return np.zeros(n, bool)
    least = sliding_min(grams, w)
    least = np.where(row[: len(least)] == row[window - 1 : window - 1 + len(least)], least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), w)
    return (grams == most[:n]) & (most[:n] > 0)


class _Marks:
    """Fingerprints of a block of texts, with the words around them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.low = _LOWER[data]
        self.start, self.end = word_spans(_FLAG[data], offs)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.edge = np.searchsorted(self.start, offs)
        self.words = span_hash(self.low, self.start, self.end)

    def of_windows(self) -> tuple[np.ndarray, np.ndarray]:
        grams = word_grams(self.words, GRAM)
        at = np.flatnonzero(_selected(grams, self.row, WINDOW, GRAM))
        return at, mix64(grams[at] + np.uint64(WINDOW))

    def of_length(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        grams = word_grams(self.words, size)
        at = np.flatnonzero(self.row[: len(grams)] == self.row[size - 1 : size - 1 + len(grams)])
        return at, mix64(grams[at] + np.uint64(size))

    def text(self, a: int, b: int) -> str:
        return " ".join(bytes(self.low[s:e]).decode() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))

    def mark(self, at: int, fp: int, size: int) -> dict:
        lo, hi = int(self.edge[self.row[at]]), int(self.edge[self.row[at] + 1])
        reach = WINDOW - GRAM if size == WINDOW else 0
        return {"fp": fp, "size": size, "pos": at - lo, "before": self.text(max(lo, at - reach), at), "after": self.text(at, min(hi, at + size))}


_MARKS = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("before", pa.string()), ("after", pa.string())]))


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def benchmark_marks(items: DataFrame) -> DataFrame:
    """item_id, fp, size, before, after of every fingerprint of every item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for i, j, data, offs in rows_of(batch, "text"):
                m = _Marks(data, offs)
                own: list[list[dict]] = [[] for _ in range(j - i)]
                at, fp = m.of_windows()
                for a, f in zip(at.tolist(), _signed(fp), strict=True):
                    own[m.row[a]].append(m.mark(a, f, WINDOW))
                counts = np.diff(m.edge)
                for size in set(counts[(counts > 0) & (counts < WINDOW)].tolist()):
                    at, fp = m.of_length(size)
                    for a, f in zip(at.tolist(), _signed(fp), strict=True):
                        if counts[m.row[a]] == size:
                            own[m.row[a]].append(m.mark(a, f, size))
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _MARKS)], ["item_id", "marks"])

    slim = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(scan, f"item_id string, marks array<struct<{_MARK.replace(' ', ':')}>>".replace(",:", ",")).select("item_id", F.inline("marks"))


def membership(marks: DataFrame) -> np.ndarray:
    """Bits (as bytes of 64-bit words) of the fingerprints; 2 ** LEAST_BITS to 2 ** MOST_BITS of them."""
    n = marks.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    place = F.shiftrightunsigned("fp", 64 - bits)
    words = marks.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))")).alias("mask"))
    table = words.toArrow()  # no more rows than the filter has words
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["mask"].to_numpy()
    return out


def document_marks(docs: DataFrame, filter_: np.ndarray, short: list[int]) -> DataFrame:
    """doc_id, text_key, n_words and the marks of each text that pass the filter (null text: no words)."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        shift = np.uint64(64 - (len(words).bit_length() - 1 + 6))

        def passing(fp: np.ndarray) -> np.ndarray:
            place = (fp >> shift).astype(np.int64)
            return words[place >> 6] >> (place & 63) & 1 > 0

        for batch in batches:
            found: list[list[dict]] = []
            counts: list[int] = []
            for i, j, data, offs in rows_of(batch, "text"):
                m = _Marks(data, offs)
                own: list[list[dict]] = [[] for _ in range(j - i)]
                for size, (at, fp) in [(WINDOW, m.of_windows()), *((s, m.of_length(s)) for s in short)]:
                    keep = passing(fp)
                    for a, f in zip(at[keep].tolist(), _signed(fp[keep]), strict=True):
                        own[m.row[a]].append(m.mark(a, f, size))
                found += own
                counts += np.diff(m.edge).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(found, _MARKS)], ["doc_id", "text_key", "n_words", "marks"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(scan, f"doc_id bigint, text_key bigint, n_words bigint, marks array<struct<{_MARK.replace(' ', ':')}>>".replace(",:", ","))


def _extended(joined: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, start, end of the words that proven windows cover, from pairs of marks."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, item, size, pos, b1, a1, b2, a2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                right = 0
                for x, y in zip(a1.split(" "), a2.split(" "), strict=False):
                    if x != y:
                        break
                    right += 1
                left = 0
                if size == WINDOW and b1 and b2:
                    for x, y in zip(reversed(b1.split(" ")), reversed(b2.split(" ")), strict=False):
                        if x != y:
                            break
                        left += 1
                most, least = min(left, size - 1), max(0, size - right)
                if least <= most:
                    out.append((doc, key, item, pos - most, pos - least + size))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "text_key", "item_id", "first", "last"])

    return joined.mapInArrow(extend, "doc_id bigint, text_key bigint, item_id string, first int, last int")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (sorted as strings).

    One row per input row; rows with equal doc_id but other texts stay apart. Null texts and items without words hit
    nothing; other columns are ignored.
    """
    return scored(docs, items).drop("text_key")


def scored(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``decontaminate`` with the text_key of each row behind its doc_id."""
    marks = written(benchmark_marks(items), "benchmark-marks")
    short = sorted(r["size"] for r in marks.where(F.col("size") < WINDOW).select("size").distinct().collect())
    scanned = written(document_marks(docs, membership(marks), short), "document-marks")
    d = scanned.where(F.size("marks") > 0).select("doc_id", "text_key", F.inline("marks"))
    b = marks.select("item_id", "fp", "size", F.col("before").alias("b2"), F.col("after").alias("a2"))
    joined = d.join(b, ["fp", "size"]).select("doc_id", "text_key", "item_id", "size", "pos", "before", "after", "b2", "a2")
    hits = _extended(joined).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("found")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    total = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["upto"], x["first"]))).alias("n"), F.greatest(acc["upto"], x["last"]).alias("upto")
        ),
    )
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), total["n"].alias("n_hit"), "found")
    base = scanned.select("doc_id", "text_key", "n_words")
    out = base.join(hits, base["doc_id"].eqNullSafe(hits["d"]) & (base["text_key"] == hits["t"]), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), found.alias("items"),
    )


def _words_sql(table: str) -> str:
    return f"regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: The contract's rows in the oracle's SQL, by exact windows.
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql("documents")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("benchmark")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: w[i:i + {WINDOW - 1}]) ELSE [w] END) AS g FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'p': i, 'g': w[i:i + n - 1]}})) AS x FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, x.p AS p, n, item FROM dw JOIN bw ON bw.g = x.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) h GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
