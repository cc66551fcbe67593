"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut falls where the top bits of the gear hash of the last 32 bytes are zero, at least ``LEAST`` and at most ``MOST``
bytes after the cut before (a shorter tail joins the last chunk); cuts depend on content alone, so they resist shifts from insertions. Chunks are
deduplicated by a 128-bit digest: the first in (doc_id, place) order stays, later ones go where they are part of a
passage: a run of adjacent repeated chunks of at least ``PASSAGE`` bytes, or the whole text. Shorter runs are phrases
that language itself repeats, and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, rows_of
from .joins import joined, sized
from .storage import written

LEAST, MOST, CUT_BITS = 32, 256, 5
PASSAGE = 128
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: h = (h << 1) + gear[byte], by doubling."""
    h = _GEAR[data]
    for m in (1, 2, 4, 8, 16):
        s = h.copy()
        s[m:] += h[:-m] << np.uint32(m)
        h = s
    return h


def cuts(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """For each text of a block, its chunks' ends; whole texts are covered, empty ones have none."""
    at = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    edge = np.searchsorted(at, offs + LEAST)
    out = []
    for k in range(len(offs) - 1):
        last, stop, ends = int(offs[k]), int(offs[k + 1]), []
        for c in at[edge[k] : np.searchsorted(at, stop)].tolist():
            gap = c - last
            if gap < LEAST:
                continue
            while gap > MOST:
                last += MOST
                gap -= MOST
                ends.append(last)
            if gap >= LEAST:
                ends.append(c)
                last = c
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        if ends and stop - last < LEAST:
            ends[-1] = stop  # a short tail stays with the chunk before it
        elif stop > last:
            ends.append(stop)
        out.append(ends)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes and chunks (two halves of the digest, first byte, length) of each text (null: empty)."""
    item = pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int32()), ("size", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d: list[bytes] = []
            first: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            counts: list[int] = []
            lengths: list[int] = []
            for _, _, data, offs in rows_of(batch, "text"):
                raw = data.tobytes()
                for k, ends in enumerate(cuts(data, offs)):
                    s = int(offs[k])
                    begin = s
                    for e in ends:
                        d.append(hashlib.blake2b(raw[begin:e], digest_size=16).digest())
                        begin = e
                    e = np.array(ends, np.int32) - s
                    b = np.concatenate([[0], e[:-1]]).astype(np.int32) if ends else e
                    first.append(b)
                    sizes.append(e - b)
                    counts.append(len(ends))
                    lengths.append(int(offs[k + 1]) - s)
            digest = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
            flat = pa.StructArray.from_arrays(
                [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.concatenate([*first, np.zeros(0, np.int32)])), pa.array(np.concatenate([*sizes, np.zeros(0, np.int32)]))],
                fields=list(item.value_type),
            )
            nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lengths, pa.int64()), nested], ["doc_id", "text_key", "n_bytes", "chunks"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(scan, "doc_id bigint, text_key bigint, n_bytes bigint, chunks array<struct<d1:bigint,d2:bigint,first:int,size:int>>")


def repeated_chunks(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_chunks, n_repeats (chunks that go), n_removed bytes, n_spans, removed.

    ``removed`` lists the maximal removed byte runs as start:end, comma-joined. Order is doc_id (null first), then
    text and place; rows with equal doc_id and text share their fate, and the first keeps its chunks. Empty and null
    texts have no chunks; other columns are ignored.
    """
    table = written(chunks(docs), "chunks")
    flat = table.select("doc_id", "text_key", F.inline("chunks"))
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc"), F.col("text_key").alias("key"), F.col("first").alias("at"))
    firsts = flat.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1")
    later = joined(flat.withColumn("place", place), sized(firsts, "n").drop("n"), ["d1", "d2"]).where("place > kept")
    spans = later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("size")).alias("last")))).alias("s"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "s")
    out = table.join(spans, table["doc_id"].eqNullSafe(spans["d"]) & (table["text_key"] == spans["t"]), "left")
    schema = "doc_id bigint, n_bytes bigint, n_chunks bigint, n_repeats bigint, n_removed bigint, n_spans bigint, removed string"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats, removed, runs_, said = [], [], [], []
            for value, size in zip(batch.column(3), batch.column(1).to_pylist(), strict=True):
                found = value.values if value.is_valid else None
                first, last = (found.field(k).to_numpy() for k in (0, 1)) if found is not None else (np.zeros(0, np.int32),) * 2
                opens = np.flatnonzero(np.append(True, first[1:] != last[:-1])) if len(first) else np.zeros(0, np.int64)
                lo, hi = (first[opens], last[np.append(opens[1:], len(last)) - 1]) if len(first) else (first, last)
                on = (hi - lo >= passage) | (hi - lo == size)
                repeats.append(int(np.diff(np.append(opens, len(first)))[on].sum()))
                removed.append(int((hi - lo)[on].sum()))
                runs_.append(int(on.sum()))
                said.append(",".join(f"{a}:{b}" for a, b in zip(lo[on].tolist(), hi[on].tolist(), strict=True)))
            made = [pa.array(x, pa.int64()) for x in (repeats, removed, runs_)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, pa.array(said, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return out.select("doc_id", "n_bytes", F.size("chunks").cast("long").alias("n_chunks"), "s").mapInArrow(merge, schema)
