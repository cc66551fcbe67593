"""Best-fit packing by minimum bin slack.

Token pieces are packed into sequences of ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` rows, however large the corpus) goes to the driver. There each bin pattern is anchored at the longest
length left, and a bitset subset-sum dynamic programme over the lengths left finds the fullest combination that goes
with it; the pattern is then removed as many times as the counts allow, so the work follows the number of distinct
lengths, not of pieces. Pieces get their places by rank: salted ranks within a length, prefix sums over the salts,
and a broadcast table of patterns (bounded by the same histogram).
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import rows_of, span_ids
from .storage import written

CAPACITY = 2048
SALTS = 256
CACHED_UNITS = 200_000  # in each worker; beyond it the cache starts afresh


_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(rest)) for b in range(256)}


def _classes() -> np.ndarray:
    """Class of each byte of a UTF-8 text; what the fast path does not know is foreign."""
    table = np.full(256, _FOREIGN, np.uint8)
    table[0x20:0x7F] = _OTHER
    table[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = _LETTER
    table[0x80:0xC0] = table[0xC3:0xC6] = _LETTER  # of U+00C0 to U+017F
    return table


#: The endings that the vocabulary's splitter keeps with an apostrophe, in its order.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class _Encoder:
    """Token ids of texts, by way of a cache of the units into which the vocabulary's splitter cuts them.

    Units are runs of letters, single digits, runs of other characters, and endings with their apostrophe; they never
    cross white space, and a text's ids are its units' ids in order. New units go through the tokenizer. A text with
    bytes outside U+00C0 to U+017F and plain ASCII, with a dotted capital I or a special token's opening, goes whole
    through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.letters = _byte_letters()
        self.table = _classes()
        self.known: dict[bytes, bytes] = {}  # by the unit itself

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = (e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in made]

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        """As ``_ids``, of units: what is left of the tokenizer's steps is the byte letters and the merges."""
        merge, letters = self.model.tokenize, self.letters
        made = ([t.id for t in merge(u.lower().encode().decode("latin-1").translate(letters))] for u in units)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in made]

    def _units(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = kind[1:] != kind[:-1]
        cut |= kind == _DIGIT
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        quotes = np.flatnonzero((data[:-1] == 0x27) & cut[:-1] & cut[1:] & (kind[1:] == _LETTER))
        for q in quotes.tolist():
            if (q + 1 >= offs[1:]).any() and (offs == q + 1).any():
                continue  # the apostrophe ends a text
            tail = bytes(data[q + 1 : q + 3]).lower()
            for e in _ENDINGS:
                if tail[: len(e)] == e and not cut[q + 2 : q + 1 + len(e)].any():
                    cut[q + 1] = False
                    if q + 1 + len(e) < len(data):
                        cut[q + 1 + len(e)] = True
                    break
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], len(data))
        keep = kind[at] != _SPACE
        return at[keep], ends[keep]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids (unsigned 32 bits) of each text of a block."""
        n = len(offs) - 1
        if not len(data):
            return [np.zeros(0, "<u4")] * n
        kind = self.table[data]
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the signs of times and division
        kind[sign] = kind[sign + 1] = _OTHER
        odd = kind == _FOREIGN
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        foreign = np.zeros(n, bool)
        foreign[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = True
        start, end = self._units(data, offs, kind)
        if foreign.any():
            keep = ~foreign[np.searchsorted(offs, start, "right") - 1]
            start, end = start[keep], end[keep]
        first, back = span_ids(data, start, end)
        if len(self.known) > CACHED_UNITS:
            self.known.clear()
        raw, known = data.tobytes(), self.known
        units = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if new := [u for u in units if u not in known]:
            known.update(zip(new, self._unit_ids([u.decode() for u in new]), strict=True))
        each = [known[u] for u in units]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        ids = np.frombuffer(b"".join(each), "<u4")
        base = np.cumsum(sizes) - sizes
        long = sizes[back]
        done = np.cumsum(long)
        ids = ids[np.repeat(base[back] - (done - long), long) + np.arange(done[-1] if len(done) else 0)]
        edges = np.concatenate([[0], done])[np.searchsorted(start, offs)]
        out = [ids[edges[k] : edges[k + 1]] for k in range(n)]
        if foreign.any():
            own = np.flatnonzero(foreign).tolist()
            for k, got in zip(own, self._ids([bytes(data[offs[k] : offs[k + 1]]).decode() for k in own]), strict=True):
                out[k] = np.frombuffer(got, "<u4")
        return out


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and ``end_id``, cut every ``capacity`` tokens (null: empty text)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for i, j, data, offs in rows_of(batch, "text"):
                for doc, ids in zip(docs[i:j], encoder.encode(data, offs), strict=True):
                    raw = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int, most: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum <= room, found by bitset subset sums.

    Bit s of the reach says that some combination sums to s. Counts go in as binary multiples, longest first, so
    long pieces are used first and short ones stay for later bins. ``most`` bounds the pieces of one length.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, k = min(counts[length], room // length, most), 1
        while left > 0:
            k = min(k, left)
            left -= k
            before = reach
            reach |= (reach << (length * k)) & mask
            if reach != before:
                steps.append((length, k, before))
            if reach >> room:
                left = 0
                break
            k *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bin patterns (how often, {length: pieces}) that hold exactly the given numbers of pieces."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    patterns = []
    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        pattern = fullest({n: c for n, c in counts.items() if c}, capacity - anchor, capacity)
        counts[anchor] += 1
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        patterns.append((times, pattern))
    return patterns


def _places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a bin, first sequence, offset of its first piece) of each pattern's lengths."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k, first = pattern[length], rank.get(length, 0)
            rows.append((length, first, first + k * times, k, sequence, offset))
            rank[length] = first + k * times
            offset += k * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32) of 1 to ``capacity`` tokens.

    Repeated rows are packed each on their own; an empty input gives an empty result. Reads ``pieces`` twice, so it
    should be a written table.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    places = _places(pack_lengths({r["length"]: r["count"] for r in rows}, capacity))
    fields = ("length", "first", "end", "per_bin", "sequence", "place")
    table = spark.createDataFrame(places, T.StructType([T.StructField(f"p_{n}", T.LongType()) for n in fields]))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    joined = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_end")))
    nth = F.col("rank") - F.col("p_first")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_sequence") + F.floor(nth / F.col("p_per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("p_place") + (nth % F.col("p_per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts, cut what is longer than a sequence, and pack every piece: one row per piece."""
    return pack(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
