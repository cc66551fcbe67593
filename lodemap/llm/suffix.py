"""Substring dedup by longest-previous-factor arrays over suffix order.

``longest_previous_factors`` is the method on one text: in suffix order, the nearest suffixes on either side that start
earlier give the longest earlier match of each place.

At scale, suffixes are dealt out by content. Of every window of ``LENGTH`` bytes, the smallest hash of ``GRAM`` bytes
is its anchor, so equal windows have the same anchor at the same distance. A run is the stretch of windows of one
anchor. Runs of equal text meet at their anchor's hash: all but the first repeat whole. Equal are runs of equal anchor
hash (64 bits) and of equal hashes (88 bits) under two keys drawn for each job, so no text can be made to collide. Where an anchor has runs of
different texts, their suffixes, cut at LENGTH bytes, are put in suffix order; the previous and next smaller places
and the common prefixes on the way there give the longest previous factors, and a window repeats where its factor
reaches LENGTH. Runs of an anchor with more than ``GROUP`` texts are cut into their windows and dealt out by those, to
the same steps; a group is worked off in blocks that carry over only what has no earlier copy, so no group outgrows a
task's memory. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import arrow_bytes, equal_spans, gram_hash, mix64, rows_of, sliding_min, span_hash
from .storage import written

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
GROUP = 2000  # texts of an anchor that are dealt out together
BLOCK = 4096  # rows that are put in order at once
SEGMENT = 2 << 20  # a longer text is read in segments; runs end at their borders
_PLACE = np.uint64((1 << 24) - 1)
_MARK = (1 << 24) - 1  # ``at``: place << 32 | windows << 24 | mark, which is a part of the run's hash


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        fresh = np.ones(n, np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def longest_previous_factors(text: bytes) -> np.ndarray:
    """For each place, the length of the longest match that starts earlier (overlaps count)."""
    n = len(text)
    order = suffix_array(text).tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for place in order:
        while stack and stack[-1] > place:
            after[stack.pop()] = place
        before[place] = stack[-1] if stack else -1
        stack.append(place)
    out = np.zeros(n, np.int64)
    best = [0, 0]
    for i in range(n):
        for side, found in enumerate((before[i], after[i])):
            k = max(0, best[side] - 1) if found >= 0 else 0  # from place to place a match shortens by one at most
            while found >= 0 and i + k < n and text[i + k] == text[found + k]:
                k += 1
            best[side] = k
        out[i] = max(best)
    return out


def _runs(data: np.ndarray, offs: np.ndarray, keys: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """row, first window (from the row's start), windows, mark, anchor's hash and key of the text of each run of a block."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = gram_hash(data, GRAM)
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), SPAN)
    anchor = (least & _PLACE).astype(np.int64)
    row = np.zeros(len(data), np.int32)
    inner = offs[1:-1]
    np.add.at(row, inner[inner < len(data)], 1)
    row = np.cumsum(row, dtype=np.int32)
    inside = row[: len(anchor)] == row[LENGTH - 1 : LENGTH - 1 + len(anchor)]
    cut = np.ones(len(anchor), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1])
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(anchor))
    keep = inside[at]
    at, ends = at[keep], ends[keep]
    text, mark = (mix64(span_hash(data, at, ends - 1 + LENGTH, k) + (anchor[at] - at).astype(np.uint64)) for k in keys)
    r = row[at].astype(np.int64)
    return r, at - offs[r], ends - at, (mark & np.uint64(_MARK)).astype(np.int64), grams[anchor[at]], text


def _segments(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets): a block as it is, or the overlapping segments of one long text."""
    if len(data) <= SEGMENT:
        yield 0, 0, data, offs
        return
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        yield 0, at, part, np.array([0, len(part)])


def _source(docs: DataFrame) -> DataFrame:
    """doc (null: the least), sub (of the text, tells repeated ids apart) and text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("doc"),
        F.xxhash64("text").alias("sub"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key that deals known repeats out evenly."""
    return mix64(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64))


def _same_place(doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row but the first is of the same place as the one before it."""
    return (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (at[1:] == at[:-1])


def _later(same: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of value and place, where ``same`` says that neighbours are equal: which are not the same place again, which stand later."""
    once, known = np.ones(len(doc), bool), np.zeros(len(doc), bool)
    once[1:] = ~(same & _same_place(doc, sub, at))  # a repeated row is the same place, not a later one
    known[1:] = same
    return once, known


def _scan_runs(docs: DataFrame) -> DataFrame:
    """fp, seg, doc, sub, at (place, windows and mark in one long), known: later equals within a batch are known repeats at once."""
    keys = (randbits(48), randbits(48))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i, _, data, offs in rows_of(batch, "text"):
                for _, shift, part, edges in _segments(data, offs):
                    row, first, n, mark, fp, seg = _runs(part, edges, keys)
                    if len(row):
                        parts.append((fp, seg, docs_[i:][row], subs[i:][row], (first + shift) << 32 | n << 24 | mark))
            if not parts:
                continue
            fp, seg, doc, sub, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, sub, doc, at & _MARK, seg, fp))
            fp, seg, doc, sub, at = fp[order], seg[order], doc[order], sub[order], at[order]
            same = (fp[1:] == fp[:-1]) & (seg[1:] == seg[:-1]) & ((at[1:] ^ at[:-1]) & _MARK == 0)
            once, known = _later(same, doc, sub, at)
            fp = np.where(known, _spread(doc, at), fp)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[once].view(np.int64), seg[once].view(np.int64), doc[once], sub[once], at[once], known[once])], ["fp", "seg", "doc", "sub", "at", "known"])

    return _source(docs).mapInArrow(scan, "fp bigint, seg bigint, doc bigint, sub bigint, at bigint, known boolean")


_PIECE = "key bigint, doc bigint, sub bigint, at bigint, body binary, known boolean"


def _pieces(parts: list[tuple]) -> pa.RecordBatch:
    """Runs as they are; runs of crowded anchors window by window, where later equals within a batch are known repeats."""
    keys, docs_, subs, ats, bodies, known = [], [], [], [], [], []
    split: list[tuple] = []
    for raw, d, u, runs in parts:
        for fp, a, crowded in runs:
            n, place = a >> 24 & 255, a >> 32
            body = raw[place : place + n - 1 + LENGTH]
            if crowded:
                split.append((d, u, a, n, bytes(body)))
            else:
                keys.append(fp)
                docs_.append(d)
                subs.append(u)
                ats.append(a)
                bodies.append(bytes(body))
                known.append(False)
    if split:
        d, u, a, n = (np.array(x, np.int64) for x in list(zip(*split, strict=True))[:4])
        data = np.frombuffer(b"".join(x[4] for x in split), np.uint8)
        size = n - 1 + LENGTH
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(size) - size, n) + nth
        doc, sub, at = np.repeat(d, n), np.repeat(u, n), (np.repeat(a >> 32, n) + nth) << 32 | 1 << 24
        key = span_hash(data, start, start + LENGTH, 3)
        order = np.lexsort((at, sub, doc, key))
        start, doc, sub, at, key = start[order], doc[order], sub[order], at[order], key[order]
        before = np.maximum(np.arange(len(key)) - 1, 0)
        same = (key[1:] == key[:-1]) & equal_spans(data, start, start + LENGTH, before)[1:]
        once, later = _later(same, doc, sub, at)
        key = np.where(later, _spread(doc, at), key).view(np.int64)
        raw = data.tobytes()
        keys += key[once].tolist()
        docs_ += doc[once].tolist()
        subs += sub[once].tolist()
        ats += at[once].tolist()
        known += later[once].tolist()
        bodies += [b"" if k else raw[s : s + LENGTH] for s, k in zip(start[once].tolist(), later[once].tolist(), strict=True)]
    kinds = (*[pa.int64()] * 4, pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((keys, docs_, subs, ats, bodies, known), kinds, strict=True)], [x.split()[0] for x in _PIECE.split(", ")])


def _cut_windows(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """key, doc, sub, at, body, known: the text of each candidate run, or of a crowded anchor each window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for text, d, u, runs in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                fp, at, crowded = (runs.values.field(k).to_pylist() for k in range(3))
                parts.append((memoryview(text.as_buffer()), d, u, zip(fp, at, crowded, strict=True)))
                held += sum((a >> 24 & 255) * LENGTH if c else LENGTH for a, c in zip(at, crowded, strict=True))
                if held > 8 << 20:
                    yield _pieces(parts)
                    parts, held = [], 0
            if parts:
                yield _pieces(parts)

    runs = candidates.groupBy("doc", "sub").agg(F.collect_list(F.struct("fp", "at", "crowded")).alias("runs"))
    texts = _source(docs)
    joined = texts.join(runs.toDF("d", "s", "runs"), (F.col("doc") == F.col("d")) & (F.col("sub") == F.col("s")))
    return joined.select(F.col("text").cast("binary").alias("text"), "doc", "sub", "runs").mapInArrow(cut, _PIECE)


def _common(suffix: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix (a row of bytes) with the one before it in order."""
    out = np.zeros(len(suffix), np.int64)
    for at in range(1, len(suffix), 1 << 16):
        part = suffix[at - 1 : at + (1 << 16)]
        differ = part[1:] != part[:-1]
        out[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), suffix.shape[1])
    return out


def _factors_before(common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In suffix order, the common prefix of each suffix with the nearest before it that has a smaller place (none: 0).

    Every suffix points to one before it with larger places only in between; pointers that still meet a larger place
    jump on along that one's own pointer, together with the shortest common prefix on the way.
    """
    near, least = np.arange(len(place)) - 1, common.copy()
    open_ = np.flatnonzero(near >= 0)
    open_ = open_[place[near[open_]] > place[open_]]
    while len(open_):
        over = near[open_]
        least[open_] = np.minimum(least[open_], least[over])
        near[open_] = near[over]
        open_ = open_[near[open_] >= 0]
        open_ = open_[place[near[open_]] > place[open_]]
    return np.where(near >= 0, least, 0)


def cut_factors(suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factors, up to the rows' width, of suffixes in order: with the previous and the next smaller place."""
    common = _common(suffix)
    before = _factors_before(common, place)
    after = _factors_before(np.append(0, common[:0:-1]), place[::-1])[::-1]
    return np.maximum(before, after)


def _repeats_of(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, data: np.ndarray, size: np.ndarray, old: int) -> tuple[np.ndarray, ...]:
    """(doc, sub, at) of the stretches of windows with an equal earlier window, of runs given in order of place; which runs repeat whole.

    The first ``old`` runs were reported before.
    """
    again = np.zeros(len(at), bool)  # of a repeated row
    again[1:] = _same_place(doc, sub, at)
    windows = np.where(again, 0, at >> 24 & 255)
    start = np.cumsum(size) - size
    total = int(windows.sum())
    run = np.repeat(np.arange(len(at)), windows)
    nth = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    order = np.lexsort(((at[run] >> 32) + nth, sub[run], doc[run]))
    suffix = data[(start[run] + nth)[order][:, None] + np.arange(LENGTH)] if total else np.zeros((0, LENGTH), np.uint8)
    rank = np.argsort(suffix.view(f"V{LENGTH}").ravel(), kind="stable")  # by place where cut suffixes are equal
    hit = np.zeros(total, bool)
    hit[order[rank]] = cut_factors(suffix[rank], rank) >= LENGTH
    whole = np.bincount(run[hit], minlength=len(at)) == windows
    opens = hit & ~np.concatenate([[False], hit[:-1] & (run[1:] == run[:-1])])
    closes = hit & ~np.concatenate([hit[1:] & (run[1:] == run[:-1]), [False]])
    o, c = np.flatnonzero(opens), np.flatnonzero(closes)
    new = run[o] >= old
    o, c = o[new], c[new]
    return doc[run[o]], sub[run[o]], (at[run[o]] >> 32) + nth[o] << 32 | (nth[c] - nth[o] + 1) << 24, whole


def _sorted_repeats(windows: DataFrame) -> DataFrame:
    """doc, sub, at of repeated stretches. Rows come by key and place, many keys to a block; a key that goes on in the next block
    takes with it the runs that have no earlier copy."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = tuple(np.zeros(0, k) for k in (*[np.int64] * 4, np.uint8, np.int64))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                known = part.column(5).to_numpy(zero_copy_only=False)
                if known.any():
                    yield pa.RecordBatch.from_arrays([c.filter(part.column(5)) for c in part.columns[1:4]], ["doc", "sub", "at"])
                    part = part.filter(pa.array(~known))
                    if not part.num_rows:
                        continue
                key, doc, sub, at = (c.to_numpy() for c in part.columns[:4])
                data, offs = arrow_bytes(part.column(4))
                if len(carry[0]) and carry[0][0] == key[0]:
                    old = len(carry[0])
                    key, doc, sub, at, data, size = (np.concatenate(x) for x in zip(carry, (key, doc, sub, at, data, np.diff(offs)), strict=True))
                else:
                    old, size = 0, np.diff(offs)
                *found, whole = _repeats_of(doc, sub, at, data, size, old)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc", "sub", "at"])
                stays = (key == key[-1]) & ~whole
                carry = (key[stays], doc[stays], sub[stays], at[stays], data[np.repeat(stays, size)], size[stays])

    return windows.repartition("key").sortWithinPartitions("key", "doc", "sub", "at").mapInArrow(sort, "doc bigint, sub bigint, at bigint")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start:end of the removed runs).

    A byte goes if a LENGTH-byte string over it also starts earlier: in a smaller doc_id (null first), or earlier in
    the same text. Null texts are empty and keep nothing; rows repeated with id and text share their fate; texts of
    equal id go in a fixed order. Other columns are ignored.
    """
    by_seg = Window.partitionBy("fp", "seg", "mark").orderBy("doc", "sub", "at")
    by_fp = Window.partitionBy("fp")
    runs = _scan_runs(docs).repartition("fp").withColumn("mark", F.col("at").bitwiseAND(_MARK))
    marked = runs.withColumn("nth", F.rank().over(by_seg)).withColumn("texts", F.sum((F.col("nth") == 1).cast("int")).over(by_fp))
    marked = marked.where("known or nth > 1 or texts > 1").select("fp", "doc", "sub", "at", (F.col("known") | (F.col("nth") > 1)).alias("repeats"), (F.col("texts") > GROUP).alias("crowded"))
    marked = written(marked, "runs")
    partial = _sorted_repeats(_cut_windows(marked.where("not repeats"), docs))
    spans = marked.where("repeats").select("doc", "sub", "at").unionByName(partial)
    found = spans.groupBy("doc", "sub").agg(F.collect_list("at").alias("found")).toDF("d", "s", "found")
    texts = _source(docs).withColumn("doc_id", F.when(F.col("doc") != -(2**63), F.col("doc")))
    joined = texts.join(found, (F.col("doc") == F.col("d")) & (F.col("sub") == F.col("s")), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "found")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = memoryview(text.as_buffer())
                lo: list[int] = []
                hi: list[int] = []
                if found.is_valid:
                    at = np.sort(found.values.to_numpy())
                    first = at >> 32
                    last = np.maximum.accumulate(first + (at >> 24 & 255) - 1 + LENGTH)
                    opens = np.append(0, np.flatnonzero(first[1:] > last[:-1]) + 1)
                    lo, hi = first[opens].tolist(), last[np.append(opens[1:] - 1, len(last) - 1)].tolist()
                kept, begin = hashlib.sha256(), 0
                for a, b in zip(lo, hi, strict=True):
                    kept.update(raw[begin:a])
                    begin = b
                kept.update(raw[begin:])
                rows.append((len(raw), sum(hi) - sum(lo), len(lo), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in zip(lo, hi, strict=True))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(remove, schema)
