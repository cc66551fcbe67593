"""Vectorised byte and word kernels over Arrow string columns.

Everything here works on one bounded block of whole documents at a time (``blocks``), so memory follows
the block budget or, beyond it, the longest single document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256  # longer spans are hashed one by one


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply) applied elementwise to a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values end to end, offsets of n+1) of a string or binary array; null values are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``budget`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number (zeros behind the end); of length len(data) + 1."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _chunks(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each span, those behind its end cleared."""
    return wide[at] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (np.minimum(left, 8) << 3).astype(np.uint64))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the spans [start, end): eight bytes at a time are mixed in; long spans by a digest."""
    wide, n = eight_bytes(data), end - start
    h = mix64(n.astype(np.uint64) + np.uint64(int(_SEED) * (seed + 1) & (1 << 64) - 1))
    who = np.flatnonzero((n > 0) & (n <= _LONG_WORD))
    at, left = start[who], n[who]
    while len(who):
        h[who] = mix64((h[who] ^ _chunks(wide, at, left)) + _SEED)
        on = left > 8
        who, at, left = who[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(n > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[k] = np.frombuffer(digest, "<u8")[0]
    return h


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span equals, byte for byte, the one whose index ``other`` gives."""
    wide, n = eight_bytes(data), end - start
    same = n == n[other]
    who = np.flatnonzero(same & (other != np.arange(len(n))))
    a, b, left = start[who], start[other[who]], n[who]
    while len(who):
        differ = _chunks(wide, a, left) != _chunks(wide, b, left)
        same[who[differ]] = False
        on = ~differ & (left > 8)
        who, a, b, left = who[on], a[on] + 8, b[on] + 8, left[on] - 8
    return same


def span_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first span of each value, number of each span's value): numbers are equal exactly if the bytes are equal."""
    _, first, back = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    if not equal_spans(data, start, end, first[back]).all():  # a collision: tell them apart by value
        seen: dict[bytes, int] = {}
        back = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        first = np.unique(back, return_index=True)[1]
    return first, back


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes (a multiple of 8) from each position; of length len(data)-k+1 (none if shorter)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = eight_bytes(data)
    h = mix64(wide[:n] + _SEED)
    for at in range(8, k, 8):
        h ^= wide[at : at + n]
        h += _SEED
        h = mix64(h)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling; of length len(a)-w+1."""
    if len(a) < w:
        return a[:0]
    cur, span = a, 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        rest = w - span
        cur = np.minimum(cur[:-rest], cur[rest:])
    return cur


def word_spans(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of flagged bytes; no run crosses a document's border."""
    n = len(flag)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = offsets[:-1][offsets[:-1] < n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = flag[:-1]
    prev[borders] = False
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = flag[1:]
    nxt[borders[borders > 0] - 1] = False
    return np.flatnonzero(flag & ~prev), np.flatnonzero(flag & ~nxt) + 1


def lower_ascii_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; of length len(words)-k+1 (none if shorter)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n].copy()
    for j in range(1, k):
        g *= _GRAM
        g += words[j : j + n]
    return mix64(g)


def rows_of(batch: pa.RecordBatch, column: str, budget: int = 1 << 20):
    """For each block of rows of a batch: first row, end row, its bytes, its offsets from 0."""
    data, offs = arrow_bytes(batch.column(batch.schema.get_field_index(column)))
    for i, j in blocks(offs, budget):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
