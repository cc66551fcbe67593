"""Spelling variants of words, joined by a rare-first filter on positional bigrams.

Two words one edit apart share all but two bigrams on either side. With all bigrams in one global order, rarest first,
at least one of the three rarest places of either word is therefore a place of the same bigram in the other's three,
at the same position, or one position on behind an insertion. So words meet only by (bigram, position, length), an
insertion's longer word under the shorter one's length. Two thirds of the shorter word stay as they are, too, and
are part of the key: frequent bigrams alone would bring large groups together. Every meeting is verified by the edit
distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lower_ascii_table, rows_of, span_ids, word_spans
from .storage import discard, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a form occurs at least so many times as often as its variant
PREFIX = 3  # one edit touches two bigrams at most, so one of three stays
TYPO = 199  # one run in so many loses a code point
_LONG_RUN = 256
_LOWER = lower_ascii_table()
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_LETTERS = 26 + 64  # a to z and U+00C0 to U+00FF: at most _LETTERS ** 2 bigrams


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of each span behind those whose crc32 is ``begun``: a byte of all spans at a time, long spans one by one."""
    c, n = begun ^ np.uint32(0xFFFFFFFF), end - start
    who = np.flatnonzero(n <= _LONG_RUN)
    at, left = start[who], n[who]
    while len(who):
        c[who] = _CRC[(c[who] ^ data[at]) & np.uint32(255)] ^ c[who] >> np.uint32(8)
        on = left > 1
        who, at, left = who[on], at[on] + 1, left[on] - 1
    c ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(n > _LONG_RUN).tolist():
        c[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(begun[k]))
    return c


def _count_block(data: np.ndarray, offs: np.ndarray, begun: np.ndarray, least_length: int, typo: int | None) -> tuple[list[bytes], list[int]]:
    """Different words of a block of texts, and how often each occurs."""
    lead = data == 0xC3  # of U+00C0 to U+00FF, and of nothing else
    flag = _ASCII[data] | lead
    flag[1:] |= lead[:-1]
    start, end = word_spans(flag, offs)
    before = np.append(0, np.cumsum(lead))
    chars = end - start - before[end] + before[start]
    keep = chars >= least_length
    start, end, chars, low = start[keep], end[keep], chars[keep], _LOWER[data]
    changed: Counter[bytes] = Counter()
    if typo:
        h = _crc32(low, start, end, begun[np.searchsorted(offs, start, "right") - 1])
        hit = h % np.uint32(typo) == 0
        for a, b, at in zip(start[hit].tolist(), end[hit].tolist(), (h[hit] % chars[hit]).tolist(), strict=True):
            run = low[a:b].tobytes().decode()
            if len(run) > least_length:
                changed[(run[:at] + run[at + 1 :]).encode()] += 1
        start, end = start[~hit], end[~hit]
    first, back = span_ids(low, start, end)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)] + list(changed), np.bincount(back, minlength=len(first)).tolist() + list(changed.values())


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int | None = TYPO) -> DataFrame:
    """word, n of the runs of letters in all texts, lower-cased in A-Z; of one run in ``typo`` (by document and run) a code point is left out.

    Words are counted by blocks of texts, then over all. Null texts have no words; a null doc_id counts as an empty
    one. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun = np.array([zlib.crc32(f"{d}:".encode()) for d in batch.column(0).to_pylist()], np.uint32)
            for i, j, data, offs in rows_of(batch, "text", 4 << 20):
                words, n = _count_block(data, offs, begun[i:j], least_length, typo)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.mapInArrow(count, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letter(at: str) -> str:
    code = f"ascii(substr(word, {at}, 1))"
    return f"if({code} < 192, {code} - 97, {code} - 166)"


def _rare_first(words: DataFrame) -> DataFrame:
    """word, n, len, bag (bits of its letters) and rare: rank and position of the PREFIX rarest bigrams.

    The order (8,100 bigrams at most) goes through the driver.
    """
    gram = F.expr(f"transform(sequence(1, length(word) - 1), i -> {_letter('i')} * {_LETTERS} + {_letter('i + 1')})")
    bag = F.expr(f"aggregate(sequence(1, length(word)), 0L, (bits, i) -> bits | shiftleft(1L, {_letter('i')} % 64))")
    coded = words.select("word", "n", F.length("word").alias("len"), gram.alias("grams"), bag.alias("bag"))
    counts = coded.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()
    rank = [0] * _LETTERS**2
    for k, (gram_, _) in enumerate(sorted(counts, key=lambda r: (r[1], r[0]))):
        rank[gram_] = k
    order = f"cast(split('{','.join(map(str, rank))}', ',') as array<int>)"
    rare = F.expr(f"slice(array_sort(transform(grams, (g, i) -> named_struct('rank', element_at({order}, g + 1), 'pos', i))), 1, {PREFIX})")
    return coded.select("word", "n", "len", "bag", rare.alias("rare"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words (of two letters at least) exactly one inserted, deleted or replaced code point apart, once, a the shorter or smaller."""
    ranked = written(_rare_first(words), "rare-bigrams")
    kept = "array(concat('1', right(word, len - int(len / 3))), concat('2', left(word, int(len / 3)), right(word, len - int(2 * len / 3))), concat('3', left(word, int(2 * len / 3))))"
    a = ranked.select("word", "n", "len", "bag", F.inline("rare")).withColumn("kept", F.explode(F.expr(kept)))
    key = F.xxhash64("rank", "pos", "len", "kept").alias("key")
    a = a.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("len").alias("len_a"), F.col("bag").alias("bag_a"), key)
    # the partner's place: of the same length, or one code point shorter and the edit behind or before the bigram
    places = F.expr("flatten(transform(rare, r -> array(named_struct('rank', r.rank, 'pos', r.pos, 'len', len), named_struct('rank', r.rank, 'pos', r.pos, 'len', len - 1), named_struct('rank', r.rank, 'pos', r.pos - 1, 'len', len - 1))))")
    b = ranked.select("word", "n", "bag", F.inline(places)).withColumn("kept", F.explode(F.expr(kept)))
    b = b.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.length("word").alias("len_b"), F.col("bag").alias("bag_b"), key)
    apart = ((F.col("len_b") > F.col("len_a")) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("bag_a").bitwiseXOR(F.col("bag_b"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    # a planner sizes both by the file they are read from, before they are multiplied, and may send one whole through the driver
    met = a.hint("merge").join(b, "key").where(apart)
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form: pointers are doubled until none moves, as counts rise by RATIO in a few rounds."""
    cur = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = cur.select(F.col("word").alias("root"), F.col("root").alias("over"))
        step = written(cur.join(over.hint("merge"), "root", "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "forms")
        discard(cur)
        cur = step.drop("moved")
        if step.where("moved").isEmpty():
            return cur


def spelling_groups(docs: DataFrame, typo: int | None = TYPO) -> DataFrame:
    """Contract rows: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least RATIO
    times its own, else null; its root is where the forms lead, the word itself without one. An empty table gives none.
    """
    words = written(corpus_words(docs, typo=typo), "words")
    pairs = written(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best.other"))
    named = words.join(best.hint("merge"), "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.m")).alias("m"))
    named = written(named.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("m"))).drop("m"), "named-words")
    roots = _roots(named.where("form is not null"))
    return named.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
