"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct 5-word shingles. Each shingle's hash drives a Poisson process whose points fall
on random registers; a register keeps the smallest point, on an exponential scale (base ``BASE``) in one byte, so
registers of a union are the larger registers and equal registers are the likelier the more alike the sets. Registers
are banded; a bucket's members meet its hub, the counts of larger, equal and smaller registers give the likelihood of
the similarity, and what is not clearly below the bound is verified on the full sets. Verified links contract
documents to components; what a bucket then still holds of other components is compared pair by pair in bounded
blocks, so no link in a shared bucket is lost, and no group of copies is expanded into its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, joined_components
from .kernels import arrow_bytes, blocks, lower_ascii_table, mix64, rows_of, span_hash, span_ids, word_grams, word_spans
from .storage import written

REGISTERS, BASE, ROWS = 256, 1.2, 6
BANDS = REGISTERS // ROWS
SHINGLE = 5
MARGIN = 0.15  # an estimate this far below the bound is over six standard errors away
U_BLOCK, A_BLOCK = 256, 512
SMALL = 16  # members of a bucket whose pairs may be listed; larger buckets are verified in place
_LOWER = lower_ascii_table()
_FLAG = np.ones(256, bool)
_FLAG[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, another hash) of each text's distinct shingles, sorted; a text of fewer words is one shingle, without words none."""
    low = _LOWER[data]
    start, end = word_spans(_FLAG[data], offs)
    row = np.searchsorted(offs, start, "right") - 1
    counts = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(counts) - counts
    same = row[: max(0, len(row) - size + 1)] == row[size - 1 :]
    rows, hashes = [row[: len(same)][same]], []
    for seed in (0, 1):
        words = span_hash(low, start, end, seed)
        parts = [word_grams(words, size)[same]]
        for n in set(counts[(counts > 0) & (counts < size)].tolist()):
            own = np.flatnonzero(counts == n)
            g = np.zeros(len(own), np.uint64)
            for k in range(n):
                g = mix64(g + words[first[own] + k] + np.uint64(n))
            parts.append(g)
            if seed == 0:
                rows.append(own)
        hashes.append(np.concatenate(parts))
    r, (h, h2) = np.concatenate(rows), hashes
    order = np.lexsort((h, r))
    r, h, h2 = r[order], h[order], h2[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[keep], h[keep], h2[keep]


def exact_shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each text's distinct shingles, sorted; numbers are equal exactly if the words are."""
    start, end = word_spans(_FLAG[data], offs)
    _, words = span_ids(_LOWER[data], start, end)
    row = np.searchsorted(offs, start, "right") - 1
    counts = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(counts) - counts
    same = row[: max(0, len(row) - size + 1)] == row[size - 1 :]
    bits = int(words.max()).bit_length() if len(words) else 1
    key, width = words[: len(same)], bits
    for k in range(1, size):
        if width + bits > 62:
            key = np.unique(key, return_inverse=True)[1]
            width = int(key.max()).bit_length() if len(key) else 1
        key, width = key << bits | words[k : k + len(same)], width + bits
    number = np.unique(key[same], return_inverse=True)[1]
    short: dict[tuple[int, ...], int] = {}
    own = np.flatnonzero((counts > 0) & (counts < size))
    few = [short.setdefault(tuple(words[f : f + n].tolist()), len(number) + len(short)) for f, n in zip(first[own].tolist(), counts[own].tolist(), strict=True)]
    rows, numbers = np.concatenate([row[: len(same)][same], own]), np.concatenate([number, np.array(few, np.int64)])
    most = len(number) + len(short) + 1
    both = np.unique(rows * most + numbers)
    return both // most, both % most


def registers(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS bytes: the SetSketch of each row's hashes (zeros for an empty set)."""
    low = np.full(n * REGISTERS, np.inf)
    counts = np.bincount(row, minlength=n)
    reach = REGISTERS * (math.log(REGISTERS) + 8)
    todo = counts > 0
    while todo.any():
        at = np.flatnonzero(todo[row])
        limit = reach / np.maximum(counts, 1)
        value = np.zeros(len(at))
        step = 0
        while len(at):
            x = mix64(h[at] + np.uint64((step * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1))
            value = value - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = value <= limit[row[at]]
            at, value, x = at[on], value[on], x[on]
            np.minimum.at(low, row[at] * REGISTERS + (x & np.uint64(REGISTERS - 1)).astype(np.int64), value)
            step += 1
        todo &= ~np.isfinite(low.reshape(n, REGISTERS)).all(axis=1)
        reach *= 2
    with np.errstate(divide="ignore"):
        scaled = np.floor(64 - np.log(low) / math.log(BASE))
    return np.clip(np.where(np.isfinite(low), scaled, 0), 0, 255).astype(np.uint8).reshape(n, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of ROWS registers each."""
    wide = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(wide.shape[:2], np.uint64)
    for k in range(ROWS):
        key = key << np.uint64(8) | wide[:, :, k]
    return mix64(key | np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(48))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities from pairs of registers and the sets' sizes, on a grid of hundredths."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.arange(0, 101)[None, :] / 100
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = np.where(more > 0, more * np.log(up), 0) + np.where(less > 0, less * np.log(down), 0) + np.where(same > 0, same * np.log(np.maximum(1 - up - down, 1e-300)), 0)
    like = np.where(j <= np.minimum(u / v, v / u) + 0.01, like, -np.inf)
    return np.argmax(like, axis=1) / 100


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = arrow_bytes(column)
    return data.reshape(-1, REGISTERS)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (of the set), regs of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, regs = [], [], []
            for i, j, data, offs in rows_of(batch, "text"):
                row, h, h2 = shingle_sets(data, offs, size)
                n = np.bincount(row, minlength=j - i)
                edge = np.concatenate([[0], np.cumsum(n)])
                raw = np.stack([h, h2], axis=1).tobytes()
                digests += [hashlib.blake2b(raw[16 * edge[k] : 16 * edge[k + 1]], digest_size=16).digest() for k in range(j - i)]
                counts.append(n)
                regs += [x.tobytes() for x in registers(row, h, j - i)]
            made = [pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "text_key", "n_shingles", "digest", "regs"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(scan, "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "cid"])

    return reps.select("cid", "regs").mapInArrow(scan, "band bigint, cid bigint")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, likely: pairs whose estimated similarity is not clearly below the bound."""
    left = reps.select(F.col("cid").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("cid").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    sized = F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                got = estimate(_matrix(part.column(2)), _matrix(part.column(3)), part.column(4).to_numpy(), part.column(5).to_numpy())
                on = got >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(on)), part.column(1).filter(pa.array(on)), pa.array(got[on])], ["a", "b", "likely"])

    joined = pairs.join(left, "a").join(right, "b").where(sized).select("a", "b", "ra", "rb", "na", "nb")
    return joined.mapInArrow(keep, "a bigint, b bigint, likely double")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """a, b of the pairs whose full sets of words, compared by value, meet the bound."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = part.num_rows
                order = pa.array(np.arange(2 * m).reshape(2, m).T.ravel())
                data, offs = arrow_bytes(pa.concat_arrays([part.column(2), part.column(3)]).take(order))
                on = []
                for i, j in blocks(offs[::2]):  # pairs side by side
                    edge = offs[2 * i : 2 * j + 1]
                    row, number = exact_shingles(data[edge[0] : edge[-1]], edge - edge[0], size)
                    n = np.bincount(row, minlength=2 * (j - i)).reshape(-1, 2)
                    both = np.sort((row >> 1) * (int(number.max(initial=0)) + 1) + number)
                    met = both[1:][both[1:] == both[:-1]] // (int(number.max(initial=0)) + 1)
                    common = np.bincount(met, minlength=j - i)
                    on.append(100 * common >= percent * (n.sum(axis=1) - common))
                mask = pa.array(np.concatenate([*on, np.zeros(0, bool)]))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def _set_rows(texts: DataFrame, size: int) -> DataFrame:
    """cid and the sorted shingle hashes of its text, as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for i, j, data, offs in rows_of(batch, "text"):
                row, h, _ = shingle_sets(data, offs, size)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                sets += [h[edge[k] : edge[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "set"])

    return texts.mapInArrow(scan, "cid bigint, set binary")


def _mixed(multi: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component: band, cid, root, other (not the hub's component), blocks."""
    held = multi.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("band", "hub", "cid", F.coalesce("root", "cid").alias("root"))
    hubs = held.where("cid = hub").select("band", F.col("root").alias("hub_root"))
    marked = held.join(hubs, "band").withColumn("other", (F.col("root") != F.col("hub_root")).cast("int"))
    sizes = marked.groupBy("band").agg(F.count("*").alias("na"), F.sum("other").alias("nu")).where("nu > 0")
    sizes = sizes.select("band", "na", F.ceil(F.col("nu") / U_BLOCK).cast("int").alias("ub"), F.ceil(F.col("na") / A_BLOCK).cast("int").alias("ab"))
    return marked.select("band", "cid", "root", "other").join(sizes, "band")


def _blocked(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a bucket's comparison, dealt out in blocks: members outside the hub's component, and all members."""
    kept = ["cid", "root", *columns]
    mine, all_ = F.pmod(F.xxhash64("cid"), F.col("ub")), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("ab"))
    u = rows.where("other = 1").select("band", mine.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("j"), *kept)
    a = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("i"), all_.cast("int").alias("j"), *kept)
    return u, a.toDF("band_", "i_", "j_", *[f"{c}_" for c in kept])


def _sized(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can meet the bound."""
    return np.maximum(a, b) * percent <= np.minimum(a, b) * 100


def _equal(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether enough registers are equal for the estimate to be worth making."""
    return (a == b).sum(axis=1) >= int((percent / 100 - 2 * MARGIN) * REGISTERS)


def _columns(table: pa.Table, *names: str) -> list[pa.Array]:
    return [table.column(c).combine_chunks() for c in names]


def _left_over(mixed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components in small mixed buckets that may be linked.

    A bucket is one row of SMALL members at most, and Python takes many buckets at once: one group each costs far more than its pairs.
    """
    rows = mixed.where(F.col("na") <= SMALL).select("band", "cid", "root").join(reps.select("cid", "n_shingles", "regs"), "cid")
    buckets = rows.groupBy("band").agg(F.collect_list(F.struct("cid", "root", "n_shingles", "regs")).alias("of")).select("of.cid", "of.root", "of.n_shingles", "of.regs")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cid, root, n = (part.column(k).flatten().to_numpy() for k in range(3))
                regs, counts = _matrix(part.column(3).flatten()), part.column(0).value_lengths().to_numpy().astype(np.int64)
                later = np.repeat(np.cumsum(counts), counts) - np.arange(len(cid)) - 1  # members of the bucket behind each
                a = np.repeat(np.arange(len(cid)), later)
                b = np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later) + a + 1
                on = (root[a] != root[b]) & _sized(n[a], n[b], percent)
                a, b = a[on], b[on]
                for k in range(0, len(a), 2048):
                    x, y = a[k : k + 2048], b[k : k + 2048]
                    on = _equal(regs[x], regs[y], percent)
                    x, y = x[on], y[on]
                    on = estimate(regs[x], regs[y], n[x], n[y]) >= percent / 100 - MARGIN
                    x, y = cid[x[on]], cid[y[on]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return buckets.mapInArrow(meet, "a bigint, b bigint").distinct()


def linked_sets(left: pa.Array, right: pa.Array, may: list[np.ndarray], percent: int, budget: int = 1 << 23) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of ``left``, those of its rows of ``right`` in ``may`` whose sets meet the bound; a set is its hashes, eight bytes each.

    The hashes of a run of rows of either side are numbered once; a row then marks its own and counts the marks of all its partners in one pass.
    """
    (x, x_offs), (y, y_offs) = arrow_bytes(left), arrow_bytes(right)
    x, y, x_edge, y_edge = x.view(np.uint64), y.view(np.uint64), x_offs // 8, y_offs // 8
    sizes = np.diff(y_edge)
    for p, q in blocks(y_offs, budget):
        edge = y_edge[p : q + 1] - y_edge[p]
        for i, j in blocks(x_offs, budget):
            here = [(k, at) for k in range(i, j) if len(at := may[k][(may[k] >= p) & (may[k] < q)])]
            if not here:
                continue
            number = np.unique(np.concatenate([y[y_edge[p] : y_edge[q]], x[x_edge[i] : x_edge[j]]]), return_inverse=True)[1]
            theirs, ours = number[: edge[-1]], number[edge[-1] :]
            marked = np.zeros(len(number), np.int64)
            for k, at in here:
                own = ours[x_edge[k] - x_edge[i] : x_edge[k + 1] - x_edge[i]]
                marked[own] = 1
                items = np.concatenate([theirs[edge[o] : edge[o + 1]] for o in (at - p).tolist()])
                common = np.add.reduceat(marked[items], np.cumsum(sizes[at]) - sizes[at])
                marked[own] = 0
                yield k, at[100 * common >= percent * (len(own) + sizes[at] - common)]


def _crowded_links(mixed: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components in larger mixed buckets: enough equal registers, then the hashes of full sets within each block.

    A block reports one link for each pair of components that it joins, so what comes out follows the members and not
    their pairs.
    """
    u, a = _blocked(mixed.join(reps.select("cid", "n_shingles", "regs"), "cid").join(sets, "cid"), "n_shingles", "regs", "set")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if left.num_rows and right.num_rows:
            own, root, n = (x.to_numpy() for x in _columns(left, "cid", "root", "n_shingles"))
            ids, roots, sizes = (x.to_numpy() for x in _columns(right, "cid_", "root_", "n_shingles_"))
            mine, others = (_matrix(_columns(t, c)[0]) for t, c in ((left, "regs"), (right, "regs_")))
            may = []
            for k in range(len(own)):
                at = np.flatnonzero((roots != root[k]) & _sized(sizes, n[k], percent))
                may.append(at[_equal(others[at], mine[k], percent)])
            for k, at in linked_sets(*_columns(left, "set"), *_columns(right, "set_"), may, percent):
                for o in at[np.unique(roots[at], return_index=True)[1]].tolist():
                    found.setdefault((int(min(root[k], roots[o])), int(max(root[k], roots[o]))), (int(own[k]), int(ids[o])))
        cols = list(zip(*found.values(), strict=True)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return u.groupBy("band", "i", "j").cogroup(a.groupBy("band_", "i_", "j_")).applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """Contract rows: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Texts with equal sets are
    one class from the start, so copies cost one row each. Null texts, empty texts and texts without words are linked
    with nothing and kept. A null doc_id is kept only if its component has no other. Repeated rows share a component.
    Other columns are ignored.
    """
    out = grouped(docs, percent, size)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def grouped(docs: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, pick: each row with the doc_id and text_key that stand for its component.

    The pick has the smallest doc_id (null last), then the smallest text_key; texts without words have none.
    """
    table = written(sketches(docs, size), "sketches")
    filled = table.where("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").alias("rep_id"), F.col("text_key").alias("rep_key"))).alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("pick"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    reps = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    bands = written(_bands(reps), "bands")
    hubs = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("hub")).where("n > 1").select("band", "hub")
    multi = written(bands.join(hubs, "band").select("band", "hub", "cid"), "buckets")
    star = multi.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    likely = written(_likely(star, reps, percent), "likely")

    # texts of the classes, by their first document (any of equal set will do)
    keyed = reps.select("cid", "rep.*")
    repeated = written(filled.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).count().where("count > 1").drop("count"), "repeated-rows")
    some = not repeated.isEmpty()
    if some:
        again = keyed["rep_id"].eqNullSafe(repeated["of_id"]) & (keyed["rep_key"] == repeated["of_key"])
        keyed = keyed.join(repeated, again, "left").select("cid", "rep_id", "rep_key", F.col("of_key").isNotNull().alias("again"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(keyed, "cid")

        def found(of: DataFrame) -> DataFrame:
            return source.join(of, source["doc_id"].eqNullSafe(of["rep_id"]) & (source["text_key"] == of["rep_key"])).select("cid", "text")

        if not some:
            return found(wanted)
        once = found(wanted.where("again")).groupBy("cid").agg(F.first("text").alias("text"))
        return found(wanted.where("not again")).unionByName(once)

    best = likely.groupBy("b").agg(F.max_by("a", F.struct("likely", "a")).alias("a")).select("a", "b")
    links = written(_verified(best, texts_of(best), percent, size), "links")
    roots = written(connected_components(links), "roots")

    def cross(pairs: DataFrame) -> DataFrame:
        ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        apart = pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        return written(apart.select("a", "b"), "cross-pairs")

    rest = cross(likely.select("a", "b").join(best, ["a", "b"], "left_anti"))
    roots = joined_components(roots, _verified(rest, texts_of(rest), percent, size))

    mixed = written(_mixed(multi, roots), "mixed-buckets")
    crowded = mixed.where(F.col("na") > SMALL)
    wanted = crowded.select("cid").distinct()
    sets = written(_set_rows(texts_of(wanted.select(F.col("cid").alias("a"), F.col("cid").alias("b"))), size), "sets")
    dense = _crowded_links(crowded, reps, sets, percent)
    few = _left_over(mixed, reps, percent).join(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = written(dense.unionByName(few), "left-over")
    roots = joined_components(roots, _verified(rest, texts_of(rest), percent, size))

    named = reps.select("cid", "digest", "first", "pick").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.min("pick").alias("pick"))
    named = named.drop("pick").join(least, "root").select("digest", "component_id", "pick")
    return table.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left").drop("digest")
