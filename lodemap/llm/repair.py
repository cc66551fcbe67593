"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily, one row at a time: the input acceptor reads the rows of a conversation, each as a
symbol (initial of its role, fault); the edit transducer keeps, reroles, deletes or inserts a turn at a cost; the
role-grammar acceptor takes the initials ``(s?(ua)+)?``. Weights are (cost, label string), compared in that order. From
a place and a grammar state each label leads to one successor only, and all strings over the same rows end with a row's
label, insertions standing before it: no string is a proper prefix of another, so the order of two paths is decided
where they part, and the shortest path needs, backwards in topological order, one choice for each state.

Rows are put in order over the whole table, so a conversation of any length is spread over tasks; each piece of at most
``PIECE`` rows is composed to a matrix over grammar states, and a conversation's matrices are joined by the same
shortest path. Only the digest of a repaired conversation runs over all of its texts, row by row, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

PIECE = 4096  # rows that are composed to one matrix; a power of two
START, SYSTEM, USER, ANSWERED = range(4)  # grammar states, by what was read last
FINAL = (START, ANSWERED)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWERED, (ANSWERED, "u"): USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; a truncated turn that stays adds its own
NAMES = {"u": "user", "a": "assistant"}  # what an insertion or a changed role can be
INF = 1 << 60
_BLANK = r"[^\x20\x09-\x0D]"
_ENDS = r"[.!?][\x20\x09-\x0D]*\z"

Weight = tuple[int, str]


@lru_cache(maxsize=None)
def edits(initial: str, fault: str, state: int) -> dict[str, tuple[int, int, str | None]]:
    """The edit transducer composed with the grammar: label to (cost, next state, role written) for one row in one state.

    ``initial`` is that of the row's role; a row of fault B (blank) or D (duplicate) can only go.
    """
    found: dict[str, tuple[int, int, str | None]] = {"D": (DELETE, state, None)}
    if fault not in ("B", "D"):
        more = TRUNCATED if fault == "T" else 0
        if (state, initial) in NEXT:
            found["K"] = (KEEP + more, NEXT[state, initial], None)
        for name in NAMES:
            if (state, name) in NEXT:
                found["R"] = (REROLE + more, NEXT[state, name], NAMES[name])
    return found


@lru_cache(maxsize=None)
def inserted(state: int) -> tuple[int, str] | None:
    """Next state and role of the one turn that can be inserted."""
    return next(((NEXT[state, name], NAMES[name]) for name in NAMES if (state, name) in NEXT), None)


@lru_cache(maxsize=None)
def row_matrix(initial: str, fault: str) -> tuple[tuple[Weight | None, ...], ...]:
    """Least (cost, labels) from state to state over one row, with the insertions before it; a state is not entered twice."""
    out = []
    for begin in range(4):
        best: list[Weight | None] = [None] * 4
        state, cost, labels, seen = begin, 0, "", {begin}
        while True:
            for label, (more, to, _) in edits(initial, fault, state).items():
                weight = (cost + more, labels + label)
                if best[to] is None or weight < best[to]:
                    best[to] = weight
            step = inserted(state)
            if step is None or step[0] in seen:
                break
            state, cost, labels = step[0], cost + INSERT, labels + "I"
            seen.add(state)
        out.append(tuple(best))
    return tuple(out)


@lru_cache(maxsize=None)
def closing() -> tuple[Weight | None, ...]:
    """Least (cost, labels) of the insertions behind the last row, for each state."""
    out: list[Weight | None] = []
    for begin in range(4):
        state, n = begin, 0
        while state not in FINAL:
            state, n = inserted(state)[0], n + 1
        out.append((INSERT * n, "I" * n))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _step_back(initial: str, fault: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int]:
    """Costs to the end from each state before a row, less the smallest; the state behind the row that each takes; the smallest.

    ``ahead`` has the costs behind the row. Costs apart from their smallest have few values, so most rows are looked up.
    """
    costs, choice = [], []
    for row in row_matrix(initial, fault):
        found = min(((w[0] + ahead[to], w[1], to) for to, w in enumerate(row) if w is not None and ahead[to] < INF), default=(INF, "", -1))
        costs.append(found[0])
        choice.append(found[2])
    least = min(costs)
    if least >= INF:
        return tuple(costs), tuple(choice), 0
    return tuple(c - least if c < INF else INF for c in costs), tuple(choice), least


def compose(rows: list[tuple[str, str]]) -> list[list[Weight | None]]:
    """Least (cost, labels) from state to state over the rows (initial, fault) of a piece."""
    out: list[list[Weight | None]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        ahead = tuple(0 if q == end else INF for q in range(4))
        total, choices = 0, []
        for initial, fault in reversed(rows):
            ahead, choice, least = _step_back(initial, fault, ahead)
            total += least
            choices.append(choice)
        choices.reverse()
        for begin in range(4):
            if ahead[begin] < INF:
                labels, q = [], begin
                for (initial, fault), choice in zip(rows, choices, strict=True):
                    labels.append(row_matrix(initial, fault)[q][choice[q]][1])
                    q = choice[q]
                out[begin][end] = (total + ahead[begin], "".join(labels))
    return out


def join_pieces(pieces: list[list[list[Weight | None]]]) -> Weight:
    """The shortest path from the start, over all pieces, to an accepted end."""
    ahead: list[int] = [w[0] if w else INF for w in closing()]
    choices = []
    for piece in reversed(pieces):
        costs, choice = [], []
        for row in piece:
            found = min(((w[0] + ahead[to], w[1], to) for to, w in enumerate(row) if w is not None), default=(INF, "", -1))
            costs.append(found[0])
            choice.append(found[2])
        ahead = costs
        choices.append(choice)
    labels, q = [], START
    for piece, choice in zip(pieces, reversed(choices), strict=True):
        labels.append(piece[q][choice[q]][1])
        q = choice[q]
    return ahead[START], "".join(labels) + closing()[q][1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that stay, by crc32(``conv_id:turn``) % 20; a null in any of them counts as one space.

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    of = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return of.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_again")).drop("_again")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with place (their order within a conversation), initial, fault (B or T; duplicates follow) and digest of role and text.

    The order is by turn (nulls first), role, the first 64 code points of the text and the digest. Ranges of the whole
    order are dealt out, so that one conversation, and even the copies of one row, may lie on many tasks.
    """
    digest = F.sha2(F.concat_ws("\n", F.sha2("role", 256), "text"), 256)
    keyed = rows.select("*", F.substring("text", 1, 64).alias("head"), digest.alias("digest"), F.rand(5).alias("salt"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    inside = keyed.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    fault = F.when(~F.col("text").rlike(_BLANK), "B").when(~F.col("text").rlike(_ENDS), "T").otherwise("")
    return inside.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "digest")


def _faults(ordered: DataFrame) -> DataFrame:
    """conv_id, turn, place, initial, fault of all rows; fault D where role and text stand earlier in the conversation."""
    slim = ordered.select("conv_id", "turn", "place", "initial", "fault", "digest")
    again = slim.where("fault <> 'B'").groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("of"), F.col("digest").alias("of_digest"), "first")
    joined = slim.join(again, slim["conv_id"].eqNullSafe(again["of"]) & (slim["digest"] == again["of_digest"]), "left")
    fault = F.when((F.col("fault") != "B") & (F.col("place") > F.col("first")), "D").otherwise(F.col("fault"))
    return joined.select("conv_id", "turn", "place", "initial", fault.alias("fault"))


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_PIECES = "conv_id bigint, piece bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", first_turn bigint, last_turn bigint, first string, last string, costs array<bigint>, labels array<string>"


def _composed(rows: DataFrame) -> DataFrame:
    """One row for each piece of a conversation: its counts, its ends and the matrix of its rows."""
    dealt = rows.withColumn("piece", F.shiftright("place", PIECE.bit_length() - 1)).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    def close(key: tuple, held: list[tuple]) -> dict:
        turns = [t for t, _, _ in held if t is not None]
        initials = [i for _, i, _ in held]
        faults = [f for *_, f in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        matrix = [w for row in compose([(i, f) for _, i, f in held]) for w in row]
        counts = (len(held), faults.count("B"), faults.count("D"), faults.count("T"), illegal, len(set(turns)))
        ends = {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first": initials[0], "last": initials[-1]}
        return {"conv_id": key[0], "piece": key[1], **dict(zip(_COUNTS, counts, strict=True)), **ends, "costs": [w[0] if w else -1 for w in matrix], "labels": [w[1] if w else "" for w in matrix]}

    kinds = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for conv, piece, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, piece):
                    if held:
                        out.append(close(key, held))
                    key, held = (conv, piece), []
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([close(key, held)], kinds)

    return dealt.select("conv_id", "piece", "turn", "initial", "fault").mapInArrow(scan, _PIECES)


def _joined(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, counts, cost and audit of each conversation, from its pieces in order."""

    def close(conv: int | None, held: list[dict]) -> dict:
        out = {c: sum(p[c] for p in held) for c in _COUNTS[1:]}
        last_turn = None
        for a, b in zip(held, held[1:], strict=False):
            out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
        for p in held:
            out["turns"] -= p["first_turn"] is not None and p["first_turn"] == last_turn
            last_turn = p["last_turn"] if p["last_turn"] is not None else last_turn
        first_turn = next((p["first_turn"] for p in held if p["first_turn"] is not None), None)
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - out.pop("turns")
        out.pop("turns", None)
        weights = [[w if w[0] >= 0 else None for w in zip(p["costs"], p["labels"], strict=True)] for p in held]
        cost, audit = join_pieces([[w[k : k + 4] for k in range(0, 16, 4)] for w in weights])
        return {"conv_id": conv, "gaps": gaps, **out, "cost": cost, "audit": audit}

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in names), ("audit", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != conv:
                    out.append(close(conv, held))
                    held = []
                conv = row["conv_id"]
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([close(conv, held)], kinds)

    schema = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in names) + ", audit string"
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(scan, schema)


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that an audit makes of a conversation's rows (role, text)."""
    state = START
    for label in audit:
        if label == "I":
            state, role = inserted(state)
            yield role, ""
            continue
        role, text = next(rows)
        if label == "R":
            state, role = inserted(state)
        elif label == "K":
            state = NEXT[state, role[:1]]
        else:
            continue
        yield role, text


def _digests(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: texts are read in order behind their conversation's audit, one row at a time."""
    heads = audits.select("conv_id", F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(ordered.select("conv_id", "place", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kinds = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ids: list[int | None] = []
        found: list[str] = []
        for conv, _, _, audit in stream:
            digest, first = hashlib.sha256(), True
            for role, text in repaired_turns(audit, ((r, t) for _, _, r, t in stream)):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            ids.append(conv)
            found.append(digest.hexdigest())
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], schema=kinds)
                ids, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], schema=kinds)

    return rows.mapInArrow(scan, "conv_id bigint, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered rows, conv_id with gaps, blank, duplicate, truncated, illegal, cost and audit) of conversation rows as they are."""
    ordered = written(_ordered(rows), "ordered-turns")
    return ordered, written(_joined(_composed(_faults(ordered))), "audits")


def repaired(conversations: DataFrame) -> DataFrame:
    """Contract rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id, after damage.

    Nulls count as one space (a null conv_id is one conversation, a null turn comes first); rows of equal turn go by
    role and text; repeated rows are duplicates. A conversation that lost all rows has zeros, no audit and the hash of
    the empty string; an empty table gives none. Other columns are ignored.
    """
    ordered, audits = repair(damage(conversations))
    digests = _digests(ordered, audits).withColumnRenamed("conv_id", "of")
    found = audits.join(digests, audits["conv_id"].eqNullSafe(digests["of"])).drop("of")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    all_ = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return all_.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
