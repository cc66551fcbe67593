"""Conversation repair against damage, search and digests written plainly."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from lodemap.llm import repair

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def plain(rows):
    """Contract row of one conversation's rows (turn, role, text), which are damaged already and in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("B" if not solid else "D" if (role, text) in seen else "T" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]

    @lru_cache(maxsize=None)
    def best(i, state, left):  # at most three insertions in a row are worth trying
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for name in FULL if left else ():
            if (state, name) in GRAMMAR:
                c, s, t = best(i, GRAMMAR[state, name], left - 1)
                found.append((c + 3, "I" + s, (FULL[name] + ":", *t)))
        if i < len(rows):
            c, s, t = best(i + 1, state, 3)
            found.append((c + 4, "D" + s, t))
            if faults[i] in ("", "T"):
                extra = 3 * (faults[i] == "T")
                if (state, initials[i]) in GRAMMAR:
                    c, s, t = best(i + 1, GRAMMAR[state, initials[i]], 3)
                    found.append((c + extra, "K" + s, (f"{rows[i][1]}:{rows[i][2]}", *t)))
                for name in FULL:
                    if (state, name) in GRAMMAR:
                        c, s, t = best(i + 1, GRAMMAR[state, name], 3)
                        found.append((c + extra + 3, "R" + s, (f"{FULL[name]}:{rows[i][2]}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, texts = best(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()


def expected(table):
    """conv_id to contract row of a table of (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in table:
        of = held.setdefault(conv, [])
        space = lambda v: " " if v is None else str(v)
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        of += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{hashlib.sha256(r.encode()).hexdigest()}\n{t}".encode()).hexdigest()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], digest(*x[1:]))
    return {c: plain(tuple(sorted(rows, key=order))) for c, rows in held.items()}


def made(seed, n=120):
    r, out = random.Random(seed), []
    texts = ["Yes.", "No", " \t", "", "Go on!", "why?  \n", "a\n.", None, " "]
    for conv in [*range(n), None]:
        turn = r.randint(-2, 3)
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            turn += r.choice([1, 1, 1, 1, 2, 0])
            out.append((conv, r.choice([turn] * 12 + [None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]), r.choice(texts) if r.random() < 0.5 else f"text {r.randint(0, 9)}."))
    return out


def frame(spark, table):
    return spark.createDataFrame([(*x, "clash", 1) for x in table], "conv_id long, turn long, role string, text string, place string, digest int")


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("piece", [4096, 2])
def test_equals_plain_search(spark, monkeypatch, piece):
    """Also with matrices over two rows, so that nearly every conversation is joined from several."""
    monkeypatch.setattr(repair, "PIECE", piece)
    table = [*made(1), *[(7, 1, "user", "again and again")] * 40]
    assert got(repair.repaired(frame(spark, table))) == expected(table)


def test_lost_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.repaired(frame(spark, [(gone, 0, "user", "hello.")]))) == {gone: none}
    assert repair.repaired(frame(spark, [(1, 1, "u", "x")]).limit(0)).count() == 0


def test_matrices_join_to_the_path_over_all_rows():
    r = random.Random(4)
    for _ in range(300):
        rows = [(r.choice("suat"), r.choice(["", "", "", "T", "B", "D"])) for _ in range(r.randint(0, 12))]
        cuts = sorted(r.randint(0, len(rows)) for _ in range(2))
        parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]]
        whole = repair.join_pieces([repair.compose(rows)])
        assert repair.join_pieces([repair.compose(p) for p in parts if p]) == whole
        texts = [({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i], str(k)) for k, (i, _) in enumerate(rows)]
        fixed = "".join(role[0] for role, _ in repair.repaired_turns(whole[1], iter(texts)))
        assert re.fullmatch("(s?(ua)+)?", fixed)
