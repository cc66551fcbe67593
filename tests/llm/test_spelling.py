"""Spelling variants against all words, deletions and wildcards counted plainly."""

import random
import re
import zlib
from collections import Counter, defaultdict

from lodemap.llm import spelling


def expected(rows, typo=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_equals_all_pairs(spark, rows, corpus):
    r = random.Random(3)
    words = ["Straße", "GRÖSSER", "naïveté", "÷×÷×÷×÷", "aaaaaaaa", "abababab", "abcabcabc", "letters", "lettered", "x" * 300]
    words += ["".join(r.choice("abc") for _ in range(r.randint(6, 8))) for _ in range(150)]
    texts = []
    for k in range(400):
        w = r.choice(words) if r.random() < 0.7 else words[k % 12]
        at = r.randint(0, len(w) - 1)
        w = r.choice([w] * 6 + [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1 :]])
        texts.append(f"{w} {r.choice(words)}1{w},short a-{w.upper()}日{w}")
    made = [(r.choice([k, k % 7, None]), t) for k, t in enumerate(texts)] + [(1, None), (2, ""), *[(3, "repeat repeat")] * 9]
    docs = corpus.select("doc_id", "text", "band").union(spark.createDataFrame([(*x, "clash") for x in made], "doc_id long, text string, band string"))
    got = spelling.spelling_groups(docs).collect()
    assert {tuple(x) for x in got} == expected([*rows, *made]) and len({x["word"] for x in got}) == len(got)
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_forms_lead_to_a_root(spark):
    counts = {"lettersabc": 1000, "lettersabd": 150, "lettersaee": 6, "lettersabe": 30, "strange": 5}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    got = {x["word"]: x for x in spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id long, text string"), typo=None).collect()}
    assert got["lettersabe"]["form"] == "lettersabc" and got["lettersaee"]["form"] == "lettersabe" and got["lettersaee"]["root"] == "lettersabc"
    assert got["strange"]["form"] is None and got["strange"]["root"] == "strange" and got["lettersabc"]["n_near"] == 2
