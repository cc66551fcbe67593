"""Secret scans with multipart credential linking.

Base kinds are found by pattern over whole texts. Linking then looks for the parts of one credential: access
identifiers, secret values and endpoints. A part that is weak alone (a bare high-entropy value or an endpoint) is
reported only if complementary parts stand in its scope: within ``SCOPE`` characters and with no blank line between.
The parts of a text are sorted by place and joined with the identifiers whose interval they meet, so the work follows
the parts and their matches. Each text stands alone, whatever group or source it belongs to.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order of the contract, with the group that is measured and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the runs of 16 or more among all runs
)
#: Parts that count only with their complements.
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:ASIA[A-Z0-9]{16}(?![A-Z0-9])|(?i:access_?key_?id|client_?id|user_?name|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,})""")
ENDPOINT = re.compile(r"\b(?:https?|s3|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]{4,}")
SCOPE = 400
LEAST_ENTROPY = 3.5
_DIGIT = re.compile(r"[0-9]")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping within their kind."""
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        if k == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


class _Cover:
    """Merged spans, asked whether another one meets them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e) - 1
        return k >= 0 and self.ends[k] > s


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, str, int]]:
    """(start, kind, end) of linked parts: ``linked_identifier``, ``linked_value``, ``linked_endpoint`` and the ``credential`` that spans them.

    Identifiers are access matches (reported anyway) and the weaker ones of IDENTIFIER; secrets are assign and hex
    matches and the weaker ones of VALUE. A secret links to an identifier if their gap is at most ``scope`` and holds no
    blank line; a weak part is reported only then, and an endpoint only beside an identifier that has a secret. No weak
    part overlaps a base span, or an identifier.
    """
    if not (strong := [(s, e) for s, k, e in base if k == 1]) and not IDENTIFIER.search(text):
        return []
    taken = _Cover([(s, e) for s, _, e in base])
    weak = [m.span() for m in IDENTIFIER.finditer(text) if not taken.meets(*m.span())]
    ids = sorted(strong + weak)
    taken = _Cover([*((s, e) for s, _, e in base), *weak])
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    starts = [s for s, _ in ids]
    longest = max((e - s for s, e in ids), default=0)

    def partners(s: int, e: int) -> list[tuple[int, int]]:
        lo, hi = bisect.bisect_left(starts, s - scope - longest), bisect.bisect_right(starts, e + scope)
        found = []
        for a, b in ids[lo:hi]:
            left, right = (b, s) if a < s else (e, a)
            if right - left <= scope and bisect.bisect_left(breaks, left) == bisect.bisect_left(breaks, max(left, right)):
                found.append((a, b))
        return found

    secrets = [(s, e) for s, k, e in base if k in (0, 2)]
    values = [m.span() for m in VALUE.finditer(text) if _DIGIT.search(m[0]) and not taken.meets(*m.span()) and _entropy(m[0]) >= LEAST_ENTROPY]
    by_id: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for k, (s, e) in enumerate([*secrets, *values]):
        for x in (got := partners(s, e)):
            by_id.setdefault(x, []).append((s, e))
        if got and k >= len(secrets):
            out.append((s, "linked_value", e))
    out += [(s, "linked_identifier", e) for s, e in weak if (s, e) in by_id]
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for m in ENDPOINT.finditer(text):
        s, e = m.span()
        if got := [x for x in partners(s, e) if x in by_id]:
            out.append((s, "linked_endpoint", e))
            for x in got:
                ends.setdefault(x, []).append((s, e))
    for x, parts in by_id.items():
        every = [x, *parts, *ends.get(x, [])]
        out.append((min(s for s, _ in every), "credential", max(e for _, e in every)))
    return sorted(set(out))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of doc_id and text: n_assign, n_access, n_hex, base_sha256, spans.

    Offsets count code points. A null text is empty; repeated rows repeat their result; other columns are ignored.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {name: k for k, (name, *_) in enumerate(BASE)}
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                counts = Counter(k for _, k, _ in base)
                named = [(s, BASE[k][0], e) for s, k, e in base]
                said = ",".join(f"{k}:{s}:{e}" for s, k, e in named)
                every = sorted([*named, *linked_spans(text, base, scope)], key=lambda x: (x[0], order.get(x[1], 9), x[1], x[2]))
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, schema)
