"""Verification over texts and results: line scans, brackets, mutants, verdict ladders, freshness, registers."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line rules, with their severity.
LINE_RULES = (
    ("conflict_marker", "error", r"^(<{7}|={7}|>{7})"), ("todo", "info", r"\b(TODO|FIXME|HACK)\b"),
    ("debug_output", "warning", r"\bconsole\.log\(|\bprint\("), ("secret", "error", r"(?i)(password|api_?key)\s*=\s*['\"][^'\"]+['\"]"),
)
#: Mutation operators, in order: name, pattern, replacement.
MUTATIONS = (
    ("negate_equality", r"===(?!=)", "!=="),
    ("negate_inequality", r"!==(?!=)", "==="),
    ("flip_true", r"\btrue\b", "false"),
    ("flip_false", r"\bfalse\b", "true"),
    ("remove_return", r"return [^;]+;", "return undefined;"),
    ("boundary_lt", r"< (?!=)", "<= "),
    ("boundary_gt", r"> (?!=)", ">= "),
    ("arith_plus", r"\+ (?!=)", "- "),
    ("arith_minus", r"- (?!=)", "+ "),
)
#: Parts of a path, and endings, of files that are not mutated.
NOT_MUTATED = ("node_modules/", ".test.", ".spec.", "__tests__/", "/test/", "/tests/", ".config.", ".conf.", ".min.", "vendor/", ".d.ts")
NOT_MUTATED_ENDINGS = ".json .md .txt .yaml .yml .lock .svg .png .jpg .gif .ico .woff .ttf .css .scss .less .html .xml .toml .ini .env .map".split()


def scan_lines(files: DataFrame) -> DataFrame:
    """path, line, rule, severity, snippet (120 characters) of every line that a rule hits."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    hits = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in LINE_RULES]))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.explode(hits).alias("h"), F.substring("body", 1, 120).alias("snippet")).select("path", "line", "h.rule", "h.severity", "snippet")


def first_bracket_error(text: str) -> str | None:
    """The first unbalanced bracket outside strings and comments, as 'line: what', or None."""
    pairs, stack, line, i, n = {")": "(", "]": "[", "}": "{"}, [], 1, 0, len(text)
    while i < n:
        c = text[i]
        if c == "\n":
            line += 1
        elif c in "\"'`":
            begun = line
            i += 1
            while i < n and text[i] != c:
                if text[i] == "\\":
                    i += 1
                elif text[i] == "\n":
                    if c != "`":
                        break
                    line += 1
                i += 1
            if i >= n or text[i] != c:
                if c == "`":
                    return f"{begun}: open {c}"
                continue
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                return f"{line}: open comment"
            line += text.count("\n", i, end)
            i = end + 1
        elif c in "([{":
            stack.append((c, line))
        elif c in pairs:
            if not stack or stack.pop()[0] != pairs[c]:
                return f"{line}: stray {c}"
        i += 1
    return f"{stack[-1][1]}: open {stack[-1][0]}" if stack else None


def check_brackets(files: DataFrame) -> DataFrame:
    """path, error of files whose brackets do not balance."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = pd.DataFrame({"path": f["path"], "error": [first_bracket_error(t or "") for t in f["text"]]})
            yield made[made["error"].notna()]

    return files.select("path", "text").mapInPandas(check, "path string, error string")


def mutable(path: Column) -> Column:
    """Whether a file is one to mutate, by its path."""
    skipped = F.lit(False)
    for part in NOT_MUTATED:
        skipped = skipped | path.contains(part)
    return ~skipped & ~F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(NOT_MUTATED_ENDINGS)


def mutants(files: DataFrame, most: int = 10, least: int = 50, largest: int = 500_000) -> DataFrame:
    """path, operator, at, line, before, after: the first ``most`` mutants of a file, by operator and place."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(name, re.compile(p), r) for name, p, r in MUTATIONS]
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"], strict=True):
                made = itertools.islice(((k, m.start(), m[0], r) for k, p, r in rules for m in p.finditer(text)), most)
                breaks = [m.start() for m in re.finditer("\n", text)]
                rows += [(path, k, at, bisect.bisect_left(breaks, at) + 1, before, after) for k, at, before, after in made]
            yield pd.DataFrame(rows, columns=["path", "operator", "at", "line", "before", "after"])

    sized = files.where(F.length("text").between(least, largest) & mutable(F.col("path"))).select("path", "text")
    return sized.mapInPandas(make, "path string, operator string, at long, line int, before string, after string")


def evaluate(expected: Column, exit_code: Column, output: Column) -> Column:
    """PASS, FAIL or INCONCLUSIVE: an expected code, then a quoted or contained text, then the exit code."""
    code = F.regexp_extract(expected, r"(?i)exit(?:s| code)?\s*(?:with\s*)?(\d+)", 1)
    quoted = F.regexp_extract(expected, r"[\"'`]([^\"'`]+)[\"'`]", 1)
    text = F.lower(F.coalesce(output, F.lit("")))
    return (
        F.when(code != "", F.when(exit_code == code.cast("int"), "PASS").otherwise("FAIL"))
        .when(quoted != "", F.when(text.contains(F.lower(quoted)), "PASS").otherwise("FAIL"))
        .when(exit_code != 0, "FAIL")
        .when(text.rlike(r"\b(error|exception|traceback)\b"), "FAIL")
        .when(text == "", "INCONCLUSIVE")
        .otherwise("PASS")
    )


def key_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """source, pattern, found: whether the source file holds the pattern."""
    j = links.join(files.select(F.col("path").alias("source"), "text"), "source", "left")
    return j.select("source", "pattern", F.coalesce(F.col("text").contains(F.col("pattern")), F.lit(False)).alias("found"))


def fixability(layers: DataFrame, fixable: tuple[str, ...]) -> DataFrame:
    """who, layers, errors of failed, not skipped layers: for the machine or for people."""
    failed = layers.where("not passed and not skipped")
    return failed.groupBy(F.when(F.col("layer").isin(*fixable), "auto").otherwise("human").alias("who")).agg(F.count("*").alias("layers"), F.sum("errors").alias("errors"))


def freshness(stamps: DataFrame, now: Column, hours: Column) -> DataFrame:
    """what, age_hours, stale of things with a stamp ``ts``: older than ``hours``."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    return stamps.groupBy("what").agg(F.min(age).alias("age_hours"), F.min(hours).alias("_most")).select("what", "age_hours", (F.col("age_hours") >= F.col("_most")).alias("stale"))


def cached(results: DataFrame, keys: list[str], ts: str, now: Column, seconds: int = 120) -> DataFrame:
    """The newest result of each key that is at most ``seconds`` old; the content hash of what was checked belongs to the key."""
    live = results.where((F.col(ts) <= now) & (F.col(ts) >= now - F.expr(f"interval {seconds} seconds")))
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(c) for c in results.columns if c not in (*keys, ts)])
    return live.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def severity_of(impact: Column) -> Column:
    return F.when(impact.isin("critical", "serious"), "error").when(impact == "moderate", "warning").otherwise("info")


def risk_register(hotspots: DataFrame, interfaces: DataFrame, cycles: DataFrame, churn: DataFrame) -> DataFrame:
    """kind, subject, metric, level, rank: the four sources together, worst first."""
    level = lambda x, a, b, c: F.when(x > a, "CRITICAL").when(x > b, "HIGH").when(x > c, "MEDIUM").otherwise("LOW")
    parts = [
        hotspots.select(F.lit("hotspot").alias("kind"), F.col("path").alias("subject"), F.col("risk_score").cast("double").alias("metric"), level(F.col("risk_score"), 5000, 2500, 1000).alias("level")),
        interfaces.select(F.lit("interface").alias("kind"), F.concat_ws(":", "file", "name").alias("subject"), F.col("consumer_count").cast("double").alias("metric"), level(F.col("consumer_count"), 15, 10, 5).alias("level")),
        cycles.select(F.lit("cycle").alias("kind"), F.col("component").cast("string").alias("subject"), F.col("size").cast("double").alias("metric"), level(F.col("size"), 10, 5, 2).alias("level")),
        churn.select(F.lit("churn").alias("kind"), F.col("file").alias("subject"), F.col("changes_30d").cast("double").alias("metric"), level(F.col("changes_30d"), 60, 30, 10).alias("level")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("level") == "CRITICAL", 0).when(F.col("level") == "HIGH", 1).when(F.col("level") == "MEDIUM", 2).otherwise(3)
    return out.withColumn("rank", rank).orderBy("rank", F.desc("metric"), "kind", "subject")


def change_frequency(commits: DataFrame, anchor: Column, authors: int = 5) -> DataFrame:
    """file, changes_7d/30d/90d, last_changed, top_changers (distinct authors, newest first) of commits (file, author, ts)."""
    counts = [F.count_if(F.col("ts") >= anchor - F.expr(f"interval {d} days")).alias(f"changes_{d}d") for d in (7, 30, 90)]
    per = commits.groupBy("file").agg(*counts, F.max("ts").alias("last_changed"))
    newest = commits.groupBy("file", "author").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("file").orderBy(F.desc("ts"), "author")
    top = newest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= authors)
    who = top.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "author"))), lambda x: x["author"]).alias("top_changers"))
    return per.join(who, "file")


def byte_diff(pairs: DataFrame) -> DataFrame:
    """key, ratio: differing bytes and the difference in length, over the longer length (four places); columns a and b are binary."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b in zip(f["a"], f["b"], strict=True):
                a, b = a or b"", b or b""
                n, most = min(len(a), len(b)), max(len(a), len(b))
                d = int((np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)).sum()) + most - n
                out.append(round(d / most, 4) if most else 0.0)
            yield pd.DataFrame({"key": f["key"], "ratio": out})

    return pairs.select("key", "a", "b").mapInPandas(run, "key string, ratio double")
