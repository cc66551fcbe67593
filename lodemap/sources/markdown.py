"""Documents as relations: requirements, contracts, glossaries, ledgers, front matter, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str) -> DataFrame:
    """key, line (from 1), body."""
    return docs.select(key, F.posexplode(F.split("text", "\r?\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def requirements(docs: DataFrame, key: str) -> DataFrame:
    """key, id, category (the heading above), text, depends_on (of the next line), line of every checkbox requirement."""
    body = F.col("body")
    w = Window.partitionBy(key).orderBy("line")
    heading = F.nullif(F.regexp_extract(body, r"^##\s+(.+?)\s*$", 1), F.lit(""))
    marked = lines(docs, key).withColumn("category", F.last(heading, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("body").over(w))
    pattern = r"^\s*-\s*\[[ xX]\]\s*\*\*([A-Z]+-\d+)\*\*:?\s*(.*?)\s*$"
    inner = F.regexp_extract("next", r"^\s*depends_on:\s*\[([^\]]*)\]", 1)
    needs = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    out = marked.withColumn("id", F.regexp_extract(body, pattern, 1)).where("id <> ''")
    return out.select(key, "id", "category", F.regexp_extract(body, pattern, 2).alias("text"), F.coalesce(needs, F.array().cast("array<string>")).alias("depends_on"), "line")


def dependency_edges(reqs: DataFrame) -> DataFrame:
    """src, dst of requirements; targets that are not defined are nodes too."""
    return reqs.select(F.col("id").alias("src"), F.explode("depends_on").alias("dst"))


def glossary(docs: DataFrame, key: str) -> DataFrame:
    """key, term, definition, aliases, used_in of table rows; the header, separators and rows of one cell are passed over."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("body"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines(docs, key).where(F.trim("body").startswith("|")).withColumn("c", cells).where((F.size("c") >= 2) & ~F.col("body").rlike(r"^\s*\|[\s:|-]+$"))
    rows = rows.where(~F.lower(F.element_at("c", 1)).isin("term", "name"))
    get = lambda i: F.get("c", F.lit(i))
    return rows.select(key, get(0).alias("term"), get(1).alias("definition"), get(2).alias("aliases"), get(3).alias("used_in"))


#: The labelled fields of a contract block.
CONTRACT_FIELDS = {"endpoint": "Endpoint", "response": "Response", "payload": "Payload", "channel": "Channel", "status_codes": "Status Codes", "proto": "Proto"}


def contracts(docs: DataFrame, key: str) -> DataFrame:
    """key, type, provider, consumer and the fields of every ### block; the pair is the last ## heading of the text."""
    pairs = F.regexp_extract_all("text", F.lit(r"(?m)^##\s+(.+?)\s*(?:->|→)\s*.+?\s*$"), F.lit(1))
    others = F.regexp_extract_all("text", F.lit(r"(?m)^##\s+.+?\s*(?:->|→)\s*(.+?)\s*$"), F.lit(1))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    blocks = docs.select(key, last(pairs).alias("provider"), last(others).alias("consumer"), F.explode(F.slice(F.split("text", r"(?m)^###\s+"), 2, 2**30)).alias("block"))
    fields = [F.nullif(F.regexp_extract("block", rf"(?im)^\s*-?\s*\*\*{label}\*\*:?\s*(.+?)\s*$", 1), F.lit("")).alias(name) for name, label in CONTRACT_FIELDS.items()]
    return blocks.select(key, F.lower(F.regexp_extract("block", r"^(\S+)", 1)).alias("type"), "provider", "consumer", *fields)


def ledger(docs: DataFrame, key: str) -> DataFrame:
    """key, section, nth, stamp, severity, text of a sectioned log's lines."""
    body = F.col("body")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(docs, key).withColumn("section", F.last(F.nullif(F.regexp_extract(body, r"^##\s+(.+?)\s*$", 1), F.lit("")), True).over(w))
    rows = marked.where(body.rlike(r"^\s*[-\[]") & F.col("section").isNotNull())
    stamp = F.nullif(F.regexp_extract(body, r"\[(\d{4}-\d{2}-\d{2}[T ]?[\d:.Z]*)\]", 1), F.lit(""))
    severity = F.lower(F.nullif(F.regexp_extract(body, r"(?i)\b(low|medium|high|critical)\b", 1), F.lit("")))
    text = F.trim(F.regexp_replace(body, r"^\s*-?\s*(\[[^\]]*\]\s*)*", ""))
    nth = F.row_number().over(Window.partitionBy(key, "section").orderBy("line"))
    return rows.select(key, "section", nth.alias("nth"), stamp.alias("stamp"), severity.alias("severity"), text.alias("text"))


def front_matter(docs: DataFrame, key: str) -> DataFrame:
    """key, fields (JSON of the YAML block between --- lines; null if there is none or it is broken), body."""
    kind = dict(docs.dtypes)[key]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError:
            yaml = None

        def plain(block: str) -> dict:
            out: dict = {}
            last = None
            for line in block.splitlines():
                if line.strip().startswith("- ") and last is not None:
                    out[last] = [*(out[last] if isinstance(out[last], list) else []), line.strip()[2:].strip()]
                elif ":" in line and not line.startswith(" "):
                    last, _, value = line.partition(":")
                    value = value.strip()
                    out[last] = [x.strip() for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else value
            return out

        for f in frames:
            rows = []
            for k, text in zip(f[key], f["text"], strict=True):
                fields, body = None, text or ""
                if body.startswith("---\n") and (end := body.find("\n---", 3)) > 0:
                    block, body = body[4:end], body[end + 4 :].lstrip("\n")
                    try:
                        got = yaml.safe_load(block) if yaml else plain(block)
                        fields = json.dumps(got, default=str) if isinstance(got, dict) else None
                    except Exception:  # a broken block is data, not an error
                        fields = None
                rows.append((k, fields, body))
            yield pd.DataFrame(rows, columns=[key, "fields", "body"])

    return docs.select(key, "text").mapInPandas(parse, f"`{key}` {kind}, fields string, body string")


def coverage(docs: DataFrame, key: str) -> DataFrame:
    """key, file, covered, total of an Istanbul-style report: {file: {s: {statement: hits}}}."""
    files = F.from_json("text", "map<string,struct<s:map<string,int>>>")
    hits = F.map_values("value.s")
    return docs.select(key, F.explode(files).alias("file", "value")).select(key, "file", F.size(F.filter(hits, lambda x: x > 0)).alias("covered"), F.size(hits).alias("total"))


def test_counts(docs: DataFrame, key: str) -> DataFrame:
    """key, passed, failed: from the runners' summary lines, in order of precedence; null if none is found."""

    def number(pattern: str):
        return F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")).cast("int")

    passed = F.coalesce(number(r"Tests:.*?(\d+) passed"), number(r"(\d+) passed"), number(r"(?m)^# pass (\d+)"))
    failed = F.coalesce(number(r"Tests:.*?(\d+) failed"), number(r"(\d+) failed"), number(r"(?m)^# fail (\d+)"))
    return docs.select(key, passed.alias("passed"), F.when(passed.isNotNull(), F.coalesce(failed, F.lit(0))).otherwise(failed).alias("failed"))


def compile_errors(docs: DataFrame, key: str, most: int = 30) -> DataFrame:
    """key, file, row, col, code, message of compiler output lines, the first ``most`` of each text."""
    ts = r"^(.+?)\((\d+),(\d+)\): error (\w+): (.*)$"
    go = r"^(.+?\.go):(\d+):(\d+): ()(.*)$"
    py = r"^(.+?\.py):(\d+)()(): error: (.*)$"
    out = None
    for p in (ts, go, py):
        rows = lines(docs, key).where(F.col("body").rlike(p)).select(key, "line", *[F.regexp_extract("body", p, i + 1).alias(n) for i, n in enumerate(("file", "row", "col", "code", "message"))])
        out = rows if out is None else out.unionByName(rows)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return out.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n", "line")


def state_fields(docs: DataFrame, key: str) -> DataFrame:
    """key, field, value of every bold 'Field:' line."""
    pattern = r"^\s*-?\s*\*\*([^*:]+):\*\*\s*(.*?)\s*$"
    rows = lines(docs, key).withColumn("field", F.regexp_extract("body", pattern, 1)).where("field <> ''")
    return rows.select(key, "field", F.regexp_extract("body", pattern, 2).alias("value"))


def plan_tasks(docs: DataFrame, key: str) -> DataFrame:
    """key, nth, type, name, files, action of every <task> block of a plan."""
    blocks = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(<task\b.*?</task>)"), F.lit(1))).alias("nth", "block"))
    tag = lambda t: F.trim(F.regexp_extract("block", rf"(?s)<{t}>(.*?)</{t}>", 1))
    files = F.filter(F.transform(F.split(tag("files"), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.select(key, (F.col("nth") + 1).alias("nth"), F.regexp_extract("block", r"<task[^>]*\btype=\"([^\"]*)\"", 1).alias("type"), tag("name").alias("name"), files.alias("files"), tag("action").alias("action"))


def test_references(docs: DataFrame, key: str) -> DataFrame:
    """path, first: test files that texts name, with the first text that does."""
    found = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"([\w./-]+(?:\.test|\.spec|_test)\.\w+)"), F.lit(1))).alias("path"))
    return found.groupBy("path").agg(F.min(key).alias("first"))
