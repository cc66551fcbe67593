"""Snapshots, contracts and validation: full outer comparisons, rule tables and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up


def diff(base: DataFrame, now: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys, change (added, removed, modified), changed: columns that differ, nulls compared as values."""
    a = base.select(*keys, F.struct(*compare).alias("_a"), F.lit(True).alias("_in_a"))
    b = now.select(*keys, F.struct(*compare).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, keys, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compare]))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.size(differ) > 0, "modified")
    out = j.withColumn("change", change).where("change is not null")
    return out.select(*keys, "change", F.when(F.col("change") == "modified", F.array_join(differ, ",")).alias("changed"))


def graph_changes(base: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """section, subject, change, changed between two code graphs: files, exported symbols, modules and interfaces (by name and file)."""

    def section(name: str, keys: list[str], compare: list[str], where: str = "true") -> DataFrame:
        a, b = (g[name].where(where).select(*keys, *compare).distinct() for g in (base, now))
        found = diff(a, b, keys, compare) if compare else diff(a.withColumn("_", F.lit(0)), b.withColumn("_", F.lit(0)), keys, ["_"])
        return found.select(F.lit(name).alias("section"), F.concat_ws("::", *keys).alias("subject"), "change", "changed")

    out = section("files", ["path"], ["module", "loc", "complexity_score"])
    out = out.unionByName(section("symbols", ["file", "name"], [], "exported"))
    out = out.unionByName(section("modules", ["name"], ["file_count", "stability"]))
    return out.unionByName(section("interfaces", ["file", "name"], ["contract_hash"]))


def breaking_interfaces(base: DataFrame, now: DataFrame) -> DataFrame:
    """name, file, old_hash, new_hash of interfaces in both whose contract hashes are known and differ."""
    a = base.select("name", "file", F.col("contract_hash").alias("old_hash"))
    b = now.select("name", "file", F.col("contract_hash").alias("new_hash"), "consumer_count")
    return a.join(b, ["name", "file"]).where("old_hash is not null and new_hash is not null and old_hash <> new_hash")


def changed_files(feed: DataFrame) -> DataFrame:
    """path, change of a change feed (status, path, old_path): a rename is a deletion and an addition, a copy an addition."""
    s = F.substring("status", 1, 1)
    both = F.array(F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("change")), F.struct(F.col("path").alias("path"), F.lit("added").alias("change")))
    kind = F.when(s.isin("A", "C"), "added").when(s == "D", "deleted").otherwise("modified")
    one = F.array(F.struct(F.col("path").alias("path"), kind.alias("change")))
    return feed.select(F.explode(F.when(s == "R", both).otherwise(one)).alias("c")).select("c.path", "c.change")


def fields_of(schema: Column) -> Column:
    """Names before a comma or a colon in a contract's schema text."""
    return F.array_distinct(F.regexp_extract_all(schema, F.lit(r"(\w+)\s*[,:]"), F.lit(1)))


def contract_breaks(base: DataFrame, now: DataFrame) -> DataFrame:
    """provider, consumer, endpoint, kind, severity, detail of what the new registry breaks."""
    keys = ["provider", "consumer", "endpoint"]
    old = base.select(*keys, F.col("response").alias("r0"), F.col("status_codes").alias("s0"))
    new = now.select(*keys, F.col("response").alias("r1"), F.col("status_codes").alias("s1"), F.lit(True).alias("there"))
    j = old.join(new, keys, "left")
    lost = F.array_except(fields_of(F.coalesce("r0", F.lit(""))), fields_of(F.coalesce("r1", F.lit(""))))
    found = F.array_compact(
        F.array(
            F.when(F.col("there").isNull(), F.struct(F.lit("endpoint_removed").alias("kind"), F.lit("blocker").alias("severity"), F.lit("").alias("detail"))),
            F.when(F.col("there") & (F.size(lost) > 0), F.struct(F.lit("response_changed").alias("kind"), F.lit("blocker").alias("severity"), F.array_join(lost, ",").alias("detail"))),
            F.when(F.col("there") & ~F.col("s0").eqNullSafe(F.col("s1")), F.struct(F.lit("status_codes_changed").alias("kind"), F.lit("warning").alias("severity"), F.coalesce("s1", F.lit("")).alias("detail"))),
        )
    )
    return j.select(*keys, F.explode(found).alias("f")).select(*keys, "f.kind", "f.severity", "f.detail")


def declared_vs_detected(declared: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finding: phantom (declared, not found) or undeclared (found, not declared)."""
    a, b = declared.select(*keys).distinct().withColumn("_a", F.lit(1)), detected.select(*keys).distinct().withColumn("_b", F.lit(1))
    out = a.join(b, keys, "full").where("_a is null or _b is null")
    return out.select(*keys, F.when(F.col("_b").isNull(), "phantom").otherwise("undeclared").alias("finding"))


def entropy(files: DataFrame, deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per module: ca, ce, instability, abstractness, distance, cohesion (four places), loc and complexity."""
    s, t = (files.select(F.col("path").alias(p), F.col("module").alias(m)) for p, m in (("source_file", "a"), ("target_file", "b")))
    edges = deps.select("source_file", "target_file").distinct().join(s, "source_file").join(t, "target_file")
    cross = F.col("a") != F.col("b")
    out = edges.groupBy(F.col("a").alias("module")).agg(F.countDistinct(F.when(cross, F.col("target_file"))).alias("ce"), F.count_if(cross).alias("out_edges"), F.count_if(~cross).alias("inner_edges"))
    ca = edges.where(cross).groupBy(F.col("b").alias("module")).agg(F.countDistinct("source_file").alias("ca"))
    kinds = symbols.where("exported").join(files.select(F.col("path").alias("file"), "module"), "file").groupBy("module").agg(F.count("*").alias("exports"), F.count_if(F.col("kind").isin("interface", "type")).alias("abstract"))
    m = files.groupBy("module").agg(F.sum("loc").alias("loc")).join(out, "module", "left").join(ca, "module", "left").join(kinds, "module", "left").fillna(0)
    safe = lambda n, d, other: F.when(d == 0, F.lit(other)).otherwise(n / d)
    i = safe(F.col("ce"), F.col("ca") + F.col("ce"), 0.0)
    a = safe(F.col("abstract"), F.col("exports"), 0.0)
    c = safe(F.col("inner_edges"), F.col("inner_edges") + F.col("out_edges"), 1.0)
    return m.select("module", "ca", "ce", F.round(i, 4).alias("instability"), F.round(a, 4).alias("abstractness"), F.round(F.abs(a + i - 1), 4).alias("distance"), F.round(c, 4).alias("cohesion"), "loc")


def health_band(distance: Column) -> Column:
    return F.when(distance < 0.3, "green").when(distance < 0.5, "yellow").otherwise("red")


def entropy_total(modules: DataFrame) -> DataFrame:
    out = modules.agg(F.count("*").alias("modules"), F.avg("distance").alias("avg_distance"), F.avg("instability").alias("avg_instability"), F.avg("cohesion").alias("avg_cohesion"))
    return out.withColumn("health", health_band(F.col("avg_distance")))


def compare_entropy(base: DataFrame, now: DataFrame) -> DataFrame:
    """module, deltas and status: new, degraded (two deltas above 0.05), mixed (one) or improved."""
    old = base.select("module", *[F.col(c).alias(f"{c}_0") for c in ("distance", "instability", "cohesion")], F.lit(True).alias("there"))
    j = now.join(old, "module", "left")
    deltas = {c: F.round(F.col(c) - F.col(f"{c}_0"), 4) for c in ("distance", "instability", "cohesion")}
    worse = sum((F.when(d > 0.05, 1).otherwise(0) for d in deltas.values()), F.lit(0))
    status = F.when(F.col("there").isNull(), "new").when(worse >= 2, "degraded").when(worse == 1, "mixed").otherwise("improved")
    return j.select("module", *[d.alias(f"{c}_delta") for c, d in deltas.items()], status.alias("status"))


def verdict(old: Column, new: Column) -> Column:
    """block above 25 %, warn above 10 % of growth."""
    grown = F.when(old > 0, (new - old) / old).otherwise(F.lit(0.0))
    return F.when(grown > 0.25 + 1e-9, "block").when(grown > 0.10 + 1e-9, "warn").otherwise("ok")


def requirement_drift(reqs: DataFrame, covers: DataFrame, checks: DataFrame) -> DataFrame:
    """id, drift, level: 1 - weight of verified must-haves of the covering plans; 1 without a plan, 0 without must-haves.

    ``covers``: id, plan. ``checks``: plan, verdict.
    """
    weight = F.when(F.col("verdict").isin("VERIFIED", "WIRED"), 1.0).when(F.col("verdict").isin("UNCERTAIN", "ORPHANED", "PARTIAL"), 0.5).otherwise(0.0)
    per = covers.join(checks, "plan", "left").groupBy("id").agg(F.count("verdict").alias("n"), F.sum(F.when(F.col("verdict").isNotNull(), weight)).alias("w"))
    j = reqs.select("id").join(per.withColumn("planned", F.lit(True)), "id", "left")
    raw = F.when(F.col("planned").isNull(), 1.0).when(F.col("n") == 0, 0.0).otherwise(1 - F.col("w") / F.col("n"))
    drift = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return j.select("id", drift.alias("drift"), drift_level(drift).alias("level"))


def drift_level(drift: Column) -> Column:
    return F.when(drift <= 0.10, "GREEN").when(drift <= 0.25, "YELLOW").otherwise("RED")


def consumer_risk(consumers: Column) -> Column:
    return F.when(consumers > 15, "CRITICAL").when(consumers > 10, "HIGH").when(consumers > 5, "MEDIUM").otherwise("LOW")


#: Words that make a requirement hard to test.
WEASEL = ("fast", "easy", "simple", "user-friendly", "robust", "efficient", "appropriate", "etc", "adequate", "flexible")


def lint_requirements(reqs: DataFrame, traced: DataFrame | None = None) -> DataFrame:
    """id, rule, severity: weasel words, two or more 'and', under 20 characters, no number, repeated ids, not traced."""
    t = F.lower("text")
    rules = [
        ("weasel_words", "warning", t.rlike(r"\b(" + "|".join(WEASEL) + r")\b")), ("compound", "warning", F.regexp_count(t, F.lit(r"\band\b")) >= 2),
        ("too_short", "warning", F.length("text") < 20), ("not_measurable", "info", ~t.rlike("[0-9]")),
    ]
    found = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, level, on in rules]))
    out = reqs.select("id", F.explode(found).alias("r")).select("id", "r.rule", "r.severity")
    twice = reqs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("rule"), F.lit("error").alias("severity"))
    out = out.unionByName(twice)
    if traced is not None:
        out = out.unionByName(reqs.join(traced, "id", "left_anti").select("id", F.lit("not_traced").alias("rule"), F.lit("warning").alias("severity")).distinct())
    return out


def gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """by, after, before: holes in a numbering."""
    w = Window.partitionBy(*by).orderBy(number)
    seen = df.select(*by, number).distinct().withColumn("after", F.lag(number).over(w))
    return seen.where(F.col(number) > F.col("after") + 1).select(*by, "after", F.col(number).alias("before"))


def rolling_counts(events: DataFrame, by: str, ts: str, days: tuple[int, ...] = (7, 30, 90), anchor: Column | None = None) -> DataFrame:
    """by, changes_<n>d: events within n days of the anchor (the newest event unless given)."""
    newest = events.agg(F.max(ts).alias("_anchor"))
    j = events.join(F.broadcast(newest)) if anchor is None else events.withColumn("_anchor", anchor)
    return j.groupBy(by).agg(*[F.count_if(F.col(ts) >= F.col("_anchor") - F.expr(f"interval {d} days")).alias(f"changes_{d}d") for d in days])


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """by, session, events, started, ended: batches that a quiet time of ``gap_seconds`` ends (debounce)."""
    w = Window.partitionBy(by).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    opens = (micros - F.lag(micros).over(w)) > gap_seconds * 1_000_000
    marked = events.withColumn("session", F.sum(F.coalesce(opens, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def regression(base: DataFrame, now: DataFrame) -> DataFrame:
    """suite, kind of suites that failed anew, lost passing tests or went; with the share of the baseline."""
    a = base.select("suite", F.col("passed").alias("p0"), F.col("failed").alias("f0"))
    b = now.select("suite", F.col("passed").alias("p1"), F.col("failed").alias("f1"), F.lit(True).alias("there"))
    j = a.join(b, "suite", "left")
    kind = F.when(F.col("there").isNull(), "missing").when((F.col("f0") == 0) & (F.col("f1") > 0), "newly_failing").when(F.col("p1") < F.col("p0"), "fewer_passing")
    out = j.withColumn("kind", kind)
    return out.where("kind is not null").select("suite", "kind", (F.coalesce("p0", F.lit(0)) - F.coalesce("p1", F.lit(0))).alias("lost"))


def mutation_score(results: DataFrame, by: str) -> DataFrame:
    killed, lived = F.count_if(F.col("status") == "killed"), F.count_if(F.col("status") == "survived")
    return results.groupBy(by).agg(killed.alias("killed"), lived.alias("survived")).withColumn("score", F.when(F.col("killed") + F.col("survived") == 0, 1.0).otherwise(half_up(F.col("killed") / (F.col("killed") + F.col("survived")), 4)))


def drift_total(drift: DataFrame) -> DataFrame:
    """mean (of requirements with must-haves), green, yellow, red."""
    return drift.agg(F.avg("drift").alias("mean"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("GREEN", "YELLOW", "RED")])


def verdicts_in(docs: DataFrame, key: str) -> DataFrame:
    """key, verdict: every verification verdict in a text."""
    found = F.regexp_extract_all("text", F.lit(r"\b(VERIFIED|WIRED|UNCERTAIN|ORPHANED|PARTIAL|FAILED|MISSING)\b"), F.lit(1))
    return docs.select(key, F.explode(found).alias("verdict"))


def requirement_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change, changed: added, removed or modified requirements."""
    return diff(old, new, ["id"], ["text", "category"])


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """type, name, finding: interfaces that went, and whose protocol changed; routes (array) that went."""
    a = old.select("type", "name", F.col("protocol").alias("p0"), F.col("routes").alias("r0"))
    b = new.select("type", "name", F.col("protocol").alias("p1"), F.col("routes").alias("r1"), F.lit(True).alias("there"))
    none = F.array().cast("array<string>")
    lost = F.array_except(F.coalesce("r0", none), F.coalesce("r1", none))
    found = F.concat(
        F.array_compact(F.array(F.when(F.col("there").isNull(), "removed_interface"), F.when(F.col("there") & ~F.col("p0").eqNullSafe(F.col("p1")), "protocol_change"))),
        F.when(F.col("there"), F.transform(lost, lambda r: F.concat(F.lit("removed_endpoint:"), r))).otherwise(none),
    )
    return a.join(b, ["type", "name"], "left").select("type", "name", F.explode(found).alias("finding"))


def snapshot(files: DataFrame, interfaces: DataFrame, capabilities: DataFrame) -> dict[str, DataFrame]:
    """What a snapshot keeps: the 200 most used interfaces, the 100 most complex files, capabilities, languages."""
    return {
        "interfaces": interfaces.orderBy(F.desc("consumer_count"), "name", "file").limit(200),
        "hotspots": files.orderBy(F.desc("complexity_score"), "path").limit(100),
        "capabilities": capabilities,
        "languages": files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")),
    }


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Differences of two snapshots, per section."""
    return {
        "interfaces": diff(old["interfaces"], new["interfaces"], ["name", "file"], ["contract_hash", "consumer_count"]),
        "capabilities": diff(old["capabilities"], new["capabilities"], ["module_name", "capability"], ["confidence"]),
        "languages": diff(old["languages"], new["languages"], ["language"], ["files", "loc"]),
    }
