"""Plans, phases and requirements as relations: progress, waves, traceability, requirement analysis, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def phase_number(name: Column) -> Column:
    """The leading number of a phase name, decimals included."""
    return F.regexp_extract(name, r"^(\d+(?:\.\d+)?)", 1).cast("double")


def normal_phase(number: Column) -> Column:
    """The integer part padded to two digits, the rest kept."""
    whole = F.regexp_extract(number, r"^(\d+)", 1)
    return F.concat(F.lpad(whole, 2, "0"), F.regexp_replace(number, r"^\d+", ""))


def next_decimal(phases: DataFrame, base: str, number: str) -> DataFrame:
    """base, next: one above the largest suffix used under each base."""
    return phases.groupBy(base).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def progress(plans: DataFrame, by: str) -> DataFrame:
    """by, plans, done, status (pending, in_progress, complete), percent; ``plans`` has has_summary."""
    out = plans.groupBy(by).agg(F.count("*").alias("plans"), F.count_if("has_summary").alias("done"))
    status = F.when(F.col("done") == 0, "pending").when(F.col("done") < F.col("plans"), "in_progress").otherwise("complete")
    return out.withColumn("status", status).withColumn("percent", F.floor(F.col("done") * 100 / F.col("plans") + 0.5).cast("long"))


def waves(plans: DataFrame, by: str = "wave") -> DataFrame:
    """wave, plans, incomplete (ids), has_checkpoint (a plan is not autonomous)."""
    waiting = F.array_sort(F.collect_list(F.when(~F.col("has_summary"), F.col("id"))))
    return plans.groupBy(by).agg(F.count("*").alias("plans"), waiting.alias("incomplete"), F.bool_or(~F.col("autonomous")).alias("has_checkpoint"))


def digest(summaries: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Distinct members of the array columns per phase, sorted."""
    return summaries.groupBy(by).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in columns])


def completeness(plans: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """key, finding, severity: plans without a summary (error), summaries without a plan (warning)."""
    a = plans.join(summaries, key, "left_anti").select(key, F.lit("no_summary").alias("finding"), F.lit("error").alias("severity"))
    return a.unionByName(summaries.join(plans, key, "left_anti").select(key, F.lit("no_plan").alias("finding"), F.lit("warning").alias("severity")))


def traceability(links: DataFrame) -> DataFrame:
    """requirement, plans, files: distinct things that ``links`` (requirement, plan, file) tie to it."""
    return links.groupBy("requirement").agg(F.countDistinct("plan").alias("plans"), F.countDistinct("file").alias("files"))


def requirement_impact(links: DataFrame, changed: DataFrame) -> DataFrame:
    """affected_plans, plan_refs, score: share of plan references that the changed requirements touch."""
    refs = links.select("requirement", "plan").distinct()
    hit = refs.join(changed.select("requirement").distinct(), "requirement", "left_semi").agg(F.countDistinct("plan").alias("affected_plans"))
    return refs.agg(F.count("*").alias("plan_refs")).join(hit).withColumn("score", F.when(F.col("plan_refs") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("affected_plans") / F.col("plan_refs"))))


def keyword_hits(keywords: DataFrame, interfaces: DataFrame) -> DataFrame:
    """word, id, service_id: interfaces whose words hold a keyword; an equi-join on the words of the names."""
    words = interfaces.select("id", "service_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""))).alias("word"))
    return keywords.select("word").distinct().join(words, "word")


def analyse_scope(hits: DataFrame, edges: DataFrame, current: str) -> DataFrame:
    """service, interfaces, role, fan_in, risk, wave of the services that a requirement touches, current first."""
    direct = hits.groupBy(F.col("service_id").alias("service")).agg(F.countDistinct("id").alias("interfaces"))
    fan = edges.groupBy(F.col("dst").alias("service")).agg(F.countDistinct("src").alias("fan_in"))
    users = edges.join(direct.select(F.col("service").alias("dst")), "dst", "left_semi").select(F.col("src").alias("service")).distinct()
    every = direct.join(users.withColumn("uses", F.lit(True)), "service", "full").join(fan, "service", "left").fillna(0, ["interfaces", "fan_in"])
    role = F.when((F.col("interfaces") > 0) & F.col("uses").isNotNull(), "mixed").when(F.col("interfaces") > 0, "provider").otherwise("consumer")
    risk = F.when(F.col("fan_in") >= 5, "critical").when(F.col("fan_in") >= 3, "high").when(F.col("fan_in") >= 1, "medium").otherwise("low")
    out = every.select("service", "interfaces", role.alias("role"), "fan_in", risk.alias("risk")).withColumn("wave", F.when(F.col("role") == "consumer", 2).otherwise(1))
    return out.orderBy(F.desc(F.col("service") == current), "wave", F.desc("fan_in"), "service")


def assess_plans(files: DataFrame, by: str, window: int = 200_000, share: float = 0.7) -> DataFrame:
    """by, tokens, overflow, needs_split, parts, strategy: whether the files of a plan fit a context window.

    The strategy is by module if more than one is touched, else by concern, else by file.
    """
    room = int(window * share)
    g = files.groupBy(by).agg(F.sum(token_estimate(F.col("text"))).cast("long").alias("tokens"), F.countDistinct("module").alias("m"), F.countDistinct("concern").alias("c"))
    split = F.col("tokens") > room
    strategy = F.when(~split, "none").when(F.col("m") > 1, "module").when(F.col("c") > 1, "concern").otherwise("file")
    return g.select(by, "tokens", F.round(F.col("tokens") / room, 4).alias("overflow"), split.alias("needs_split"), F.ceil(F.col("tokens") / room).cast("long").alias("parts"), strategy.alias("strategy"))


def concern(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"schema|prisma|\.sql$"), "schema").when(p.rlike(r"test|spec"), "test").when(p.rlike(r"config|\.ya?ml$|\.json$"), "config").when(p.rlike("migration"), "migration").otherwise("implementation")


#: The order in which the groups of a plan split by concern are worked off.
CONCERNS = ("schema", "migration", "implementation", "test", "config")


def file_groups(files: DataFrame, strategy: str) -> DataFrame:
    """strategy, label, tokens, files, place of the groups that a plan (path, module, tokens) is split into, by module, concern or file.

    Concerns have their place in the fixed order of work; other groups have none.
    """
    label = {"module": F.col("module"), "concern": concern(F.col("path")), "file": F.element_at(F.split("path", "/"), -1)}[strategy]
    place = F.array_position(F.array(*[F.lit(c) for c in CONCERNS]), F.col("label")) - 1 if strategy == "concern" else F.lit(None)
    by = [label.alias("label"), *(["path"] if strategy == "file" else [])]
    out = files.groupBy(*by).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("files"))
    return out.select(F.lit(strategy).alias("strategy"), "label", "tokens", "files", place.cast("long").alias("place"))


def fill_budget(items: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Items kept while they fit, in order, a too large one being passed over: order-dependent, so one sorted pass per group.

    A group is one plan's items, a bounded list by nature.
    """
    import pandas as pd

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        f = f.sort_values(order)
        for n in f[size]:
            kept.append(n <= left)
            left -= n if n <= left else 0
        return f[kept]

    return items.groupBy(by).applyInPandas(fill, items.schema)


def select_agents(signals: DataFrame, catalogue: DataFrame, most: int = 3) -> DataFrame:
    """task, agent, score: weighted matches (task, kind, value) against the catalogue (agent, kind, value, weight, priority)."""
    scored = signals.distinct().join(catalogue, ["kind", "value"]).groupBy("task", "agent").agg(F.sum("weight").alias("points"), F.max("priority").alias("priority"))
    scored = scored.select("task", "agent", (F.col("points") + F.col("priority")).alias("score"))
    w = Window.partitionBy("task")
    top = scored.withColumn("best", F.max("score").over(w)).where(F.col("score") >= 0.5 * F.col("best"))
    return top.withColumn("nth", F.row_number().over(w.orderBy(F.desc("score"), "agent"))).where(F.col("nth") <= most).select("task", "agent", "score")


def template_size(text: Column) -> Column:
    """minimal, standard or complex by tasks, distinct files and decisions mentioned."""
    tasks = F.regexp_count(text, F.lit(r"(?m)^###?\s*Task"))
    files = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([^`\s]+\.[a-z]+)`"), F.lit(1))))
    decided = F.lower(text).contains("decision")
    return F.when((tasks <= 2) & (files <= 3) & ~decided, "minimal").when(decided | (files > 6) | (tasks > 5), "complex").otherwise("standard")


def todos(docs: DataFrame, key: str, area: str | None = None) -> DataFrame:
    """key, title, area, created of todo texts, with defaults; of one area, if given."""
    get = lambda p, d: F.coalesce(F.nullif(F.regexp_extract("text", rf"(?m)^{p}:\s*(.+?)\s*$", 1), F.lit("")), F.lit(d))
    out = docs.select(key, get("title", "Untitled").alias("title"), get("area", "general").alias("area"), get("created", "unknown").alias("created"))
    return out if area is None else out.where(F.col("area") == area)


def list_phases(phases: DataFrame, prefix: str | None = None, archived: DataFrame | None = None) -> DataFrame:
    """Phases (name) in numeric order, archived ones too if given; those that begin with a phase number, if given."""
    out = phases if archived is None else phases.unionByName(archived)
    if prefix is not None:
        out = out.where(normal_phase(F.regexp_extract("name", r"^(\d+(?:\.\d+)?)", 1)) == normal_phase(F.lit(prefix)))
    return out.orderBy(phase_number(F.col("name")), "name")


def roadmap(phases: DataFrame, plans: DataFrame) -> DataFrame:
    """phase, status, percent of the phases of a roadmap, with those that have no plans as empty."""
    done = progress(plans, "phase")
    return phases.select("phase").join(done, "phase", "left").select("phase", F.coalesce("plans", F.lit(0).cast("long")).alias("plans"), F.coalesce("status", F.lit("empty")).alias("status"), F.coalesce("percent", F.lit(0).cast("long")).alias("percent"))


def roadmap_vs_disk(listed: DataFrame, found: DataFrame) -> DataFrame:
    """phase, finding of normalised phase numbers on one side only."""
    a, b = (d.select(normal_phase(F.col("phase")).alias("phase")).distinct() for d in (listed, found))
    return a.join(b, "phase", "left_anti").withColumn("finding", F.lit("not_on_disk")).unionByName(b.join(a, "phase", "left_anti").withColumn("finding", F.lit("not_in_roadmap")))


def consistency(roadmap: DataFrame, files: DataFrame) -> DataFrame:
    """check, subject of all that is inconsistent between a roadmap (text) and the planning files (path: phase folder/file, wave).

    Phases on one side only, gaps in the numbering of phases and of a phase's plans, summaries without a plan, plans
    without a wave. Numbers are compared without leading zeros; phases with decimals leave no gaps.
    """
    bare = lambda c: F.regexp_replace(c, r"^0+(?=\d)", "")
    listed = roadmap.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?i)#{2,4}\s*Phase\s+(\d+(?:\.\d+)?)\s*:"), F.lit(1))).alias("n")).select(bare(F.col("n")).alias("phase")).distinct()
    at = files.select(F.substring_index("path", "/", 1).alias("folder"), F.substring_index("path", "/", -1).alias("file"), "wave")
    at = at.withColumn("phase", bare(F.regexp_extract("folder", r"^(\d+(?:\.\d+)?)", 1))).where("phase <> ''")
    disk = at.select("phase").distinct()
    plan, summary = F.regexp_extract("file", r"^(.*)-PLAN\.md$", 1), F.regexp_extract("file", r"^(.*)-SUMMARY\.md$", 1)
    plans = at.withColumn("id", plan).where("id <> ''")
    say = lambda check, *parts: (F.lit(check).alias("check"), F.concat(*parts).alias("subject"))
    whole = disk.where(~F.col("phase").contains(".")).select(F.col("phase").cast("int").alias("n"))
    gap = lambda df, by: df.withColumn("last", F.lag("n").over(Window.partitionBy(*by).orderBy("n"))).where("n > last + 1")
    numbered = plans.select("folder", F.regexp_extract("file", r"-(\d{2})-PLAN\.md$", 1).cast("int").alias("n")).where("n is not null").distinct()
    parts = [
        listed.join(disk, "phase", "left_anti").select(*say("not_on_disk", F.col("phase"))),
        disk.join(listed, "phase", "left_anti").select(*say("not_in_roadmap", F.col("phase"))),
        gap(whole, []).select(*say("phase_gap", F.col("last").cast("string"), F.lit(" -> "), F.col("n").cast("string"))),
        gap(numbered, ["folder"]).select(*say("plan_gap", F.col("folder"), F.lit(": "), F.col("last").cast("string"), F.lit(" -> "), F.col("n").cast("string"))),
        at.withColumn("id", summary).where("id <> ''").join(plans.select("folder", "id"), ["folder", "id"], "left_anti").select(*say("no_plan", F.col("folder"), F.lit("/"), F.col("file"))),
        plans.where("wave is null or wave = ''").select(*say("no_wave", F.col("folder"), F.lit("/"), F.col("file"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def references(docs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """key, path, found: paths that a text names after @ or in backticks."""
    at = F.regexp_extract_all("text", F.lit(r"(?:^|\s)@([\w./-]+\.\w+)"), F.lit(1))
    ticks = F.regexp_extract_all("text", F.lit(r"`([\w./-]+/[\w.-]+\.\w+)`"), F.lit(1))
    named = docs.select(key, F.explode(F.array_distinct(F.concat(at, ticks))).alias("path"))
    return named.join(existing.select("path").distinct().withColumn("found", F.lit(True)), "path", "left").select(key, "path", F.coalesce("found", F.lit(False)).alias("found"))


def plan_signals(plans: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """key, value: dictionary words (value) of a plan's text, as whole words; an equi-join on the words."""
    words = plans.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9.+#-]+"))).alias("value"))
    return words.join(dictionary.select(F.lower("value").alias("value")).distinct(), "value").select(key, "value")


def prune_sections(text: Column, signals: list[str]) -> Column:
    """A body without the ### sections whose title and first 300 characters name no signal; the opening stays."""
    parts = F.split(text, r"(?m)^(?=### )")
    said = lambda p: F.exists(F.array(*[F.lit(s.lower()) for s in signals]), lambda s: F.lower(F.substring(p, 1, 300)).contains(s)) if signals else F.lit(False)
    return F.array_join(F.filter(parts, lambda p: ~p.startswith("### ") | said(p)), "")
