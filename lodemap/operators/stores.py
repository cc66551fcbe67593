"""Append stores: decisions, knowledge, ledger and metrics, as operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_set
from ..sources import markdown
from ..sources.tables import insert_ignore, newest, staged

SEVERITY = ("low", "medium", "high", "critical")


def add_decisions(store: DataFrame, new: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows of ``new`` (id, type, text, ...) that no active decision of their type says already, by word-set Jaccard.

    Equal word sets are compared once. Words are ranked by rarity over both sides: two sets that meet the bound share a
    word among the rarest n - ceil(least * n) + 1 of either, at places that leave words enough to meet it, so only those
    are joined. Within ``new``, of rows of equal type and words the smallest id is kept.
    """
    w = lambda df: df.withColumn("_w", F.array_sort(word_set(F.col("text"))))
    first = Window.partitionBy("type", "_w").orderBy("id")
    fresh = w(new).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    held = w(store.where("active")).select("type", F.col("_w").alias("_h")).distinct()
    sides = held.select("type", F.col("_h").alias("_w"), F.lit(False).alias("_new")).unionByName(fresh.select("type", "_w", F.lit(True).alias("_new")))
    sides = staged(sides.withColumn("_i", F.monotonically_increasing_id()), "decision-sets")
    flat = sides.select("_i", "type", "_new", F.size("_w").alias("_l"), F.explode("_w").alias("word"))
    common = flat.groupBy("type", "word").agg(F.count("*").alias("_df"))
    place = F.row_number().over(Window.partitionBy("_i").orderBy("_df", "word"))
    ranked = flat.join(common.hint("merge"), ["type", "word"]).withColumn("_p", place)
    most = F.col("_l") - F.ceil(F.col("_l") * F.lit(least) - 1e-9) + 1
    prefix = staged(ranked.where(F.col("_p") <= most).select("_i", "type", "_new", "_l", "word", "_p"), "decision-words")
    a = prefix.where("_new").select("type", "word", F.col("_i").alias("_a"), F.col("_l").alias("_la"), F.col("_p").alias("_pa"))
    b = prefix.where("not _new").select("type", "word", F.col("_i").alias("_b"), F.col("_l").alias("_lb"), F.col("_p").alias("_pb"))
    # at their first word in common, two sets share no more than what is left of the shorter rest; the bound asks for least / (1 + least) of both sizes
    left = F.least(F.col("_la") - F.col("_pa"), F.col("_lb") - F.col("_pb")) + 1
    enough = left >= (F.col("_la") + F.col("_lb")) * F.lit(least / (1 + least)) - 1e-9
    pairs = a.hint("merge").join(b, ["type", "word"]).where(enough).select("_a", "_b").distinct()
    left_sets, right_sets = sides.where("_new").select(F.col("_i").alias("_a"), "type", "_w"), sides.where("not _new").select(F.col("_i").alias("_b"), F.col("_w").alias("_h"))
    met = pairs.join(left_sets.hint("merge"), "_a").join(right_sets.hint("merge"), "_b").where(jaccard(F.col("_w"), F.col("_h"), 1.0) >= least)
    empty = held.where(F.size("_h") == 0).select("type", F.col("_h").alias("_w"))  # no words at all are equal to none
    said = met.select("type", "_w").unionByName(empty).distinct()
    # a null type is no other row's type
    return fresh.join(said, ["type", "_w"], "left_anti").select(*new.columns)


def supersede(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Old rows that ``changes`` (old_id, new_id) name become inactive and point to their successor."""
    j = store.join(changes.select(F.col("old_id").alias("id"), "new_id"), "id", "left")
    kept = [c for c in store.columns if c not in ("active", "superseded_by")]
    return j.select(*kept, F.when(F.col("new_id").isNotNull(), False).otherwise(F.col("active")).alias("active"), F.coalesce("new_id", F.col("superseded_by") if "superseded_by" in store.columns else F.lit(None)).alias("superseded_by"))


def query_decisions(store: DataFrame, tags: DataFrame | None = None, tag: str | None = None, **equal: object) -> DataFrame:
    """Conjunctive filter with the tags attached, newest first."""
    out = store
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    if tags is not None:
        if tag is not None:
            out = out.join(tags.where(F.col("tag") == tag).select(F.col("decision_id").alias("id")).distinct(), "id", "left_semi")
        listed = tags.groupBy(F.col("decision_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        out = out.join(listed, "id", "left")
    return out


def relevant_knowledge(store: DataFrame, modules: list[str], names: list[str]) -> DataFrame:
    """High relevance, or a module in common, or a file name of three letters in the text, or no modules at all."""
    named = F.lit(False)
    for n in names:
        if len(n) >= 3:
            named = named | F.col("text").contains(n)
    mine = F.arrays_overlap("modules", F.array(*[F.lit(m) for m in modules])) if modules else F.lit(False)
    return store.where((F.col("relevance") == "high") | mine | named | (F.size("modules") == 0))


def add_knowledge(store: DataFrame, new: DataFrame, cap: int = 200) -> DataFrame:
    """Add rows of new ids, then keep the newest ``cap``."""
    return newest(insert_ignore(store, new, ["id"], "created"), ["created", "id"], cap)


def compact_ledger(events: DataFrame, by: str, most: int = 10) -> DataFrame:
    """Per ledger, the first ``most`` completed lines and one marker line that counts the rest."""
    w = Window.partitionBy(by).orderBy("nth")
    ranked = events.withColumn("_n", F.row_number().over(w))
    marker = ranked.where(F.col("_n") > most).groupBy(by).agg(F.count("*").alias("n"))
    marker = marker.select(by, F.lit(most + 1).alias("nth"), F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" earlier lines compacted")).alias("text"))
    return ranked.where(F.col("_n") <= most).select(by, F.col("_n").alias("nth"), "text").unionByName(marker)


def promote(lines: DataFrame, least: str = "medium") -> DataFrame:
    """Ledger lines whose severity reaches ``least`` (unknown severities count as low)."""
    rank = F.create_map(*[x for i, s in enumerate(SEVERITY) for x in (F.lit(s), F.lit(i))])
    return lines.where(F.coalesce(rank[F.col("severity")], F.lit(0)) >= SEVERITY.index(least))


def ledger_decisions(docs: DataFrame, key: str) -> DataFrame:
    """key, nth, type, text, rationale of the decisions (stamped entries) and preferences (list items) in ledger texts.

    An entry begins with a bracket or a dash and goes on to the next one; nth counts the entries of a text.
    """
    body, before = F.col("body"), Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.regexp_extract(body, r"^##\s+(.+?)\s*$", 1), F.lit(""))
    marked = markdown.lines(docs, key).select(key, "line", "body", F.last(heading, True).over(before).alias("section"), F.count_if(body.rlike(r"^\s*[-\[]")).over(before).alias("nth"))
    said = F.nullif(F.regexp_extract(body, r"Rationale:\s*(.+)", 1), F.lit(""))
    entries = marked.groupBy(key, "section", "nth").agg(F.min_by("body", "line").alias("head"), F.min_by(said, F.when(said.isNotNull(), F.col("line"))).alias("rationale"))
    stamped = F.regexp_extract("head", r"^\s*\[\d{4}-\d{2}-\d{2}[ T][\d:]+\]\s*(.*)$", 1)
    item = F.regexp_extract("head", r"^\s*-\s*(.*)$", 1)
    kind = F.when(F.col("section") == "Decisions", "decision").when(F.col("section") == "User Preferences", "preference")
    text = F.trim(F.when(F.col("section") == "Decisions", stamped).otherwise(item))
    rationale = F.when(F.col("section") == "Decisions", F.trim(F.coalesce("rationale", F.lit("")))).otherwise("")
    return entries.select(key, "nth", kind.alias("type"), text.alias("text"), rationale.alias("rationale")).where("type is not null and text <> ''")


def promote_from_ledger(store: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """id, type, text, rationale of what ledger texts hold and no active decision of ``store`` says already; ids are key, type and place."""
    new = ledger_decisions(docs, key).withColumn("id", F.concat_ws(":", F.col(key).cast("string"), "type", F.col("nth").cast("string")))
    return add_decisions(store, new.select("id", "type", "text", "rationale"))


def cost_rollup(units: DataFrame) -> DataFrame:
    """dimension (total, phase, model), value, cost, tokens, units, by grouping sets in one pass."""
    sql = "SELECT phase, model, grouping(phase) AS gp, grouping(model) AS gm, sum(cost_usd) AS cost, sum(tokens) AS tokens, count(*) AS units FROM {u} GROUP BY GROUPING SETS ((), (phase), (model))"
    out = units.sparkSession.sql(sql, u=units)
    dim = F.when(F.col("gp") == 0, "phase").when(F.col("gm") == 0, "model").otherwise("total")
    return out.select(dim.alias("dimension"), F.coalesce("phase", "model").alias("value"), "cost", "tokens", "units")


def check_budget(units: DataFrame, budget: float, more: int = 5) -> DataFrame:
    out = units.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"), F.count("*").alias("n"), F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("mean"))
    return out.select("spent", (F.lit(budget) - F.col("spent")).alias("remaining"), (F.col("spent") <= budget).alias("within_budget"), (F.col("mean") * (F.col("n") + more)).alias("projected"))


def decisions_for(store: DataFrame, tags: DataFrame, phase: str, modules: list[str], names: list[str]) -> DataFrame:
    """Active decisions that are global, of a module at hand (ignoring case), or tagged with a module, a file name or the phase."""
    low = [m.lower() for m in modules]
    wanted = [*low, *[n.lower() for n in names]]
    t = tags.groupBy(F.col("decision_id").alias("id")).agg(F.collect_set(F.lower("tag")).alias("_tags"))
    j = store.where("active").join(t, "id", "left").withColumn("_tags", F.coalesce("_tags", F.array().cast("array<string>")))
    tagged = F.arrays_overlap("_tags", F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)
    mine = F.lower("module").isin(low) if low else F.lit(False)
    return j.where((F.col("scope") == "global") | mine | tagged | ((F.col("scope") == "phase") & F.array_contains("_tags", phase.lower()))).drop("_tags")


def session_context(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Ledger lines for a session: decisions and preferences whole, others if generic or if they name a term."""
    named = F.lit(False)
    for t in terms:
        named = named | F.lower("text").contains(t.lower())
    return lines.where(F.col("section").isin("Decisions", "User Preferences") | named | (F.coalesce("severity", F.lit("low")) == "critical"))


def ledger_counts(lines: DataFrame, by: str) -> DataFrame:
    """by, section, n, tokens: lines and their token estimate per section."""
    return lines.groupBy(by, "section").agg(F.count("*").alias("n"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))


def recent(log: DataFrame, order: str, most: int = 20) -> DataFrame:
    return newest(log, [order], most)


def append(store: DataFrame, new: DataFrame, key: str, order: list[str], **defaults: object) -> DataFrame:
    """``store`` and the rows of ``new``, numbered on from its largest ``key`` by ``order``; columns that ``new`` lacks, and nulls, take their default.

    Warnings, learnings and metric units are added so. New rows come in batches, which one task can number.
    """
    last = store.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    nth = F.row_number().over(Window.orderBy(*order))
    rows = new.withColumn("_nth", nth).join(F.broadcast(last), F.lit(True))
    value = lambda c: F.coalesce(*([F.col(c)] if c in new.columns else []), F.lit(defaults.get(c))).cast(store.schema[c].dataType)
    fresh = rows.select(*[(F.col("_last") + F.col("_nth")).cast(store.schema[c].dataType).alias(c) if c == key else value(c).alias(c) for c in store.columns])
    return store.unionByName(fresh)


def append_lines(ledger: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """Lines (by, section, nth, text) with one for each entry (by, section, ts, text): stamped, at its section's end, in order of time."""
    last = ledger.groupBy(by, "section").agg(F.max("nth").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(by, "section").orderBy("ts", "text"))
    said = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("text"))
    fresh = entries.withColumn("_n", nth).join(last, [by, "section"], "left")
    fresh = fresh.select(by, "section", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast(ledger.schema["nth"].dataType).alias("nth"), said.alias("text"))
    return ledger.select(by, "section", "nth", "text").unionByName(fresh)
