"""Similarity, conflicts, keywords, capabilities and conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, half_up


def similar_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """a, b, similarity: pairs with word-set Jaccard >= ``least``, found by an exact prefix filter.

    Tokens are ranked by rarity; two sets that meet the bound share a token among their rarest n - ceil(least * n) + 1,
    so only those are joined. Equal sets are one class first: copies meet through their class and are listed as pairs
    of class representatives plus membership by ``class_members``.
    """
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    classes = sets.groupBy("t").agg(F.min("id").alias("id"))
    flat = classes.select("id", F.explode("t").alias("w"))
    common = flat.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "w")
    n = F.count("*").over(Window.partitionBy("id"))
    ranked = flat.join(common, "w").withColumn("n", n).withColumn("r", F.row_number().over(order))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "w", "n")
    left, right = prefix.toDF("a", "w", "na"), prefix.toDF("b", "w", "nb")
    sized = (F.col("na") * 1.0 >= F.col("nb") * least) & (F.col("nb") * 1.0 >= F.col("na") * least)
    pairs = left.join(right, "w").where((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    ta, tb = classes.toDF("ta", "a"), classes.toDF("tb", "b")
    both = pairs.join(ta, "a").join(tb, "b")
    common_n = F.size(F.array_intersect("ta", "tb"))
    similarity = common_n / (F.size("ta") + F.size("tb") - common_n)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def class_members(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """id, class_id: the smallest id with the same token set."""
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t"))
    firsts = sets.groupBy("t").agg(F.min("id").alias("class_id"))
    return sets.join(firsts, "t").select("id", "class_id")


def overlapping_scope(pairs: DataFrame, categories: DataFrame, same: float = 0.8, cross: float = 0.6) -> DataFrame:
    """kind, severity of similar pairs, by whether their categories (id, category) agree."""
    a, b = categories.toDF("a", "ca"), categories.toDF("b", "cb")
    out = pairs.join(a, "a").join(b, "b")
    dup, over = (F.col("ca") == F.col("cb")) & (F.col("similarity") > same), (F.col("ca") != F.col("cb")) & (F.col("similarity") > cross)
    out = out.withColumn("kind", F.when(dup, "potential_duplicate").when(over, "overlapping_scope")).where("kind is not null")
    return out.select("a", "b", "kind", F.when(F.col("kind") == "potential_duplicate", "info").otherwise("warning").alias("severity"), half_up(F.col("similarity"), 2).alias("similarity"))


#: Groups of technologies of which a system uses one; conflicts within the first block.
TECH_GROUPS = {
    "database": ["postgresql", "mysql", "mongodb", "dynamodb", "firestore", "sqlite"],
    "api": ["rest", "graphql", "grpc", "trpc"],
    "auth": ["jwt", "session-cookie", "oauth-only"],
    "hosting": ["serverless", "kubernetes", "single-server"],
    "frontend": ["react", "vue", "angular", "svelte"],
}


def _mention(text: Column, name: str) -> Column:
    import re

    return F.lower(text).rlike(r"(^|[^a-z0-9])" + re.escape(name).replace(r"\ ", "[- ]").replace(r"\-", "[- ]") + r"($|[^a-z0-9])")


def tech_mentions(df: DataFrame, key: str, text: str, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """key, grp, tech: whole-word mentions (a hyphen and a space are alike)."""
    names = [(g, t) for g, ts in (groups or TECH_GROUPS).items() for t in ts]
    found = F.array_compact(F.array(*[F.when(_mention(F.col(text), t), F.struct(F.lit(g).alias("grp"), F.lit(t).alias("tech"))) for g, t in names]))
    return df.select(key, F.explode(found).alias("m")).select(key, "m.grp", "m.tech")


def tech_conflicts(mentions: DataFrame, key: str) -> DataFrame:
    """a, b, grp, tech_a, tech_b, severity: different members of one group in different rows; database conflicts block.

    Rows with one tech are one class: a conflict is reported between the first row of each tech.
    """
    firsts = mentions.groupBy("grp", "tech").agg(F.min(key).alias("first"), F.count("*").alias("rows"))
    x, y = firsts.toDF("grp", "tech_a", "a", "rows_a"), firsts.toDF("grp", "tech_b", "b", "rows_b")
    out = x.join(y, "grp").where("tech_a < tech_b")
    return out.withColumn("severity", F.when(F.col("grp") == "database", "blocker").otherwise("warning"))


def keywords(df: DataFrame, key: str, text: str, least: int = 3, stop: list[str] | None = None) -> DataFrame:
    """key, word, n: words of at least ``least`` letters and adjacent pairs of words, without stop words and mark-up."""
    t = F.lower(F.col(text))
    for pattern in (r"```[\s\S]*?```", r"`[^`]*`", r"https?://\S+"):
        t = F.regexp_replace(t, pattern, " ")
    tokens = F.filter(F.split(t, "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    banned = list(stop or STOP_WORDS)
    src = df.select(key, tokens.alias("w"))
    words = src.select(key, F.explode(F.filter("w", lambda w: (F.length(w) >= least) & ~w.isin(banned))).alias("word"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("x"), F.element_at("w", i + 1).alias("y")))
    pairs = src.where(F.size("w") > 1).select(key, F.explode(F.filter(pairs, lambda p: ~p["x"].isin(banned) & ~p["y"].isin(banned))).alias("p"))
    both = words.unionByName(pairs.select(key, F.concat_ws(" ", "p.x", "p.y").alias("word")))
    return both.groupBy(key, "word").agg(F.count("*").alias("n"))


def capability_scores(signals: DataFrame, hits: DataFrame) -> DataFrame:
    """module, capability, confidence of at least 0.1.

    ``signals``: capability, kind (content, file, import, symbol), signal. ``hits``: module, kind, signal, n. A content
    signal of one capability alone weighs 2, of two 1.5, of more 1. Content gives up to 4 points, files 3, imports 3,
    symbols 2; the confidence is their share of what the capability's kinds can give.
    """
    spread = signals.groupBy("kind", "signal").agg(F.countDistinct("capability").alias("used"))
    weight = F.when(F.col("used") == 1, 2.0).when(F.col("used") == 2, 1.5).otherwise(1.0)
    s = signals.join(spread, ["kind", "signal"]).withColumn("w", weight)
    per = s.groupBy("capability", "kind").agg(F.count("*").alias("total"))
    got = hits.join(s, ["kind", "signal"]).groupBy("module", "capability", "kind").agg(F.sum("w").alias("sw"), F.count("*").alias("signals"), F.sum("n").alias("n"))
    got = got.join(per, ["capability", "kind"])
    one, five = F.lit(1.0), F.lit(5)
    points = (
        F.when(F.col("kind") == "content", F.least(F.col("sw") / F.col("total"), one) * 4)
        .when(F.col("kind") == "file", F.least(F.col("signals") / F.col("total"), one) * 3)
        .when(F.col("kind") == "import", F.least(F.col("n"), five) * 0.6)
        .otherwise(F.least(F.col("n"), five) * 0.4)
    )
    most = F.when(F.col("kind") == "content", 4.0).when(F.col("kind") == "symbol", 2.0).otherwise(3.0)
    bound = per.groupBy("capability").agg(F.sum(most).alias("most"))
    out = got.groupBy("module", "capability").agg(F.sum(points).alias("points")).join(bound, "capability")
    return out.select("module", "capability", half_up(F.col("points") / F.col("most"), 2).alias("confidence")).where("confidence >= 0.1")


def naming_conventions(symbols: DataFrame, by: str | None = None, majority: float = 0.6) -> DataFrame:
    """Counts of camel, snake and Pascal case among exported value names, and the style that over ``majority`` follow."""
    named = symbols.where("exported and kind not in ('class', 'interface', 'type', 'enum')")
    n = F.col("name")
    g = named.groupBy(*([by] if by else []))
    out = g.agg(
        F.count("*").alias("total"), F.count_if(n.rlike("^[a-z]+([A-Z][a-z0-9]*)+$")).alias("camel"),
        F.count_if(n.rlike("^[a-z0-9]+(_[a-z0-9]+)+$")).alias("snake"), F.count_if(n.rlike("^([A-Z][a-z0-9]*)+$")).alias("pascal"),
    )
    style = F.when(F.col("camel") > majority * F.col("total"), "camelCase").when(F.col("snake") > majority * F.col("total"), "snake_case").when(F.col("pascal") > majority * F.col("total"), "PascalCase")
    return out.withColumn("style", F.coalesce(style, F.lit("mixed")))


def rank_by_score(scores: DataFrame, by: str, score: str, share: float = 0.5, most: int = 3) -> DataFrame:
    """Candidates of at least ``share`` of the best score, ``most`` at most, per group."""
    w = Window.partitionBy(by)
    top = scores.withColumn("_best", F.max(score).over(w)).where(F.col(score) >= share * F.col("_best")).drop("_best")
    return top.withColumn("nth", F.row_number().over(w.orderBy(F.desc(score), *[c for c in scores.columns if c not in (by, score)]))).where(F.col("nth") <= most)
