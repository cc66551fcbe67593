"""Line dedup by a log-template tree, in DataFrame operations only.

A line falls through a tree of fixed depth: its number of tokens, then its ``LEAD`` first tokens, where a token with a
digit is a variable. In a leaf that lines of ``DOCS`` documents reach, a token is constant at its place if at least
``SUPPORT`` of the leaf's lines (and two of them) have it there; any other token there is a variable field. A line
whose constants make up ``SHARE`` of its tokens, and ``FEWEST`` at least, has that template; any other line is its own
template, digits apart.
A template met in ``DOCS`` documents or more is recurring: its lines are dropped from all documents but the first, so
what a group of copies says is not lost with the copies. Lines of fewer than ``LEAD`` tokens say too little and are never dropped.

The leading tokens are counted first, without the rest of the line; lines whose leading tokens are too rare go no
further, nor do those of rare leaves, nor documents without a line to drop to the last join (tables of at most ``BUCKETS``
hash values are broadcast for that; what passes them wrongly drops out later).
Whatever is joined by leaf or template takes two ways (``joins``): those with a large share of the lines are few and
broadcast, so that none of them lands in one task, and the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import joined, sized
from .storage import written

LEAD, DOCS, SUPPORT, SHARE = 3, 3, 0.05, 0.7
FEWEST = 5  # constants of a template with variable fields
WILD = "<*>"
LEAST = -(2**63)
BUCKETS = 1 << 20


def _masked(text: Column) -> Column:
    """Tokens with a digit become the wildcard (of text with single spaces)."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)).otherwise(text)


def _plain() -> Column:
    """``line`` with single spaces between its tokens."""
    line = F.col("line")
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("  "))
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \t\r]+", " ")).otherwise(line))


def _hashed(text: Column, name: str) -> list[Column]:
    """Two independent 64-bit hashes, which stand for a text of any length."""
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(7), text).alias(f"{name}2")]


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    """doc, key, n_line, line (single-spaced) and two hashes of its leading tokens, digits masked."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long")).alias("doc"), F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("n_line", "line"))
    made = source.withColumn("line", _plain()).withColumn("lead", F.substring_index("line", " ", lead)).withColumn("lead", _masked(F.col("lead")))
    return made.select("doc", "key", "n_line", "line", *_hashed(F.col("lead"), "lead"))


def _passing(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join by a hash of ``on`` to ``BUCKETS`` values, which are broadcast: what does not pass surely has no partner."""
    bucket = lambda: F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int")
    found = written(keys.select(bucket().alias("bucket")).distinct(), "buckets")
    return rows.join(F.broadcast(found), bucket() == F.col("bucket"), how)


def recurring_lines(docs: DataFrame, min_docs: int = DOCS, lead: int = LEAD, support: float = SUPPORT, share: float = SHARE) -> DataFrame:
    """doc, key, n_line of the lines to drop, and their template."""
    leaf, lines = ["n", "lead1", "lead2"], _lines(docs, lead)
    busy = lines.select("lead1", "lead2", "doc", "key").distinct().groupBy("lead1", "lead2").count().where(F.col("count") >= min_docs)
    shared = _passing(lines, busy, ["lead1"], "left_semi").withColumn("plain", _masked(F.col("line")))
    shared = shared.withColumn("n", F.size(F.split("plain", " "))).where(F.col("n") >= lead)
    shared = written(shared.select("doc", "key", "n_line", "plain", *leaf, *_hashed(F.col("plain"), "line")), "shared-lines")

    each = shared.groupBy(*leaf, "doc", "key").agg(F.count("*").alias("lines"))
    sizes = sized(each.groupBy(*leaf).agg(F.sum("lines").alias("of"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "of")
    # what follows goes by different lines, each with the number of its copies
    line = ["line1", "line2"]
    unlike = written(_passing(shared, sizes, leaf, "left_semi").groupBy(*leaf, *line, "plain").agg(F.count("*").alias("copies")), "different-lines")
    # of a hot leaf, only what is constant is joined by leaf: 1 / support tokens of each place
    found = unlike.select(*leaf, "copies", F.posexplode(F.split("plain", " ")).alias("at", "token")).where(F.col("token") != WILD)
    found = found.groupBy(*leaf, "at", "token").agg(F.sum("copies").alias("met")).where("met >= 2")
    found = found.join(F.broadcast(sizes.where("hot").select(*leaf, F.col("of").alias("most"))), leaf, "left").where(F.col("most").isNull() | (F.col("met") >= support * F.col("most")))
    found = found.join(sizes, leaf).where(F.col("met") >= support * F.col("of")).select(*leaf, "at", "token")
    every = sizes.select(*leaf, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), F.lit(None).cast("string").alias("token"))
    fixed = found.unionByName(every).groupBy(*leaf, "at").agg(F.collect_set("token").alias("fixed")).groupBy(*leaf)
    fixed = fixed.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "fixed"))), lambda x: x["fixed"]).alias("fixed"))
    leaves = written(sizes.drop("of").join(fixed, leaf), "leaves")

    on = F.transform("tokens", lambda t, i: F.array_contains(F.get("fixed", i), t))
    general = F.zip_with("tokens", "on", lambda t, o: F.when(o, t).otherwise(WILD))
    met = F.aggregate("on", F.lit(0), lambda a, o: a + o.cast("int"))
    template = F.when((met >= share * F.size("tokens")) & (met >= FEWEST), F.array_join(general, " ")).otherwise(F.col("plain"))
    named = joined(unlike, leaves, leaf).withColumn("tokens", F.split("plain", " ")).withColumn("on", on).select(*line, "copies", template.alias("template"))
    named = sized(named.select("*", *_hashed(F.col("template"), "id")), "copies").drop("copies")
    named = written(joined(shared.select("doc", "key", "n_line", *line), named, line).drop(*line), "line-templates")

    same, who = ["id1", "id2"], F.struct("doc", "key")
    each = named.groupBy(*same, "doc", "key").agg(F.count("*").alias("lines"))
    recurring = each.groupBy(*same).agg(F.sum("lines").alias("of"), F.count("*").alias("docs"), F.min(who).alias("first")).where(F.col("docs") >= min_docs)
    return joined(named, sized(recurring, "of").drop("of", "docs"), same).where(who > F.col("first")).select("doc", "key", "n_line", "template")


def cleaned(docs: DataFrame, **rules: float) -> DataFrame:
    """row (a struct of the columns of ``docs`` but text, in their order), text without its recurring lines, n_lines, n_dropped."""
    drop = recurring_lines(docs, **rules).groupBy("doc", "key").agg(F.collect_set("n_line").alias("drop"))
    drop = written(drop, "lines-to-drop")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    wide = docs.select(F.struct(*rest).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long")).alias("doc"), F.xxhash64("text").alias("key"))
    who = ["doc", "key"]
    whole = _passing(wide, drop, who, "left_anti").withColumn("drop", F.lit(None).cast("array<int>"))
    lines = _passing(wide, drop, who, "left_semi").join(drop, who, "left").unionByName(whole).withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return lines.select("row", kept.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **rules: float) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, plus n_lines and n_dropped (in place of columns of those names).

    Other columns pass through, whatever they are called. Order is doc_id (null first), then a hash of the text. Null
    texts stay null (no lines), empty and blank lines stay; rows repeated with id and text share their fate and count
    as one document. An empty table gives an empty result.
    """
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cleaned(docs, **rules).select(*kept, "n_lines", "n_dropped")


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of doc_id and text: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays (null: empty)."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The report in the oracle's SQL, over ``documents``; settings are those above.
REPORT_SQL = f"""
WITH lines AS (
  SELECT doc_id, n_line - 1 AS n_line, list_filter(regexp_split_to_array(line, '[ \\t\\r]+'), lambda t: t <> '') AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n_line FROM documents)
), masked AS (
  SELECT doc_id, n_line, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{WILD}' ELSE t END) AS tokens FROM lines WHERE len(raw) >= {LEAD}
), keyed AS (
  SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:{LEAD}], ' ') AS leaf FROM masked
), busy AS (
  SELECT leaf, count(*) AS of_lines FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {DOCS}
), shared AS (
  SELECT k.*, b.of_lines FROM keyed k JOIN busy b USING (leaf)
), exploded AS (
  SELECT doc_id, n_line, leaf, of_lines, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM shared
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY leaf, place, token) AS n FROM exploded
), fielded AS (
  SELECT *, n >= {SUPPORT} * of_lines AND n >= 2 AND token <> '{WILD}' AS fixed FROM counted
), templates AS (
  SELECT doc_id, n_line,
    CASE WHEN count(*) FILTER (WHERE fixed) >= {SHARE} * count(*) AND count(*) FILTER (WHERE fixed) >= {FEWEST}
      THEN string_agg(CASE WHEN fixed THEN token ELSE '{WILD}' END, ' ' ORDER BY place) ELSE string_agg(token, ' ' ORDER BY place) END AS template
  FROM fielded GROUP BY doc_id, n_line
), recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= {DOCS}
), dropped AS (
  SELECT t.doc_id, list(t.n_line) AS place FROM templates t JOIN recurring r USING (template) WHERE t.doc_id > r.first_doc GROUP BY t.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(len(x.place), 0) AS n_dropped,
  sha256(coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda l, i: NOT list_contains(coalesce(x.place, []), i - 1)), chr(10)), '')) AS kept_sha256
FROM documents d LEFT JOIN dropped x USING (doc_id)
"""
