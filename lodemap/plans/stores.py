"""Queries over the append stores and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores as S
from ..sources import tables
from .registry import Source, query


@query("""SELECT dimension, value, round(cost, 4) AS cost, tokens, units FROM (SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, sum(cost_usd) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS units FROM metric_units
    UNION ALL SELECT 'phase', phase, sum(cost_usd), CAST(sum(tokens) AS BIGINT), count(*) FROM metric_units GROUP BY phase UNION ALL SELECT 'model', model, sum(cost_usd), CAST(sum(tokens) AS BIGINT), count(*) FROM metric_units GROUP BY model) x""")
def metrics_rollup(s: Source):
    return S.cost_rollup(s("metric_units")).withColumn("cost", F.round("cost", 4))


@query("SELECT round(sum(cost_usd), 4) AS spent, round(1000 - sum(cost_usd), 4) AS remaining, sum(cost_usd) <= 1000 AS within_budget, round(avg(cost_usd) * (count(*) + 5), 4) AS projected FROM metric_units")
def check_budget(s: Source):
    out = S.check_budget(s("metric_units"), 1000.0)
    return out.select(F.round("spent", 4).alias("spent"), F.round("remaining", 4).alias("remaining"), "within_budget", F.round("projected", 4).alias("projected"))


@query("SELECT path, module, loc + 1000 AS loc FROM files WHERE k % 4 = 0 UNION ALL SELECT path, module, loc FROM files WHERE k % 4 <> 0 AND k % 5 <> 0")
def upsert_files(s: Source):
    f = s("files")
    old = f.where("k % 5 <> 0").select("path", "module", "loc")
    new = f.where("k % 4 = 0").select("path", "module", (F.col("loc") + 1000).alias("loc"), F.lit(2).alias("seq"))
    return tables.upsert(old, new.unionByName(new.withColumn("loc", F.lit(-1).cast("long")).withColumn("seq", F.lit(1))), ["path"], "seq")


@query("SELECT path, loc FROM files WHERE k % 5 <> 0 UNION ALL SELECT path, 1 FROM files WHERE k % 5 = 0 AND k % 2 = 0")
def insert_ignore(s: Source):
    f = s("files")
    new = f.where("k % 2 = 0").select("path", F.lit(1).cast("long").alias("loc"), F.lit(1).alias("seq"))
    return tables.insert_ignore(f.where("k % 5 <> 0").select("path", "loc"), new.unionByName(new.withColumn("seq", F.lit(2)).withColumn("loc", F.lit(2).cast("long"))), ["path"], "seq")


@query("SELECT source_file, target_file, import_name FROM dependencies WHERE source_file NOT IN (SELECT path FROM files WHERE k % 7 = 0)")
def delete_cascade(s: Source):
    f = s("files")
    _, kept = tables.delete_cascade(f, {"dependencies": (s("dependencies"), "source_file")}, f.where("k % 7 = 0").select("path"), "path")
    return kept["dependencies"].select("source_file", "target_file", "import_name")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n <= 20")
def newest_per_key(s: Source):
    return tables.newest(s("events"), ["ts", "event_id"], 20, ["user_id"]).select("user_id", "event_id")


@query("SELECT id, type, module FROM decisions WHERE active AND type = 'user' AND module = 'c3'")
def query_decisions(s: Source):
    return S.query_decisions(s("decisions"), type="user", module="c3", active=True).select("id", "type", "module")


@query("""SELECT id, CASE WHEN id % 100 = 1 THEN false ELSE active END AS active, CASE WHEN id % 100 = 1 THEN id + 1 END AS superseded_by FROM decisions""")
def supersede_decisions(s: Source):
    d = s("decisions")
    changes = d.where("id % 100 = 1").select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"))
    return S.supersede(d, changes).select("id", "active", "superseded_by")


_W = "list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> '')))"


@query(f"""WITH d AS (SELECT id, type, active, {_W} AS w, id % 2 = 0 AS old FROM decisions), n AS (SELECT type, w, min(id) AS id FROM d WHERE NOT old GROUP BY type, w)
    SELECT n.id, n.type FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.old AND d.active AND d.type = n.type AND (CASE WHEN len(d.w) + len(n.w) = 0 THEN 1.0
      ELSE CAST(len(list_intersect(d.w, n.w)) AS DOUBLE) / (len(d.w) + len(n.w) - len(list_intersect(d.w, n.w))) END) >= 0.8)""")
def add_decisions(s: Source):
    d = s("decisions")
    return S.add_decisions(d.where("id % 2 = 0"), d.where("id % 2 <> 0")).select("id", "type")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT user_id, n AS nth, CAST(event_id AS VARCHAR) AS text FROM r WHERE n <= 10 UNION ALL SELECT user_id, 11, concat('... ', count(*), ' earlier lines compacted') FROM r WHERE n > 10 GROUP BY user_id""")
def compact_ledger(s: Source):
    e = s("events").select("user_id", F.col("event_id").alias("nth"), F.col("event_id").cast("string").alias("text"))
    return S.compact_ledger(e, "user_id")


@query("SELECT event_id AS id, severity FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'medium' WHEN 'click' THEN 'low' END AS severity FROM events) x WHERE severity IN ('medium', 'high', 'critical')")
def promote_severity(s: Source):
    severity = F.expr("CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'medium' WHEN 'click' THEN 'low' END")
    return S.promote(s("events").select(F.col("event_id").alias("id"), severity.alias("severity")))
