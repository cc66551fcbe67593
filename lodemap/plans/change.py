"""Queries over changes, snapshots, health and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from .registry import Source, query


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
    CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN concat_ws(',', CASE WHEN a.module IS DISTINCT FROM b.module THEN 'module' END, CASE WHEN a.loc IS DISTINCT FROM b.loc THEN 'loc' END,
      CASE WHEN a.complexity_score IS DISTINCT FROM b.complexity_score THEN 'complexity_score' END) END AS changed
    FROM snapshot_a a FULL JOIN snapshot_b b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.loc IS DISTINCT FROM b.loc OR a.complexity_score IS DISTINCT FROM b.complexity_score""")
def graph_diff(s: Source):
    return D.diff(s("snapshot_a"), s("snapshot_b"), ["path"], ["module", "loc", "complexity_score"])


@query("""SELECT a.name, a.file, a.contract_hash AS old_hash, concat('h', a.id % 13) AS new_hash, a.consumer_count FROM interfaces a WHERE a.id % 5 <> 0 AND a.contract_hash <> concat('h', a.id % 13)""")
def interface_diff(s: Source):
    now = s("interfaces").where("id % 5 <> 0").withColumn("contract_hash", F.concat(F.lit("h"), (F.col("id") % 13).cast("string")))
    return D.breaking_interfaces(s("interfaces"), now)


@query("""SELECT CASE WHEN k % 4 = 1 THEN concat(path, '.old') ELSE path END AS path, CASE k % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'deleted' ELSE 'modified' END AS change FROM files
    UNION ALL SELECT path, 'added' FROM files WHERE k % 4 = 1""")
def changed_files(s: Source):
    status = F.expr("CASE k % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R100' WHEN 2 THEN 'D' ELSE 'M' END")
    return D.changed_files(s("files").select("path", status.alias("status"), F.concat("path", F.lit(".old")).alias("old_path")))


@query("""SELECT concat('s', k % 9) AS provider, concat('c', k % 4) AS consumer, path AS endpoint, CASE WHEN k % 6 = 0 THEN 'endpoint_removed' ELSE 'response_changed' END AS kind, 'blocker' AS severity, CASE WHEN k % 6 = 0 THEN '' ELSE 'size,long' END AS detail
    FROM files WHERE k % 6 = 0 OR k % 5 = 0
    UNION ALL SELECT concat('s', k % 9), concat('c', k % 4), path, 'status_codes_changed', 'warning', '200,404' FROM files WHERE k % 6 <> 0 AND k % 7 = 0""")
def contract_breaks(s: Source):
    k = F.col("k")
    keys = s("files").select(F.concat(F.lit("s"), (k % 9).cast("string")).alias("provider"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("consumer"), F.col("path").alias("endpoint"), "k")
    base = keys.withColumn("response", F.lit("{ id: string, size: long, n: int }")).withColumn("status_codes", F.lit("200"))
    now = keys.where("k % 6 <> 0").withColumn("response", F.when(k % 5 == 0, "{ id: string, n: int }").otherwise("{ id: string, size: long, n: int }"))
    return D.contract_breaks(base, now.withColumn("status_codes", F.when(k % 7 == 0, "200,404").otherwise("200")))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'phantom' ELSE 'undeclared' END AS finding FROM snapshot_a a FULL JOIN snapshot_b b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL""")
def declared_vs_detected(s: Source):
    return D.declared_vs_detected(s("snapshot_a"), s("snapshot_b"), ["path"])


_ENTROPY = """d AS (SELECT DISTINCT source_file, target_file FROM dependencies), e AS (SELECT d.*, a.module AS am, b.module AS bm FROM d JOIN files a ON a.path = d.source_file JOIN files b ON b.path = d.target_file),
    x AS (SELECT f.module, f.loc, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, coalesce(oe, 0) AS oe, coalesce(ie, 0) AS ie, coalesce(ex, 0) AS ex, coalesce(ab, 0) AS ab FROM (SELECT module, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY module) f
      LEFT JOIN (SELECT am, count(DISTINCT target_file) AS ce, count(*) AS oe FROM e WHERE am <> bm GROUP BY am) q1 ON q1.am = f.module LEFT JOIN (SELECT bm, count(DISTINCT source_file) AS ca FROM e WHERE am <> bm GROUP BY bm) q2 ON q2.bm = f.module
      LEFT JOIN (SELECT am, count(*) AS ie FROM e WHERE am = bm GROUP BY am) q3 ON q3.am = f.module
      LEFT JOIN (SELECT module, count(*) AS ex, count(CASE WHEN kind IN ('interface', 'type') THEN 1 END) AS ab FROM symbols JOIN files ON path = file WHERE exported GROUP BY module) q4 ON q4.module = f.module),
    m AS (SELECT module, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END AS i, CASE WHEN ex = 0 THEN 0.0 ELSE CAST(ab AS DOUBLE) / ex END AS a, CASE WHEN ie + oe = 0 THEN 1.0 ELSE CAST(ie AS DOUBLE) / (ie + oe) END AS c, loc FROM x),
    y AS (SELECT module, ca, ce, round(i, 4) AS instability, round(a, 4) AS abstractness, round(abs(a + i - 1), 4) AS distance, round(c, 4) AS cohesion, loc FROM m)"""


@query(f"WITH {_ENTROPY} SELECT * FROM y")
def entropy(s: Source):
    return D.entropy(s("files"), s("dependencies"), s("symbols"))


@query(f"WITH {_ENTROPY} SELECT count(*) AS modules, round(avg(distance), 6) AS avg_distance, round(avg(instability), 6) AS avg_instability, round(avg(cohesion), 6) AS avg_cohesion, CASE WHEN avg(distance) < 0.3 THEN 'green' WHEN avg(distance) < 0.5 THEN 'yellow' ELSE 'red' END AS health FROM y")
def entropy_total(s: Source):
    out = D.entropy_total(entropy(s))
    return out.select("modules", *[F.round(c, 6).alias(c) for c in ("avg_distance", "avg_instability", "avg_cohesion")], "health")


@query("""WITH w AS (SELECT r.k % 500 AS id, count(v) AS n, sum(CASE WHEN v IN ('VERIFIED', 'WIRED') THEN 1.0 WHEN v IN ('UNCERTAIN', 'ORPHANED', 'PARTIAL') THEN 0.5 ELSE 0.0 END) AS s
      FROM (SELECT k, CASE k % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'WIRED' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'FAILED' END AS v FROM files WHERE k % 500 < 400) r GROUP BY 1),
    d AS (SELECT DISTINCT f.k % 500 AS id, CASE WHEN w.id IS NULL THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 1 - CAST(s AS DOUBLE) / n END AS drift FROM files f LEFT JOIN w ON w.id = f.k % 500)
    SELECT id, drift, CASE WHEN drift <= 0.10 THEN 'GREEN' WHEN drift <= 0.25 THEN 'YELLOW' ELSE 'RED' END AS level FROM d""")
def requirement_drift(s: Source):
    f = s("files")
    reqs = f.select((F.col("k") % 500).alias("id")).distinct()
    covers = f.where("k % 500 < 400").select((F.col("k") % 500).alias("id"), F.col("k").alias("plan"))
    verdict = F.expr("CASE k % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'WIRED' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'FAILED' END")
    return D.requirement_drift(reqs, covers, f.select(F.col("k").alias("plan"), verdict.alias("verdict")).where("verdict is not null"))


@query("SELECT id, consumer_count, CASE WHEN consumer_count > 15 THEN 'CRITICAL' WHEN consumer_count > 10 THEN 'HIGH' WHEN consumer_count > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM interfaces")
def interface_risk(s: Source):
    return s("interfaces").select("id", "consumer_count", D.consumer_risk(F.col("consumer_count")).alias("risk"))


@query("""SELECT id, rule, severity FROM (
    SELECT id, 'too_short' AS rule, 'warning' AS severity FROM requirements WHERE length(text) < 20
    UNION ALL SELECT id, 'not_measurable', 'info' FROM requirements WHERE NOT regexp_matches(lower(text), '[0-9]')
    UNION ALL SELECT id, 'compound', 'warning' FROM requirements WHERE len(regexp_extract_all(lower(text), '\\band\\b')) >= 2
    UNION ALL SELECT id, 'weasel_words', 'warning' FROM requirements WHERE regexp_matches(lower(text), '\\b(fast|easy|simple|user-friendly|robust|efficient|appropriate|etc|adequate|flexible)\\b')
    UNION ALL SELECT id, 'not_traced', 'warning' FROM requirements WHERE id % 3 = 0) x""")
def lint_requirements(s: Source):
    r = s("requirements")
    return D.lint_requirements(r, r.where("id % 3 <> 0").select("id"))


@query("""SELECT * FROM (SELECT l_suppkey, lag(l_linenumber) OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber) AS after, l_linenumber AS before, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem) d) x WHERE before > after + 1""")
def gap_detection(s: Source):
    return D.gaps(s("lineitem"), ["l_suppkey", "l_orderkey"], "l_linenumber").select("l_suppkey", "after", "before", "l_orderkey")


@query("""SELECT user_id, count(CASE WHEN ts >= a - INTERVAL '7' DAY THEN 1 END) AS changes_7d, count(CASE WHEN ts >= a - INTERVAL '14' DAY THEN 1 END) AS changes_14d FROM (SELECT *, max(ts) OVER () AS a FROM events) x GROUP BY user_id""")
def rolling_counts(s: Source):
    return D.rolling_counts(s("events"), "user_id", "ts", (7, 14))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000000 THEN 1 ELSE 0 END AS o FROM events),
    g AS (SELECT user_id, ts, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m) SELECT user_id, session, count(*) AS events FROM g GROUP BY user_id, session""")
def session_debounce(s: Source):
    return D.sessions(s("events"), "user_id", "ts", 3600).select("user_id", "session", "events")


@query("""WITH a AS (SELECT user_id AS suite, count(CASE WHEN event_type <> 'error' THEN 1 END) AS p, count(CASE WHEN event_type = 'error' THEN 1 END) AS f FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
    b AS (SELECT user_id AS suite, count(CASE WHEN event_type <> 'error' THEN 1 END) AS p, count(CASE WHEN event_type = 'error' THEN 1 END) AS f FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 9 <> 0 GROUP BY 1)
    SELECT a.suite, CASE WHEN b.suite IS NULL THEN 'missing' WHEN a.f = 0 AND b.f > 0 THEN 'newly_failing' ELSE 'fewer_passing' END AS kind, a.p - coalesce(b.p, 0) AS lost FROM a LEFT JOIN b ON a.suite = b.suite
    WHERE b.suite IS NULL OR (a.f = 0 AND b.f > 0) OR b.p < a.p""")
def regression(s: Source):
    made = lambda e: e.groupBy(F.col("user_id").alias("suite")).agg(F.count_if(F.col("event_type") != "error").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    cut = F.lit("2024-01-16").cast("timestamp")
    e = s("events")
    return D.regression(made(e.where(F.col("ts") < cut)), made(e.where((F.col("ts") >= cut) & (F.col("user_id") % 9 != 0))))


@query("""WITH c AS (SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS killed, count(CASE WHEN event_type = 'error' THEN 1 END) AS survived FROM events GROUP BY user_id)
    SELECT *, CASE WHEN killed + survived = 0 THEN 1.0 ELSE floor(CAST(killed AS DOUBLE) / (killed + survived) * 10000 + 0.5) / 10000 END AS score FROM c""")
def mutation_score(s: Source):
    status = F.when(F.col("event_type") == "click", "killed").when(F.col("event_type") == "error", "survived")
    return D.mutation_score(s("events").withColumn("status", status), "user_id")
