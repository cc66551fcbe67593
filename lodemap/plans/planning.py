"""Queries over plans, requirements and verification results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import graph
from ..operators import planning as P
from ..sources.tables import staged
from .registry import Source, query

PLANS = "SELECT o_orderkey AS id, o_custkey % 200 AS phase, o_custkey % 12 AS wave, o_orderstatus = 'F' AS has_summary, o_orderpriority <> '1-URGENT' AS autonomous FROM orders"


def _plans(s: Source):
    o = s("orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("phase"), (F.col("o_custkey") % 12).alias("wave"), (F.col("o_orderstatus") == "F").alias("has_summary"), (F.col("o_orderpriority") != "1-URGENT").alias("autonomous"))


@query(f"""WITH p AS ({PLANS}) SELECT phase, count(*) AS plans, count(CASE WHEN has_summary THEN 1 END) AS done,
    CASE WHEN count(CASE WHEN has_summary THEN 1 END) = 0 THEN 'pending' WHEN count(CASE WHEN has_summary THEN 1 END) < count(*) THEN 'in_progress' ELSE 'complete' END AS status,
    CAST(floor(count(CASE WHEN has_summary THEN 1 END) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM p GROUP BY phase""")
def phase_progress(s: Source):
    return P.progress(_plans(s), "phase")


@query(f"WITH p AS ({PLANS}) SELECT wave, count(*) AS plans, count(CASE WHEN NOT has_summary THEN 1 END) AS incomplete, bool_or(NOT autonomous) AS has_checkpoint FROM p GROUP BY wave")
def plan_waves(s: Source):
    return P.waves(_plans(s)).withColumn("incomplete", F.size("incomplete").cast("long"))


@query("SELECT o_custkey % 50 AS phase, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS provides FROM orders GROUP BY 1")
def history_digest(s: Source):
    rows = s("orders").select((F.col("o_custkey") % 50).alias("phase"), F.array("o_orderpriority").alias("provides"))
    return P.digest(rows, "phase", ["provides"]).withColumn("provides", F.array_join("provides", ","))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'no_summary' ELSE 'no_plan' END AS finding, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'warning' END AS severity FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0) AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)")
def plan_completeness(s: Source):
    ids = s("orders").select(F.col("o_orderkey").alias("id"))
    return P.completeness(ids.where("id % 3 = 0"), ids.where("id % 2 = 0"), "id")


@query("SELECT l_partkey AS requirement, count(DISTINCT l_orderkey) AS plans, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1")
def traceability(s: Source):
    return P.traceability(s("lineitem").select(F.col("l_partkey").alias("requirement"), F.col("l_orderkey").alias("plan"), F.col("l_suppkey").alias("file")))


@query("""WITH r AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT (SELECT count(DISTINCT l_orderkey) FROM r WHERE l_partkey % 50 = 0) AS affected_plans, count(*) AS plan_refs,
    least(1.0, CAST((SELECT count(DISTINCT l_orderkey) FROM r WHERE l_partkey % 50 = 0) AS DOUBLE) / count(*)) AS score FROM r""")
def requirement_impact(s: Source):
    links = s("lineitem").select(F.col("l_partkey").alias("requirement"), F.col("l_orderkey").alias("plan"))
    return P.requirement_impact(links, links.where("requirement % 50 = 0"))


@query("""WITH h AS (SELECT DISTINCT id, service_id FROM service_interfaces, (VALUES ('economy'), ('small')) v(word) WHERE list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), word)),
    d AS (SELECT service_id AS service, count(DISTINCT id) AS interfaces FROM h GROUP BY 1), f AS (SELECT provider_id AS service, count(DISTINCT consumer_id) AS fan_in FROM service_dependencies GROUP BY 1),
    u AS (SELECT DISTINCT consumer_id AS service FROM service_dependencies WHERE provider_id IN (SELECT service FROM d)),
    a AS (SELECT coalesce(d.service, u.service) AS service, coalesce(interfaces, 0) AS interfaces, u.service IS NOT NULL AS uses FROM d FULL JOIN u ON d.service = u.service)
    SELECT a.service, a.interfaces, CASE WHEN a.interfaces > 0 AND uses THEN 'mixed' WHEN a.interfaces > 0 THEN 'provider' ELSE 'consumer' END AS role, coalesce(f.fan_in, 0) AS fan_in,
      CASE WHEN f.fan_in >= 5 THEN 'critical' WHEN f.fan_in >= 3 THEN 'high' WHEN f.fan_in >= 1 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN a.interfaces = 0 THEN 2 ELSE 1 END AS wave FROM a LEFT JOIN f ON f.service = a.service""")
def requirement_scope(s: Source):
    words = s.rows([("economy",), ("small",)], "word string")
    return P.analyse_scope(P.keyword_hits(words, s("service_interfaces")), s.system.edges(), "s1")


@query("""SELECT lang, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, round(sum(ceil(length(text) / 4.0)) / 140000.0, 4) AS overflow, sum(ceil(length(text) / 4.0)) > 140000 AS needs_split,
    CAST(ceil(sum(ceil(length(text) / 4.0)) / 140000.0) AS BIGINT) AS parts, CASE WHEN sum(ceil(length(text) / 4.0)) <= 140000 THEN 'none' WHEN count(DISTINCT source) > 1 THEN 'module' ELSE 'file' END AS strategy FROM documents GROUP BY lang""")
def plan_assessment(s: Source):
    return P.assess_plans(s("documents").select("lang", F.col("source").alias("module"), F.lit("implementation").alias("concern"), "text"), "lang")


@query("""WITH c(agent, kind, value, weight, priority) AS (VALUES ('web', 'lang', 'en', 15, 1), ('web', 'source', 'src1', 25, 1), ('data', 'lang', 'de', 15, 2), ('data', 'source', 'src2', 25, 2), ('ops', 'source', 'src1', 40, 0)),
    g AS (SELECT doc_id AS task, 'lang' AS kind, lang AS value FROM documents UNION SELECT doc_id, 'source', source FROM documents),
    x AS (SELECT task, agent, sum(weight) + max(priority) AS score FROM g JOIN c ON g.kind = c.kind AND g.value = c.value GROUP BY task, agent),
    y AS (SELECT *, max(score) OVER (PARTITION BY task) AS best FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, agent) AS n FROM y WHERE score >= 0.5 * best)
    SELECT task, agent, CAST(score AS BIGINT) AS score FROM z WHERE n <= 3""")
def agent_selection(s: Source):
    rows = [("web", "lang", "en", 15, 1), ("web", "source", "src1", 25, 1), ("data", "lang", "de", 15, 2), ("data", "source", "src2", 25, 2), ("ops", "source", "src1", 40, 0)]
    d = s("documents")
    signals = d.select(F.col("doc_id").alias("task"), F.lit("lang").alias("kind"), F.col("lang").alias("value")).union(d.select("doc_id", F.lit("source"), "source"))
    return P.select_agents(signals, s.rows(rows, "agent string, kind string, value string, weight long, priority long"))


_SCAN = "concat('const a = 1;\n', CASE WHEN p_partkey % 3 = 0 THEN '// TODO later\n' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN 'console.log(a);\n' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN 'if (a) {' ELSE 'done();' END)"


@query("""SELECT concat('p', p_partkey) AS path, 2 AS line, 'todo' AS rule, 'info' AS severity FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT concat('p', p_partkey), CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END, 'debug_output', 'warning' FROM part WHERE p_partkey % 4 = 0""")
def scan_lines(s: Source):
    return C.scan_lines(s("part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr(_SCAN).alias("text"))).drop("snippet")


@query("""SELECT concat('p', p_partkey) AS path, concat(2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, ': open {') AS error FROM part WHERE p_partkey % 5 = 0""")
def check_brackets(s: Source):
    return C.check_brackets(s("part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr(_SCAN).alias("text")))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS r, concat('src/', CASE WHEN p_partkey % 11 = 0 THEN 'vendor/' ELSE '' END, 'p', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.css' WHEN 1 THEN '.test.js' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.JSON' ELSE '.js' END) AS path FROM part)
    SELECT path, operator, line, before, after FROM p, (VALUES ('negate_equality', 1, '===', '!=='), ('negate_inequality', 2, '!==', '==='), ('flip_true', 3, 'true', 'false'), ('remove_return', 3, 'return true;', 'return undefined;'),
      ('boundary_lt', 2, '< ', '<= '), ('arith_minus', 2, '- ', '+ ')) n(operator, line, before, after) WHERE k % 11 <> 0 AND k % 7 >= 4 AND (operator <> 'arith_minus' OR r < 2)
    UNION ALL SELECT path, 'boundary_gt', CAST(4 + i AS INTEGER), '> ', '>= ' FROM p, range(8) t(i) WHERE k % 11 <> 0 AND k % 7 >= 4 AND i < CASE r WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 5 END""")
def mutants(s: Source):
    k = F.col("p_partkey")
    tail = F.when(k % 7 == 0, ".css").when(k % 7 == 1, ".test.js").when(k % 7 == 2, ".d.ts").when(k % 7 == 3, ".JSON").otherwise(".js")
    path = F.concat(F.lit("src/"), F.when(k % 11 == 0, "vendor/").otherwise(""), F.lit("p"), k.cast("string"), tail)
    more = F.repeat(F.lit("\nx > y;"), (k % 3 * 4).cast("int"))
    body = F.concat(F.lit("function check(a, b) { if (a === "), k.cast("string"), F.lit(") {\n  if (a < b - 1) run(a <= b, a !== b || b); }\n  return true;"), more, F.lit("\n}"))
    return C.mutants(s("part").select(path.alias("path"), body.alias("text"))).select("path", "operator", "line", "before", "after")


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 3 = 2 THEN 'PASS' ELSE 'FAIL' END WHEN 1 THEN CASE WHEN event_type = 'click' THEN 'PASS' ELSE 'FAIL' END
    ELSE CASE WHEN user_id % 3 <> 0 THEN 'FAIL' WHEN event_id % 5 = 4 THEN 'INCONCLUSIVE' WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END END AS verdict FROM events""")
def evaluate_outcomes(s: Source):
    e = s("events")
    expected = F.expr("CASE event_id % 5 WHEN 0 THEN 'exits with 2' WHEN 1 THEN 'shows \"CLICK\"' ELSE 'works' END")
    output = F.expr("CASE WHEN event_id % 5 = 4 THEN '' ELSE event_type END")
    return e.select(F.col("event_id").alias("id"), C.evaluate(expected, (F.col("user_id") % 3).cast("int"), output).alias("verdict"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'auto' ELSE 'human' END AS who, count(*) AS layers, CAST(sum(user_id) AS BIGINT) AS errors FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0 GROUP BY 1")
def fixability(s: Source):
    e = s("events").select(F.col("event_type").alias("layer"), (F.col("event_id") % 3 == 0).alias("passed"), (F.col("event_id") % 7 == 0).alias("skipped"), F.col("user_id").alias("errors"))
    return C.fixability(e, ("click", "view"))


@query("""WITH RECURSIVE v AS (SELECT path, row_number() OVER (ORDER BY path) AS i FROM files), e AS (SELECT DISTINCT a.i AS s, b.i AS t FROM dependencies JOIN v a ON a.path = source_file JOIN v b ON b.path = target_file),
    r(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b), c AS (SELECT x.a AS node, min(x.b) AS root FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
    k AS (SELECT root, count(*) AS size FROM c GROUP BY root),
    x AS (SELECT 'cycle' AS kind, path AS subject, CAST(size AS DOUBLE) AS metric, CASE WHEN size > 10 THEN 'CRITICAL' WHEN size > 5 THEN 'HIGH' WHEN size > 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM k JOIN v ON v.i = k.root
    UNION ALL SELECT 'interface' AS kind, concat(file, ':', name) AS subject, CAST(consumer_count AS DOUBLE) AS metric, CASE WHEN consumer_count > 15 THEN 'CRITICAL' WHEN consumer_count > 10 THEN 'HIGH' WHEN consumer_count > 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM interfaces
    UNION ALL SELECT 'churn', file, CAST(changes_30d AS DOUBLE), CASE WHEN changes_30d > 60 THEN 'CRITICAL' WHEN changes_30d > 30 THEN 'HIGH' WHEN changes_30d > 10 THEN 'MEDIUM' ELSE 'LOW' END FROM change_frequency
    UNION ALL SELECT 'hotspot', path, complexity_score * (1 + coalesce(changes_30d, 0) * 0.1), CASE WHEN complexity_score * (1 + coalesce(changes_30d, 0) * 0.1) > 5000 THEN 'CRITICAL' WHEN complexity_score * (1 + coalesce(changes_30d, 0) * 0.1) > 2500 THEN 'HIGH' WHEN complexity_score * (1 + coalesce(changes_30d, 0) * 0.1) > 1000 THEN 'MEDIUM' ELSE 'LOW' END
      FROM files LEFT JOIN change_frequency ON file = path WHERE NOT is_test AND NOT is_config)
    SELECT kind, subject, round(metric, 4) AS metric, level FROM x""")
def risk_register(s: Source):
    edges = staged(graph.distinct_edges(s.code.edges()), "edges")
    out = C.risk_register(s.code.risk_scores(), s.code.interface_consumers(edges), graph.cycles(edges, ready=True), s("change_frequency"))
    return out.select("kind", "subject", F.round("metric", 4).alias("metric"), "level")


@query("""WITH c AS (SELECT user_id % 40 AS file, event_type AS author, ts, max(ts) OVER () AS a FROM events), p AS (SELECT file, count(CASE WHEN ts >= a - INTERVAL '7' DAY THEN 1 END) AS changes_7d, count(CASE WHEN ts >= a - INTERVAL '30' DAY THEN 1 END) AS changes_30d FROM c GROUP BY file),
    n AS (SELECT file, author, max(ts) AS ts FROM c GROUP BY file, author), t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, author) AS r FROM n)
    SELECT p.*, string_agg(t.author, ',' ORDER BY r) AS top_changers FROM p JOIN t ON t.file = p.file AND r <= 3 GROUP BY p.file, changes_7d, changes_30d""")
def commit_frequency(s: Source):
    e = s("events")
    newest = e.agg(F.max("ts").alias("anchor"))
    c = e.join(F.broadcast(newest)).select((F.col("user_id") % 40).alias("file"), F.col("event_type").alias("author"), "ts", "anchor")
    out = C.change_frequency(c, F.col("anchor"), 3)
    return out.select("file", "changes_7d", "changes_30d", F.array_join("top_changers", ",").alias("top_changers"))


@query("SELECT p_brand AS base, max(p_partkey) + 1 AS next FROM part GROUP BY p_brand")
def next_number(s: Source):
    return P.next_decimal(s("part").select(F.col("p_brand").alias("base"), F.col("p_partkey").alias("n")), "base", "n")
