"""Queries over lookups, stores, plans and comparisons that read the tables through small views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks as C
from ..operators import code_graph as G
from ..operators import diff as D
from ..operators import planning as P
from ..operators import similarity as S
from ..operators import stores as K
from ..operators import system_graph as Y
from ..sources import tables
from .registry import Source, query

PATH = "concat('src/', p_brand, '/p', CAST(p_partkey AS STRING), '.js')"


# files, modules, interfaces
@query("""SELECT i.id, count(DISTINCT d.source_file) AS consumer_count FROM interfaces i LEFT JOIN dependencies d ON d.target_file = i.file GROUP BY i.id""")
def consumer_counts(s: Source):
    return G.consumer_counts(s("interfaces"), s("dependencies"))


@query("""WITH c AS (SELECT path FROM files WHERE k % 97 = 0)
    SELECT path FROM c UNION SELECT source_file FROM dependencies WHERE target_file IN (SELECT path FROM c) UNION SELECT target_file FROM dependencies WHERE source_file IN (SELECT path FROM c)""")
def affected_files(s: Source):
    return G.affected_files(s("dependencies"), s("files").where("k % 97 = 0"))


@query("""SELECT a.path, b.path AS test FROM files a JOIN files b ON b.module = a.module AND b.is_test WHERE a.k % 20 = 3""")
def tests_near(s: Source):
    return G.tests_near(s("files"), s("files").where("k % 20 = 3"))


@query("""SELECT path, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'public' ELSE 'internal' END AS visibility FROM
    (SELECT k, CASE WHEN k % 5 = 0 THEN concat(module, '/f', k, '.js') WHEN k % 7 = 0 THEN concat(module, '/d', k, '/index.ts') ELSE concat(module, '/d', k, '/f.js') END AS path FROM files) q""")
def visibility(s: Source):
    k = F.col("k").cast("string")
    path = F.when(F.col("k") % 5 == 0, F.concat("module", F.lit("/f"), k, F.lit(".js"))).when(F.col("k") % 7 == 0, F.concat("module", F.lit("/d"), k, F.lit("/index.ts"))).otherwise(F.concat("module", F.lit("/d"), k, F.lit("/f.js")))
    files = s("files").select(path.alias("path"), "module")
    return G.visibility(files, s("modules").select("name", F.col("name").alias("root_path")))


@query("""WITH m AS (SELECT path, module FROM files WHERE k % 40 = 1), known AS (SELECT DISTINCT module FROM m)
    SELECT 'files' AS section, count(*) AS n FROM m UNION ALL SELECT 'unknown', 1
    UNION ALL SELECT 'dependencies', count(*) FROM (SELECT DISTINCT source_file, target_file, import_name FROM dependencies WHERE source_file IN (SELECT path FROM m)) a
    UNION ALL SELECT 'consumers', count(DISTINCT source_file) FROM dependencies WHERE target_file IN (SELECT path FROM m)
    UNION ALL SELECT 'interfaces', count(*) FROM interfaces WHERE file IN (SELECT path FROM m)
    UNION ALL SELECT 'tests', count(DISTINCT source_file) FROM dependencies WHERE target_file IN (SELECT path FROM m) AND source_file IN (SELECT path FROM files WHERE is_test)
    UNION ALL SELECT 'capabilities', count(*) FROM module_capabilities WHERE module_name IN (SELECT module FROM known) UNION ALL SELECT 'risk', 1""")
def task_context(s: Source):
    paths = s("files").where("k % 40 = 1").select("path").unionByName(s.rows([("no/such.js",)], "path string"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in s.code.context(paths).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH d AS (SELECT id AS caller, concat('helper', id % 300) AS callee FROM symbols), l AS (SELECT name, max(id) AS id FROM symbols GROUP BY name)
    SELECT d.caller, d.callee, s.file AS callee_file, s.file IS NOT NULL AS resolved, CASE WHEN s.file IS NULL THEN 'unresolved' ELSE 'direct' END AS call_type
    FROM d LEFT JOIN l ON l.name = d.callee LEFT JOIN symbols s ON s.id = l.id""")
def resolve_callees(s: Source):
    calls = s("symbols").select(F.col("id").alias("caller"), F.concat(F.lit("helper"), (F.col("id") % 300).cast("string")).alias("callee"))
    return G.resolve_callees(calls, s("symbols")).select("caller", "callee", "callee_file", "resolved", "call_type")


@query("""WITH c AS (SELECT s.id AS child, p.name AS parent FROM symbols s JOIN symbols p ON p.id = (s.id * 7) % 400 WHERE s.kind = 'class')
    SELECT child, parent, (SELECT min_by(file, id) FROM symbols x WHERE x.kind = 'class' AND x.name = c.parent) AS parent_file FROM c""")
def resolve_parents(s: Source):
    p = s("symbols").select(F.col("id").alias("pid"), F.col("name").alias("parent"))
    children = s("symbols").where("kind = 'class'").select(F.col("id").alias("child"), ((F.col("id") * 7) % 400).alias("pid"))
    return G.resolve_parents(children.join(p, "pid").select("child", "parent"), s("symbols")).select("child", "parent", "parent_file")


@query("""SELECT path, coalesce(CASE WHEN k % 3 = 0 THEN concat(module, '-deep') WHEN k % 3 = 1 THEN module END, '<root>') AS module FROM
    (SELECT k, module, CASE k % 3 WHEN 0 THEN concat('lib/', module, '/inner/f', k, '.js') WHEN 1 THEN concat('lib/', module, '/f', k, '.js') ELSE concat('f', k, '.js') END AS path FROM files) q""")
def assign_modules(s: Source):
    from ..sources import source_code

    k, m = F.col("k").cast("string"), F.col("module")
    path = F.when(F.col("k") % 3 == 0, F.concat(F.lit("lib/"), m, F.lit("/inner/f"), k, F.lit(".js"))).when(F.col("k") % 3 == 1, F.concat(F.lit("lib/"), m, F.lit("/f"), k, F.lit(".js"))).otherwise(F.concat(F.lit("f"), k, F.lit(".js")))
    mods = s("modules").select("name")
    roots = mods.select("name", F.concat(F.lit("lib/"), "name").alias("root_path")).unionByName(mods.select(F.concat("name", F.lit("-deep")).alias("name"), F.concat(F.lit("lib/"), "name", F.lit("/inner")).alias("root_path")))
    return source_code.assign_modules(s("files").select(path.alias("path")), roots)


@query(f"""SELECT path, k % 4 IN (0, 2) AS is_test, k % 4 = 3 AS is_config FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat('a/tests/f', p_partkey, '.js') WHEN 1 THEN concat('a/contest/f', p_partkey, '.js')
    WHEN 2 THEN concat('a/f', p_partkey, '.spec.ts') ELSE concat('a', p_partkey, '/package.json') END AS path FROM part) q""")
def classify_files(s: Source):
    from ..sources import source_code

    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("a/tests/f"), k, F.lit(".js"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("a/contest/f"), k, F.lit(".js"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("a/f"), k, F.lit(".spec.ts"))).otherwise(F.concat(F.lit("a"), k, F.lit("/package.json")))
    return source_code.classify(s("part").select(path.alias("path")))


@query("""SELECT path FROM files WHERE starts_with(path, 'src/Brand#1/')""")
def path_prefix(s: Source):
    return s("files").where(F.col("path").startswith("src/Brand#1/")).select("path")


@query("""SELECT module, max(loc) AS loc FROM files WHERE language IS NOT NULL GROUP BY module ORDER BY loc DESC NULLS LAST, module""")
def largest_files(s: Source):
    return s("files").where("language is not null").groupBy("module").agg(F.max("loc").alias("loc")).orderBy(F.desc_nulls_last("loc"), "module")


@query("""SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, path) AS BIGINT) AS place, path, score FROM (SELECT path, complexity_score AS score FROM snapshot_b) q QUALIFY place <= 500 OR score IS NULL""")
def null_order(s: Source):
    b = s("snapshot_b").select("path", F.col("complexity_score").alias("score"))
    return b.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "path")).cast("long")).where("place <= 500 or score is null")


# services
@query("""SELECT id, repo, k FROM (SELECT id, repo, k, CASE WHEN repo = '/r/s7' THEN 0 WHEN id = 's7' THEN 1 WHEN contains(lower(repo), 's7') THEN 2 END AS rank FROM (SELECT id, CASE WHEN k % 2 = 0 THEN repo ELSE concat('/r/', id) END AS repo, k FROM services) x) y
    WHERE rank IS NOT NULL ORDER BY rank, id LIMIT 1""")
def find_service(s: Source):
    x = s("services").select("id", F.when(F.col("k") % 2 == 0, F.col("repo")).otherwise(F.concat(F.lit("/r/"), "id")).alias("repo"), "k")
    return Y.find_service(x, "/r/s7")


@query("""SELECT l_orderkey AS id, concat('t', l_partkey % 90) AS topic, CASE WHEN l_partkey % 90 < 60 THEN concat('s', max_seq) END AS provider FROM lineitem
    LEFT JOIN (SELECT l_partkey % 60 AS t, max(l_suppkey) AS max_seq FROM lineitem GROUP BY 1) x ON x.t = l_partkey % 90 WHERE l_linenumber = 1""")
def resolve_topics(s: Source):
    li = s("lineitem")
    imports = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("t"), (F.col("l_partkey") % 90).cast("string")).alias("topic"))
    exports = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("service_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 60).cast("string")).alias("name"), F.col("l_suppkey").alias("seq"))
    return Y.resolve_topics(imports, exports).select("id", "topic", "provider")


@query("""WITH o AS (SELECT DISTINCT service_id AS service, type, name FROM service_interfaces WHERE uses % 5 <> 0), n AS (SELECT DISTINCT service_id AS service, type, name FROM service_interfaces WHERE uses % 7 <> 0),
    x AS (SELECT service, 1 AS a, 0 AS r FROM (SELECT * FROM n EXCEPT SELECT * FROM o) p UNION ALL SELECT service, 0, 1 FROM (SELECT * FROM o EXCEPT SELECT * FROM n) q)
    SELECT service, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed FROM x GROUP BY service""")
def manifest_diff(s: Source):
    faces = s("service_interfaces").select(F.col("service_id").alias("service"), "type", "name", "uses")
    return Y.manifest_diff(faces.where("uses % 5 <> 0").drop("uses"), faces.where("uses % 7 <> 0").drop("uses"))


@query("""SELECT d.provider_id, count(DISTINCT consumer_id) AS consumers, count(DISTINCT team) AS teams,
    CASE WHEN count(DISTINCT consumer_id) >= 5 THEN 'critical' WHEN count(DISTINCT consumer_id) >= 3 THEN 'high' ELSE 'medium' END AS risk
    FROM service_dependencies d LEFT JOIN services s ON s.id = d.consumer_id WHERE d.provider_id IN (SELECT id FROM services WHERE k % 3 = 0) GROUP BY d.provider_id""")
def cross_repo_ripple(s: Source):
    breaking = s("services").where("k % 3 = 0").select(F.col("id").alias("provider_id"))
    return Y.ripple(breaking, s("service_dependencies"), s("services"))


@query("""SELECT id, name, CASE WHEN uses % 2 = 0 THEN 'src/a.js' ELSE 'lib/b.js' END AS source FROM service_interfaces WHERE service_id = 's3' AND ((SELECT count(*) FROM service_interfaces WHERE service_id = 's3' AND uses % 2 = 0) = 0 OR uses % 2 = 0)""")
def task_interfaces(s: Source):
    source = F.when(F.col("uses") % 2 == 0, "src/a.js").otherwise("lib/b.js")
    faces = s("service_interfaces").withColumn("endpoints", F.array(F.struct(source.alias("source"))))
    return Y.task_interfaces(faces, "s3", ["src/a.js"]).select("id", "name", F.col("endpoints")[0]["source"].alias("source"))


# stores
@query("""SELECT id FROM decisions WHERE active AND (module = 'c3' OR id % 10 = 0 OR (id % 4 = 1 AND id % 6 = 1) OR (id % 4 = 2 AND id % 6 IN (1, 3)))""")
def decisions_for_agent(s: Source):
    d = s("decisions")
    scope = F.when(F.col("id") % 10 == 0, "global").when(F.col("id") % 4 == 2, "phase").otherwise("module")
    tags = d.select(F.col("id").alias("decision_id"), F.when((F.col("id") % 6 == 1) & (F.col("id") % 4 == 1), "Auth").when((F.col("id") % 6 == 1) | (F.col("id") % 6 == 3), "p7").alias("tag")).where("tag is not null")
    return K.decisions_for(d.withColumn("scope", scope), tags, "P7", ["C3"], ["auth"]).select("id")


@query("""SELECT conv_id * 100 + turn AS id FROM conversations WHERE conv_id % 6 = 0 OR conv_id % 4 IN (1, 2) OR strpos(text, 'the ') > 0""")
def relevant_knowledge(s: Source):
    c = s("conversations")
    mods = F.when(F.col("conv_id") % 4 == 1, F.array(F.lit("m1"), F.lit("m2"))).when(F.col("conv_id") % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("m9")))
    store = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", mods.alias("modules"), F.when(F.col("conv_id") % 6 == 0, "high").otherwise("low").alias("relevance"))
    return K.relevant_knowledge(store, ["m1"], ["the ", "zz"]).select("id")


@query("""WITH a AS (SELECT event_id AS id, ts AS created, 'old' AS said FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, ts, 'new' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0)
    SELECT id, said FROM a ORDER BY created DESC, id DESC LIMIT 200""")
def add_knowledge(s: Source):
    e = s("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"))
    return K.add_knowledge(e.where("id % 3 = 0").withColumn("said", F.lit("old")), e.where("id % 2 = 0").withColumn("said", F.lit("new"))).select("id", "said")


@query("""SELECT conv_id * 100 + turn AS id FROM conversations WHERE role = 'user' OR strpos(lower(text), 'service') > 0 OR turn % 9 = 0""")
def session_context(s: Source):
    c = s("conversations")
    lines = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("role") == "user", "Decisions").otherwise("Log").alias("section"), F.when(F.col("turn") % 9 == 0, "critical").alias("severity"), "text")
    return K.session_context(lines, ["Service"]).select("id")


@query("SELECT conv_id % 30 AS ledger, role AS section, count(*) AS n, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1, 2")
def ledger_counts(s: Source):
    lines = s("conversations").select((F.col("conv_id") % 30).alias("ledger"), F.col("role").alias("section"), "text")
    return K.ledger_counts(lines, "ledger").withColumn("tokens", F.col("tokens").cast("long"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def recent_syncs(s: Source):
    return K.recent(s("events"), "event_id").select("event_id", "event_type")


# plans
@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Untitled' ELSE concat('Title ', item_id) END AS title, CASE WHEN item_id % 2 = 0 THEN 'ui' ELSE 'general' END AS area, '2024-01-01' AS created FROM benchmark""")
def list_todos(s: Source):
    b, k = s("benchmark"), F.col("item_id")
    text = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("title: Title "), k.cast("string"), F.lit("\n"))), F.when(k % 2 == 0, "area:   ui  \n").otherwise(""), F.lit("created: 2024-01-01\n\nbody"))
    return P.todos(b.select("item_id", text.alias("text")), "item_id")


@query("""SELECT name, CAST(row_number() OVER (ORDER BY CAST(split_part(name, '-', 1) AS DOUBLE), name) AS BIGINT) AS place FROM (SELECT DISTINCT concat(o_custkey % 12, CASE WHEN o_custkey % 5 = 0 THEN '.2' ELSE '' END, '-phase') AS name FROM orders) q""")
def list_phases(s: Source):
    k = F.col("o_custkey")
    name = F.concat((k % 12).cast("string"), F.when(k % 5 == 0, ".2").otherwise(""), F.lit("-phase"))
    phases = P.list_phases(s("orders").select(name.alias("name")).distinct())
    return phases.withColumn("place", F.row_number().over(Window.orderBy(P.phase_number(F.col("name")), "name")).cast("long"))


@query("""WITH p AS (SELECT o_custkey % 150 AS phase, o_orderstatus = 'F' AS d FROM orders), a AS (SELECT phase, count(*) AS plans, count_if(d) AS done FROM p GROUP BY phase)
    SELECT r.phase, coalesce(plans, 0) AS plans, CASE WHEN plans IS NULL THEN 'empty' WHEN done = 0 THEN 'pending' WHEN done < plans THEN 'in_progress' ELSE 'complete' END AS status, CAST(coalesce(floor(100.0 * done / plans + 0.5), 0) AS BIGINT) AS percent
    FROM (SELECT DISTINCT o_custkey % 200 AS phase FROM orders) r LEFT JOIN a ON a.phase = r.phase""")
def roadmap(s: Source):
    o = s("orders")
    plans = o.select((F.col("o_custkey") % 150).alias("phase"), (F.col("o_orderstatus") == "F").alias("has_summary"))
    return P.roadmap(o.select((F.col("o_custkey") % 200).alias("phase")).distinct(), plans)


@query("""SELECT lpad(CAST(n AS VARCHAR), 2, '0') AS phase, CASE WHEN n % 2 = 0 THEN 'not_on_disk' ELSE 'not_in_roadmap' END AS finding FROM (SELECT DISTINCT o_custkey % 30 AS n FROM orders) q WHERE (n % 2 = 0) <> (n % 3 = 0) AND (n % 2 = 0 OR n % 3 = 0)""")
def roadmap_vs_disk(s: Source):
    n = s("orders").select((F.col("o_custkey") % 30).alias("n")).distinct()
    found = n.where("n % 3 = 0").select(F.lpad(F.col("n").cast("string"), 2, "0").alias("phase"))
    return P.roadmap_vs_disk(n.where("n % 2 = 0").select(F.col("n").cast("string").alias("phase")), found)


@query(f"""SELECT p_partkey AS k, {PATH} AS path, p_partkey % 2 = 0 AS found FROM part UNION ALL SELECT p_partkey, 'docs/guide.md', false FROM part""")
def plan_references(s: Source):
    p = s("part")
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "#"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".js"))
    docs = p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("see `src/x/p"), F.col("p_partkey").cast("string"), F.lit(".js` and\n@docs/guide.md or `word` again `src/x/p"), F.col("p_partkey").cast("string"), F.lit(".js`")).alias("text"))
    out = P.references(docs, p.where("p_partkey % 2 = 0").select(F.concat(F.lit("src/x/p"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("path")), "k")
    named = p.select(F.col("p_partkey").alias("_k"), path.alias("_path"))
    return out.join(named, F.col("k") == F.col("_k")).select("k", F.when(F.col("path") == "docs/guide.md", F.col("path")).otherwise(F.col("_path")).alias("path"), "found")


@query("""SELECT item_id, v.value FROM benchmark, (VALUES ('react'), ('node.js'), ('c++')) v(value) WHERE item_id % 2 = 0 OR v.value <> 'react'""")
def plan_signals(s: Source):
    b = s("benchmark")
    text = F.concat(F.lit("Use Node.js, C++"), F.when(F.col("item_id") % 2 == 0, " and React").otherwise(" and reactive"), F.lit(" "), F.lit("parts"))
    return P.plan_signals(b.select("item_id", text.alias("text")), s.rows([("React",), ("node.js",), ("C++",)], "value string"), "item_id")


@query("""SELECT item_id, concat('Opening', chr(10), CASE WHEN item_id % 2 = 0 THEN concat('### Web', chr(10), 'react parts', chr(10)) ELSE '' END) AS body FROM benchmark""")
def prune_sections(s: Source):
    b = s("benchmark")
    text = F.concat(F.lit("Opening\n### Web\n"), F.when(F.col("item_id") % 2 == 0, "react parts\n").otherwise("other parts\n"), F.lit("### Data\nsql"))
    return b.select("item_id", P.prune_sections(text, ["React"]).alias("body"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'standard' ELSE 'complex' END AS size FROM benchmark""")
def template_size(s: Source):
    k = F.col("item_id") % 3
    text = F.when(k == 0, "### Task 1\n`a.js`").when(k == 1, "### Task 1\n### Task 2\n### Task 3\n`a.js` `b.js`").otherwise("### Task 1\nOne Decision to take")
    return s("benchmark").select("item_id", P.template_size(text).alias("size"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS kept FROM (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, max(n) OVER (PARTITION BY conv_id) AS most, sum(n) OVER (PARTITION BY conv_id) AS every FROM c) q WHERE every <= 1000 GROUP BY conv_id""")
def fill_budget(s: Source):
    c = s("conversations").select("conv_id", "turn", F.length("text").alias("n"))
    fits = c.groupBy("conv_id").agg(F.sum("n").alias("every")).where("every <= 1000").select("conv_id")
    return P.fill_budget(c, "conv_id", "turn", "n", 1000).join(fits, "conv_id").groupBy("conv_id").agg(F.count("*").alias("kept"))


@query(f"""WITH f AS (SELECT p_brand AS module, CASE p_partkey % 5 WHEN 0 THEN 'schema' WHEN 1 THEN 'test' WHEN 2 THEN 'config' WHEN 3 THEN 'migration' ELSE 'implementation' END AS concern, p_size * 100 AS tokens FROM part)
    SELECT 'module' AS strategy, module AS label, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files, CAST(NULL AS BIGINT) AS place FROM f GROUP BY module
    UNION ALL SELECT 'concern', concern, CAST(sum(tokens) AS BIGINT), count(*), CASE concern WHEN 'schema' THEN 0 WHEN 'migration' THEN 1 WHEN 'implementation' THEN 2 WHEN 'test' THEN 3 ELSE 4 END FROM f GROUP BY concern""")
def file_groups(s: Source):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, "/schema.sql").when(k == 1, "/a.test.js").when(k == 2, "/app.yaml").when(k == 3, "/migration_1.js").otherwise("/main.js")
    files = s("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), tail).alias("path"), F.col("p_brand").alias("module"), (F.col("p_size") * 100).alias("tokens"))
    return P.file_groups(files, "module").unionByName(P.file_groups(files, "concern"))


# comparisons
@query("""WITH b AS (SELECT module, count(*) * 0.01 AS d, avg(loc) / 100 AS i FROM files WHERE k % 2 = 0 GROUP BY module), n AS (SELECT module, count(*) * 0.02 AS d, avg(loc) / 90 AS i FROM files GROUP BY module),
    x AS (SELECT n.module, b.module IS NULL AS fresh, floor((n.d - b.d) * 10000 + 0.5) / 10000 AS dd, floor((n.i - b.i) * 10000 + 0.5) / 10000 AS di FROM n LEFT JOIN b ON b.module = n.module)
    SELECT module, CASE WHEN fresh THEN 'new' WHEN (dd > 0.05) AND (di > 0.05) THEN 'degraded' WHEN dd > 0.05 OR di > 0.05 THEN 'mixed' ELSE 'improved' END AS status FROM x""")
def compare_entropy(s: Source):
    f = s("files")
    table = lambda df, a, b: df.groupBy("module").agg((F.count("*") * a).alias("distance"), (F.avg("loc") / b).alias("instability"), F.lit(1.0).alias("cohesion"))
    return D.compare_entropy(table(f.where("k % 2 = 0"), 0.01, 100), table(f, 0.02, 90)).select("module", "status")


@query("""SELECT count(*) AS n, count_if(p_size <= 5) AS green, count_if(p_size > 5 AND p_size <= 12) AS yellow, count_if(p_size > 12) AS red FROM part""")
def drift_total(s: Source):
    drift = F.col("p_size") / 50
    d = s("part").select(drift.alias("drift"), D.drift_level(drift).alias("level"))
    return D.drift_total(d).select((F.col("green") + F.col("yellow") + F.col("red")).alias("n"), "green", "yellow", "red")


@query("""SELECT item_id, v.verdict FROM benchmark, (VALUES (0, 'VERIFIED'), (1, 'PARTIAL'), (1, 'FAILED')) v(r, verdict) WHERE item_id % 2 = r""")
def verdicts_in(s: Source):
    text = F.when(F.col("item_id") % 2 == 0, "AUTH-1: VERIFIED, not UNVERIFIED").otherwise("PARTIAL then FAILED")
    return D.verdicts_in(s("benchmark").select("item_id", text.alias("text")), "item_id")


@query("""SELECT id, 'removed' AS change, CAST(NULL AS VARCHAR) AS changed FROM requirements WHERE id % 5 = 0 AND id % 7 <> 0 UNION ALL SELECT id, 'added', NULL FROM requirements WHERE id % 7 = 0 AND id % 5 <> 0
    UNION ALL SELECT id, 'modified', 'text' FROM requirements WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 3 = 0""")
def requirement_changes(s: Source):
    r = s("requirements").select("id", "text", "category")
    new = r.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return D.requirement_changes(r.where("id % 7 <> 0"), new)


@query("""SELECT type, name, 'removed_interface' AS finding FROM service_interfaces WHERE uses % 4 = 0 UNION ALL SELECT type, name, 'protocol_change' FROM service_interfaces WHERE uses % 4 <> 0 AND uses % 3 = 0
    UNION ALL SELECT type, name, 'removed_endpoint:/b' FROM service_interfaces WHERE uses % 4 = 2""")
def backward_compatibility(s: Source):
    f = s("service_interfaces").select("type", "name", "uses")
    old = f.select("type", "name", F.lit("http").alias("protocol"), F.array(F.lit("/a"), F.lit("/b")).alias("routes"))
    routes = F.when(F.col("uses") % 4 == 2, F.array(F.lit("/a"))).otherwise(F.array(F.lit("/b"), F.lit("/a"), F.lit("/c")))
    new = f.where("uses % 4 <> 0").select("type", "name", F.when(F.col("uses") % 3 == 0, "grpc").otherwise("http").alias("protocol"), routes.alias("routes"))
    return D.compatibility(old, new)


@query("""WITH i AS (SELECT * FROM interfaces ORDER BY consumer_count DESC, name, file LIMIT 200), f AS (SELECT * FROM files ORDER BY complexity_score DESC, path LIMIT 100)
    SELECT 'interfaces' AS section, concat(name, ' ', file) AS subject FROM i UNION ALL SELECT 'hotspots', path FROM f
    UNION ALL SELECT 'capabilities', concat(module_name, ' ', capability) FROM module_capabilities UNION ALL SELECT 'languages', concat(language, ' ', count(*), ' ', sum(loc)) FROM files WHERE language IS NOT NULL GROUP BY language""")
def snapshot_data(s: Source):
    got = D.snapshot(s("files"), s("interfaces"), s("module_capabilities"))
    say = {"interfaces": F.concat_ws(" ", "name", "file"), "hotspots": F.col("path"), "capabilities": F.concat_ws(" ", "module_name", "capability"), "languages": F.concat_ws(" ", "language", F.col("files").cast("string"), F.col("loc").cast("string"))}
    parts = [got[n].select(F.lit(n).alias("section"), e.alias("subject")) for n, e in say.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH o AS (SELECT language, count(*) AS n, sum(loc) AS l FROM files WHERE k % 11 <> 0 GROUP BY language), n AS (SELECT language, count(*) AS n, sum(loc) AS l FROM files WHERE language <> 'ECONOMY' GROUP BY language)
    SELECT coalesce(o.language, n.language) AS language, CASE WHEN o.language IS NULL THEN 'added' WHEN n.language IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.language = n.language
    WHERE o.language IS NULL OR n.language IS NULL OR o.n <> n.n OR o.l <> n.l""")
def snapshot_against_latest(s: Source):
    f = s("files")
    old = D.snapshot(f.where("k % 11 <> 0"), s("interfaces"), s("module_capabilities"))
    new = D.snapshot(f.where("language <> 'ECONOMY'"), s("interfaces"), s("module_capabilities"))
    return D.snapshot_diff(old, new)["languages"].select("language", "change")


@query("""WITH m AS (SELECT a.name, a.file_count AS x, b.file_count AS y FROM (SELECT module AS name, count(*) AS file_count FROM snapshot_a GROUP BY 1) a JOIN (SELECT module AS name, count(*) AS file_count FROM snapshot_b GROUP BY 1) b ON a.name = b.name)
    SELECT 'files' AS section, path AS subject, 'added' AS change, CAST(NULL AS VARCHAR) AS changed FROM snapshot_b WHERE path NOT IN (SELECT path FROM snapshot_a) UNION ALL SELECT 'files', path, 'removed', NULL FROM snapshot_a WHERE path NOT IN (SELECT path FROM snapshot_b)
    UNION ALL SELECT 'files', path, 'modified', concat_ws(',', CASE WHEN a.loc <> b.loc THEN 'loc' END, CASE WHEN a.complexity_score IS DISTINCT FROM b.complexity_score THEN 'complexity_score' END) FROM snapshot_a a JOIN snapshot_b b USING (path) WHERE a.loc <> b.loc OR a.complexity_score IS DISTINCT FROM b.complexity_score
    UNION ALL SELECT DISTINCT 'symbols', concat(file, '::', name), 'removed', NULL FROM symbols WHERE exported AND id % 5 = 0
    UNION ALL SELECT 'modules', name, 'modified', 'file_count' FROM m WHERE x <> y
    UNION ALL SELECT 'interfaces', concat(file, '::', name), 'modified', 'contract_hash' FROM interfaces WHERE id % 11 = 0 AND id % 5 <> 0 UNION ALL SELECT 'interfaces', concat(file, '::', name), 'removed', NULL FROM interfaces WHERE id % 5 = 0""")
def graph_changes(s: Source):
    mods = lambda f: f.groupBy(F.col("module").alias("name")).agg(F.count("*").alias("file_count")).withColumn("stability", F.lit("high"))
    base = {"files": s("snapshot_a"), "symbols": s("symbols"), "modules": mods(s("snapshot_a")), "interfaces": s("interfaces")}
    faces = s("interfaces").where("id % 5 <> 0").withColumn("contract_hash", F.when(F.col("id") % 11 == 0, "changed").otherwise(F.col("contract_hash")))
    now = {"files": s("snapshot_b"), "symbols": s("symbols").where("id % 5 <> 0"), "modules": mods(s("snapshot_b")), "interfaces": faces}
    return D.graph_changes(base, now)


@query("""SELECT p_brand AS module, count(*) AS total, CASE CAST(substr(p_brand, 7) AS INTEGER) % 4 WHEN 0 THEN 'camelCase' WHEN 1 THEN 'snake_case' WHEN 2 THEN 'PascalCase' ELSE 'mixed' END AS style FROM part GROUP BY p_brand""")
def naming_styles(s: Source):
    n = F.expr("cast(substring(p_brand, 7) as int)")
    words = F.split(F.regexp_replace("p_name", "[^a-z ]", ""), " ")
    a, b = F.lower(words[0]), F.lower(words[1])
    even = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) % 2 == 0
    camel, snake, pascal = F.concat(a, F.initcap(b)), F.concat_ws("_", a, b), F.concat(F.initcap(a), F.initcap(b))
    name = F.when(n % 4 == 0, camel).when(n % 4 == 1, snake).when(n % 4 == 2, pascal).otherwise(F.when(even, camel).otherwise(snake))
    symbols = s("part").select(F.col("p_brand").alias("module"), name.alias("name"), F.lit(True).alias("exported"), F.lit("function").alias("kind"))
    return S.naming_conventions(symbols, "module").select("module", "total", "style")


@query("""WITH w AS (SELECT id, category, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS w FROM requirements), f AS (SELECT min_by(category, id) AS category, min(id) AS id, w FROM w GROUP BY w)
    SELECT a.id AS a, b.id AS b, CASE WHEN a.category = b.category THEN 'potential_duplicate' ELSE 'overlapping_scope' END AS kind FROM f a JOIN f b ON a.id < b.id
    WHERE len(list_intersect(a.w, b.w)) > CASE WHEN a.category = b.category THEN 0.8 ELSE 0.6 END * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def overlapping_scope(s: Source):
    r = s("requirements")
    pairs = S.similar_pairs(r.select("id", T.word_set(F.col("text")).alias("t")), "id", "t", 0.6)
    return S.overlapping_scope(pairs, r.select("id", "category")).select("a", "b", "kind")


@query("""WITH m AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mongodb' WHEN 2 THEN 'session-cookie' ELSE 'jwt' END AS tech, CASE WHEN p_partkey % 4 < 2 THEN 'database' ELSE 'auth' END AS grp FROM part WHERE p_partkey % 5 <> 0),
    f AS (SELECT grp, tech, min(id) AS id FROM m GROUP BY grp, tech)
    SELECT x.grp, x.tech AS tech_a, y.tech AS tech_b, x.id AS a, y.id AS b, CASE WHEN x.grp = 'database' THEN 'blocker' ELSE 'warning' END AS severity FROM f x JOIN f y ON x.grp = y.grp AND x.tech < y.tech""")
def tech_conflicts(s: Source):
    k = F.col("p_partkey")
    word = F.when(k % 4 == 0, "PostgreSQL").when(k % 4 == 1, "MongoDB").when(k % 4 == 2, "a session cookie").otherwise("JWT")
    text = F.when(k % 5 == 0, F.concat(F.lit("restful"), word.substr(1, 3), F.lit("x"))).otherwise(F.concat(F.lit("Store it with "), word, F.lit(".")))
    return S.tech_conflicts(S.tech_mentions(s("part").select(k.alias("id"), text.alias("text")), "id", "text"), "id").select("grp", "tech_a", "tech_b", "a", "b", "severity")


@query("""SELECT id, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(list_distinct(list_concat(a, b))), 1) AS similarity FROM
    (SELECT p_partkey AS id, list_distinct(regexp_split_to_array(p_name, ' ')) AS a, list_distinct([lower(p_type), split_part(p_name, ' ', 1)]) AS b FROM part) q""")
def keyword_jaccard(s: Source):
    p = s("part")
    a = T.keyword_set(F.concat(F.lit("The "), F.col("p_name"), F.lit(" must")), T.REQUIREMENT_STOP_WORDS)
    b = T.keyword_set(F.concat(F.lower("p_type"), F.lit(" for a "), F.substring_index("p_name", " ", 1)), T.REQUIREMENT_STOP_WORDS)
    return p.select(F.col("p_partkey").alias("id"), T.jaccard(a, b, 0.0).alias("similarity"))


# checks
@query("""SELECT p_partkey AS source, p_partkey % 3 = 0 AS found FROM part UNION ALL SELECT -1, false""")
def key_links(s: Source):
    p = s("part").select(F.col("p_partkey").alias("source"))
    links = p.unionByName(s.rows([(-1,)], "source long")).withColumn("pattern", F.lit("fetch('/api')"))
    files = p.select(F.col("source").alias("path"), F.when(F.col("source") % 3 == 0, "x = fetch('/api');").otherwise("x = fetch('/apis');").alias("text"))
    return C.key_links(links, files).select("source", "found")


@query("""SELECT event_type AS what, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') >= 30 * 3600 AS stale FROM events GROUP BY 1""")
def freshness(s: Source):
    stamps = s("events").select(F.col("event_type").alias("what"), "ts")
    return C.freshness(stamps, F.lit("2024-02-01 00:00:00").cast("timestamp"), F.lit(30.0)).select("what", "stale")


@query("""SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity FROM events""")
def accessibility_severity(s: Source):
    k = F.col("user_id") % 4
    impact = F.when(k == 0, "critical").when(k == 1, "serious").when(k == 2, "moderate").otherwise("minor")
    return s("events").select(F.col("event_id").alias("id"), C.severity_of(impact).alias("severity"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN floor(1.0 / length(p_name) * 10000 + 0.5) / 10000 ELSE 1.0 END AS ratio FROM part""")
def byte_diff(s: Source):
    k, n = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(F.lit("#"), F.expr("substring(p_name, 2)"))).otherwise("")
    return C.byte_diff(s("part").select(k.cast("string").alias("key"), n.cast("binary").alias("a"), other.cast("binary").alias("b")))


@query("""SELECT event_type AS layer, user_id % 5 AS input, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '120' SECOND AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1, 2""")
def cached_results(s: Source):
    e = s("events").select(F.col("event_type").alias("layer"), (F.col("user_id") % 5).alias("input"), "ts", F.col("value").alias("result"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    every = e.where(F.col("ts") <= now).select("layer", "input").distinct()
    kept = C.cached(e, ["layer", "input"], "ts", now).select("layer", "input", F.lit(True).alias("fresh"))
    return every.join(kept, ["layer", "input"], "left").select("layer", "input", F.coalesce("fresh", F.lit(False)).alias("fresh"))


# tables
@query("""SELECT path, loc FROM (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS path, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS loc FROM part) q WHERE k % 9 <> 0""")
def write_database(s: Source):
    import uuid

    p = s("part")
    path = f"{tables.shared_folder(s.spark)}/store-{uuid.uuid4().hex}"
    t = p.select("p_partkey", F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("loc"))
    tables.overwrite(t.select("path", "loc"), path)
    held = s.spark.read.parquet(path)
    fresh = t.where("p_partkey % 4 = 0").select("path", (F.col("loc") + 1).alias("loc"))
    gone = t.where("p_partkey % 9 = 0").select("path")
    tables.overwrite(tables.upsert(held, fresh, ["path"]).join(gone, "path", "left_anti"), path)
    return s.spark.read.parquet(path)


@query("""SELECT snapshot, count(*) AS n FROM (SELECT concat('2024-01-', lpad(CAST(i AS VARCHAR), 2, '0')) AS snapshot FROM range(3, 23) t(i), region) q GROUP BY snapshot""")
def snapshot_ring(s: Source):
    import uuid

    path = f"{tables.shared_folder(s.spark)}/ring-{uuid.uuid4().hex}"
    for i in range(1, 23):
        tables.save_snapshot(s("region").coalesce(1), path, f"2024-01-{i:02d}")
    return s.spark.read.option("basePath", path).parquet(path).select(F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot")).groupBy("snapshot").agg(F.count("*").alias("n"))
