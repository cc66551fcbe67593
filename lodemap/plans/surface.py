"""Queries in SQL only, appends with defaults, staleness by trees of digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hash_tree, service_metrics, stores
from ..sources import manifests
from ..sql import register
from .registry import Source, query


def _session(s: Source):
    """A session of its own, so that views and functions stay apart from the caller's."""
    spark = s.spark.newSession()
    register(spark, s.sf_dir)
    return spark


_FILES = """SELECT path, 'javascript' AS language, concat('import a from "./', import_name, '";\nexport function f', target, '(x) {\n  return g(x / 2);\n}\n') AS text
    FROM (SELECT source_file AS path, import_name, CAST(count(*) AS STRING) AS target FROM dependencies GROUP BY source_file, import_name)"""


def _spread(s: Source) -> str:
    """The files dealt out over as many tasks as the session shuffles to, as table functions in Python run where their rows are."""
    return f"SELECT /*+ REPARTITION({s.spark.conf.get('spark.sql.shuffle.partitions')}) */ * FROM ({_FILES})"


@query("SELECT concat('f', n) AS name, count(*) AS files FROM (SELECT source_file, import_name, count(*) AS n FROM dependencies GROUP BY source_file, import_name) x GROUP BY n")
def sql_symbols(s: Source):
    return _session(s).sql(f"SELECT e.name, count(*) AS files FROM ({_spread(s)}) f, LATERAL extract_symbols(f.path, f.language, f.text) e WHERE e.kind = 'function' AND e.exported GROUP BY e.name")


@query("SELECT concat('./', import_name) AS target, count(DISTINCT source_file) AS files, 'g' AS callee FROM dependencies GROUP BY import_name")
def sql_imports_and_calls(s: Source):
    return _session(s).sql(f"""WITH f AS ({_spread(s)}) SELECT i.target, count(DISTINCT f.path) AS files, min(c.callee) AS callee
        FROM f, LATERAL extract_imports(f.path, f.language, f.text) i, LATERAL extract_calls(f.path, f.language, f.text) c GROUP BY i.target""")


_HOT = "SELECT f.module, count(*) AS edges, count(DISTINCT d.source_file) AS sources, sum(coalesce(c.changes_30d, 0)) AS changes FROM dependencies d JOIN files f ON f.path = d.target_file LEFT JOIN change_frequency c ON c.file = f.path GROUP BY f.module"


@query(f"SELECT module, edges, sources, CAST(changes AS BIGINT) AS changes FROM ({_HOT}) x")
def sql_module_changes(s: Source):
    return _session(s).sql(_HOT)


@query("""SELECT severity, count(*) AS n, max(id) AS last FROM (SELECT id, severity FROM warnings UNION ALL
    SELECT (SELECT max(id) FROM warnings) + row_number() OVER (ORDER BY p_partkey), CASE WHEN p_partkey % 2 = 0 THEN 'critical' ELSE 'info' END FROM part) x GROUP BY severity""")
def append_warnings(s: Source):
    new = s("part").select("p_partkey", F.col("p_brand").alias("module"), F.col("p_name").alias("warning_text"), F.when(F.col("p_partkey") % 2 == 0, "critical").alias("severity"))
    return stores.append(s("warnings"), new, "id", ["p_partkey"], severity="info").groupBy("severity").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("""SELECT phase, count(*) AS units, sum(tokens) AS tokens FROM (SELECT phase, tokens FROM metric_units UNION ALL SELECT 'unknown', CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END FROM orders) x GROUP BY phase""")
def append_units(s: Source):
    new = s("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("tokens"))
    out = stores.append(s("metric_units"), new, "id", ["o_orderkey"], phase="unknown", model="unknown", cost_usd=0.0, tokens=0)
    return out.groupBy("phase").agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"))


@query("""SELECT ledger, section, nth, text FROM (SELECT conv_id AS ledger, role AS section, CAST(1 + turn AS INTEGER) AS nth, text FROM conversations) l UNION ALL
    SELECT x.conv_id, 'user', CAST(m.last + row_number() OVER (PARTITION BY x.conv_id ORDER BY x.turn) AS INTEGER), concat('[2024-01-01 00:', lpad(CAST(x.turn AS VARCHAR), 2, '0'), '] said ', x.turn)
    FROM conversations x JOIN (SELECT conv_id, max(1 + turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id) m ON m.conv_id = x.conv_id""")
def append_ledger(s: Source):
    c = s("conversations")
    ledger = c.select(F.col("conv_id").alias("ledger"), F.col("role").alias("section"), (F.col("turn") + 1).cast("int").alias("nth"), "text")
    users = c.where("role = 'user'").select(F.col("conv_id").alias("ledger")).distinct()
    entries = c.select(F.col("conv_id").alias("ledger"), F.lit("user").alias("section"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int), 0)").alias("ts"), F.concat(F.lit("said "), F.col("turn").cast("string")).alias("text"))
    return stores.append_lines(ledger, entries.join(users, "ledger", "left_semi"), "ledger")


@query("""SELECT path, CASE WHEN k % 101 = 0 THEN 'removed' ELSE 'modified' END AS change FROM files WHERE k % 101 = 0 OR k % 97 = 0 UNION ALL SELECT concat('src/new/', k, '.js'), 'added' FROM files WHERE k % 89 = 0""")
def stale_inputs(s: Source):
    f = s("files").select("k", "path", F.sha2("path", 256).alias("hash"))
    new = f.where("k % 101 <> 0").select("path", F.when(F.col("k") % 97 == 0, "changed").otherwise(F.col("hash")).alias("hash"))
    new = new.unionByName(f.where("k % 89 = 0").select(F.concat(F.lit("src/new/"), F.col("k").cast("string"), F.lit(".js")).alias("path"), "hash"))
    return hash_tree.stale(hash_tree.hash_tree(f.select("path", "hash")), hash_tree.hash_tree(new))


_SYNC = """new AS (SELECT consumer_id, provider_id FROM service_dependencies WHERE consumer_id <> 's3' UNION ALL SELECT * FROM (VALUES ('s3', 's1'), ('s3', 's1'), ('s3', 's4'))),
    d AS (SELECT id AS service_id, (SELECT count(DISTINCT consumer_id) FROM new WHERE provider_id = id) AS fan_in, (SELECT count(DISTINCT provider_id) FROM new WHERE consumer_id = id) AS fan_out, (SELECT count(*) FROM service_interfaces i WHERE i.service_id = s.id) AS interface_count FROM services s)"""
_LEVEL = "CASE WHEN fan_in >= 10 THEN 'critical' WHEN fan_in >= 5 AND fan_out >= 3 THEN 'high' WHEN fan_in >= 3 OR coupling_score > 0.5 THEN 'medium' ELSE 'low' END AS risk_level"


def _synced(s: Source, exact: bool):
    """Service s3 with two dependencies in place of those it had."""
    old = s("service_dependencies").select("consumer_id", "provider_id")
    pairs, metrics = service_metrics.pairs_of(old), s.system.metrics()
    gone = old.where("consumer_id = 's3'").withColumn("sign", F.lit(-1))
    came = s.rows([("s3", "s1", 1), ("s3", "s1", 1), ("s3", "s4", 1)], "consumer_id string, provider_id string, sign int")
    pairs, crossings = service_metrics.changed_pairs(pairs, gone.unionByName(came))
    degrees = service_metrics.changed_degrees(metrics.select("service_id", "fan_in", "fan_out", "interface_count"), crossings)
    return service_metrics.updated(metrics, degrees, pairs, s.rows([("s3",)], "service_id string"), exact)


@query(f"""WITH {_SYNC}, m AS (SELECT id AS service_id, (SELECT count(DISTINCT consumer_id) FROM service_dependencies WHERE provider_id = id) AS fan_in, (SELECT count(DISTINCT provider_id) FROM service_dependencies WHERE consumer_id = id) AS fan_out FROM services),
    t AS (SELECT 's3' AS id UNION SELECT provider_id FROM new WHERE consumer_id = 's3' UNION SELECT consumer_id FROM new WHERE provider_id = 's3'), x AS (SELECT greatest(max(fan_in * fan_out), 1) AS most FROM m),
    r AS (SELECT CASE WHEN t.id IS NULL THEN m.service_id ELSE d.service_id END AS service_id, CASE WHEN t.id IS NULL THEN m.fan_in ELSE d.fan_in END AS fan_in, CASE WHEN t.id IS NULL THEN m.fan_out ELSE d.fan_out END AS fan_out, interface_count
      FROM d JOIN m ON m.service_id = d.service_id LEFT JOIN t ON t.id = d.service_id), q AS (SELECT r.*, fan_in * fan_out / most AS coupling_score FROM r, x)
    SELECT service_id, fan_in, fan_out, interface_count, coupling_score, {_LEVEL} FROM q""")
def affected_metrics(s: Source):
    return _synced(s, exact=False)


@query(f"WITH {_SYNC}, q AS (SELECT d.*, fan_in * fan_out / greatest((SELECT max(fan_in * fan_out) FROM d), 1) AS coupling_score FROM d) SELECT service_id, fan_in, fan_out, interface_count, coupling_score, {_LEVEL} FROM q")
def maintained_metrics(s: Source):
    return _synced(s, exact=True)


_KEY = "CAST(p_partkey AS VARCHAR)"


def _routed(s: Source):
    """Files of three web frameworks, one whose patterns are no routes, one without routes."""
    k, say = F.col("p_partkey"), lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    brand = F.regexp_replace("p_brand", "#", "")
    shapes = [
        (say("svc/", k, ".py"), say("@app.get('/api/", brand, "/items/", k, "')\nasync def a(): ...\n@router.delete(\n  \"/api/", brand, "/all\")\n")),
        (say("svc/", k, ".ts"), say("@Controller('api//", brand, "')\nclass A { @Get('') all() {} @Post('/put/", k, "') put() {} }")),
        (say("svc/", k, ".mjs"), say("router.post('/api/", brand, "/", k, "', h); app.get('no, route', h); app.options(\"/api/", brand, "\", h)")),
        (say("svc/signal", k, ".js"), say("app.get('/never', h)")),
    ]
    path, text = say("doc/", k, ".md"), say("app.get('/doc', h)")
    for r, (p, t) in enumerate(shapes):
        path, text = F.when(k % 5 == r, p).otherwise(path), F.when(k % 5 == r, t).otherwise(text)
    return s("part").select(path.alias("path"), text.alias("text"), "p_brand")


_ROUTES = f"""SELECT p_brand, replace(v.path, '?', {_KEY}) AS path, v.framework, v.method, replace(replace(v.route, '?', {_KEY}), '!', replace(p_brand, '#', '')) AS route FROM part, (VALUES (0, 'svc/?.py', 'fastapi', 'GET', '/api/!/items/?'), (0, 'svc/?.py', 'fastapi', 'DELETE', '/api/!/all'),
    (1, 'svc/?.ts', 'nest', 'GET', 'api/!/'), (1, 'svc/?.ts', 'nest', 'POST', 'api/!/put/?'), (2, 'svc/?.mjs', 'express', 'POST', '/api/!/?'), (2, 'svc/?.mjs', 'express', 'OPTIONS', '/api/!')) v(r, path, framework, method, route) WHERE p_partkey % 5 = r"""


@query(f"SELECT path, framework, method, route FROM ({_ROUTES}) x")
def routes(s: Source):
    return manifests.routes(_routed(s))


@query(f"SELECT p_brand, concat('/api/', replace(p_brand, '#', '')) AS base, count(*) AS routes FROM ({_ROUTES}) x WHERE framework <> 'nest' GROUP BY p_brand")
def base_paths(s: Source):
    files = _routed(s)
    found = manifests.routes(files).where("framework <> 'nest'").join(files.select("path", "p_brand"), "path")
    return manifests.base_paths(found, "p_brand")


@query("""SELECT concat('{', string_agg(concat('"', what, '":', n), ',' ORDER BY what), '}') AS meta FROM (SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'dependencies', count(*) FROM dependencies
    UNION ALL SELECT 'modules', count(*) FROM modules UNION ALL SELECT 'interfaces', count(*) FROM interfaces UNION ALL SELECT 'module_dependencies', count(*) FROM module_dependencies) x""")
def meta_map(s: Source):
    """All key/value rows as one map, shown as JSON."""
    return s.code.summary().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("what", "n"))))).alias("meta"))


@query("""SELECT name AS module, concat('{"module":"', name, '","files":', file_count, ',"stability":"', stability, '","links":[', coalesce((SELECT string_agg(concat('{"target":"', target_module, '","weight":', edge_count, '}'), ',' ORDER BY target_module) FROM module_dependencies d WHERE d.source_module = m.name), ''), ']}') AS payload FROM modules m""")
def module_payload(s: Source):
    """What a report of the modules shows, as one JSON text a module."""
    links = s("module_dependencies").groupBy(F.col("source_module").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("target_module").alias("target"), F.col("edge_count").alias("weight")))).alias("links"))
    none = F.array().cast(links.schema["links"].dataType)
    rows = s("modules").join(links, "name", "left").withColumn("links", F.coalesce("links", none))
    return rows.select(F.col("name").alias("module"), F.to_json(F.struct(F.col("name").alias("module"), F.col("file_count").alias("files"), "stability", "links")).alias("payload"))
