"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import Source, query

MODULE = "Brand#7"
TARGET_SQL = "(SELECT min(target_file) FROM dependencies)"


def _target(s: Source):
    return s("dependencies").agg(F.min("target_file").alias("root"))


@query("""SELECT path, module, complexity_score, coalesce(changes_30d, 0) AS changes_30d, complexity_score * (1 + coalesce(changes_30d, 0) * 0.1) AS risk_score
    FROM files LEFT JOIN change_frequency ON file = path WHERE NOT is_test AND NOT is_config ORDER BY risk_score DESC, path LIMIT 20""")
def hotspots(s: Source):
    return s.code.hotspots(20)


@query("""SELECT path, loc, language FROM files WHERE module = 'Brand#7' AND NOT is_test ORDER BY loc DESC, path""")
def files_filter(s: Source):
    return s.code.list_files(MODULE, is_test=False).select("path", "loc", "language")


@query("SELECT * FROM files WHERE path = (SELECT max(path) FROM files)")
def file_lookup(s: Source):
    return s("files").join(s("files").agg(F.max("path").alias("path")), "path")


@query("SELECT id, name, kind, line_start FROM symbols WHERE file = (SELECT min(path) FROM files)")
def symbols_in_file(s: Source):
    first = s("files").agg(F.min("path").alias("file"))
    return s("symbols").join(first, "file").select("id", "name", "kind", "line_start")


@query("SELECT source_file, target_file, import_name, import_type FROM dependencies d WHERE EXISTS (SELECT 1 FROM files f WHERE f.path = d.source_file AND f.module = 'Brand#7')")
def imports_of_module(s: Source):
    own = s("files").where(F.col("module") == MODULE).select(F.col("path").alias("source_file"))
    return s("dependencies").join(own, "source_file", "left_semi").select("source_file", "target_file", "import_name", "import_type")


@query(f"SELECT source_file, import_name, import_type FROM dependencies WHERE target_file = {TARGET_SQL}")
def imported_by(s: Source):
    return s("dependencies").join(_target(s), F.col("target_file") == F.col("root")).select("source_file", "import_name", "import_type")


@query("SELECT s.id, s.name, s.kind, f.module FROM symbols s JOIN files f ON s.file = f.path WHERE s.name ILIKE 'RED%' AND s.exported")
def symbol_pattern(s: Source):
    return s.code.find_symbols("RED%", exported=True).select("id", "name", "kind", "module")


@query("SELECT id, name, file FROM symbols WHERE name = 'helper12'")
def symbol_search_exact(s: Source):
    return s.code.search_symbol("helper12").select("id", "name", "file")


@query("SELECT id, name, file FROM (SELECT * FROM symbols WHERE name ILIKE '%elper19%' ORDER BY name, id LIMIT 100) x")
def symbol_search_fallback(s: Source):
    return s.code.search_symbol("elper19").select("id", "name", "file")


@query("SELECT id, name FROM symbols WHERE name ILIKE 'red_bolt%' ORDER BY name, id LIMIT 100")
def symbol_search_wildcard(s: Source):
    return s.code.search_symbol("red_bolt%").select("id", "name")


@query("SELECT module_name, capability, confidence FROM module_capabilities WHERE confidence >= 0.2")
def capabilities_list(s: Source):
    return s.code.capabilities().select("module_name", "capability", "confidence")


@query("SELECT module_name, confidence FROM module_capabilities WHERE capability = 'ECONOMY' AND confidence >= 0.2")
def capability_providers(s: Source):
    return s.code.capability_providers("ECONOMY").select("module_name", "confidence")


@query("SELECT capability, string_agg(module_name, ',' ORDER BY module_name) AS modules, max(confidence) AS max_confidence FROM module_capabilities GROUP BY capability")
def capability_map(s: Source):
    return s.code.capability_map().withColumn("modules", F.array_join("modules", ","))


@query("SELECT id, module, warning_text FROM warnings WHERE severity = 'critical' AND module = 'Brand#3' ORDER BY created_at DESC, id LIMIT 50")
def warnings_filter(s: Source):
    return s.code.list_warnings("Brand#3", "critical", 50).select("id", "module", "warning_text")


@query("SELECT file, changes_7d, changes_30d, last_changed FROM change_frequency ORDER BY changes_30d DESC, file LIMIT 20")
def high_churn(s: Source):
    return s.code.high_churn(20).select("file", "changes_7d", "changes_30d", "last_changed")


@query("SELECT id, name, consumer_count FROM interfaces ORDER BY consumer_count DESC, id LIMIT 20")
def most_used_interfaces(s: Source):
    return s.code.most_used_interfaces().select("id", "name", "consumer_count")


@query("SELECT * FROM (SELECT module, path, loc, row_number() OVER (PARTITION BY module ORDER BY loc DESC, path) AS nth FROM files) x WHERE nth <= 10")
def top_n_per_module(s: Source):
    return s.code.top_files_per_module()


@query("""SELECT m.*, c.capabilities FROM modules m LEFT JOIN
    (SELECT module_name, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities FROM module_capabilities WHERE confidence >= 0.18 GROUP BY module_name) c ON m.name = c.module_name""")
def module_listing(s: Source):
    return s.code.module_listing(0.18)


@query("""WITH api AS (SELECT name, kind, file FROM symbols y WHERE exported AND EXISTS (SELECT 1 FROM files f WHERE f.module = 'Brand#7' AND f.path = y.file))
    SELECT a.name, a.kind, n.consumer_count FROM api a LEFT JOIN (SELECT DISTINCT name, file, consumer_count FROM interfaces) n ON (n.name, n.file) = (a.name, a.file)""")
def module_api(s: Source):
    return s.code.module_api(MODULE).select("name", "kind", "consumer_count")


@query("SELECT * FROM module_dependencies")
def module_edges(s: Source):
    return s.code.module_edges()


@query("""SELECT module, count(*) AS file_count, count(CASE WHEN is_test THEN 1 END) AS test_count, avg(coalesce(changes_30d, 0)) AS avg_changes,
    CASE WHEN avg(coalesce(changes_30d, 0)) <= 1 THEN 'high' WHEN avg(coalesce(changes_30d, 0)) <= 5 THEN 'medium' ELSE 'low' END AS stability
    FROM files LEFT JOIN change_frequency ON file = path GROUP BY module""")
def module_stats(s: Source):
    return s.code.module_stats()


@query("SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS total_loc FROM files GROUP BY language")
def language_stats(s: Source):
    return s.code.language_stats()


@query("SELECT module, count(CASE WHEN loc > 40 THEN 1 END) AS long_files, avg(loc) AS avg_loc, max(loc) AS max_loc FROM files GROUP BY module")
def complexity_stats(s: Source):
    return s.code.complexity_stats()


@query("SELECT target_file, count(DISTINCT source_file) AS fan_in FROM dependencies GROUP BY target_file")
def fan_in(s: Source):
    return s.code.fan_in()


@query("""SELECT coalesce(a.n, b.n) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM
    (SELECT target_file AS n, count(DISTINCT source_file) AS fan_in FROM dependencies GROUP BY 1) a FULL JOIN
    (SELECT source_file AS n, count(DISTINCT target_file) AS fan_out FROM dependencies GROUP BY 1) b ON a.n = b.n""")
def fan_in_out(s: Source):
    return graph.degrees(s.code.edges())


@query("SELECT a.target_file AS target, count(DISTINCT b.source_file) AS sources FROM dependencies a JOIN dependencies b ON b.target_file = a.source_file GROUP BY a.target_file")
def two_hop(s: Source):
    return s.code.two_hop_sources()


@query(f"SELECT d.source_file, d.import_name, d.import_type, f.module, f.loc FROM dependencies d JOIN files f ON f.path = d.source_file WHERE d.target_file = {TARGET_SQL}")
def consumers_of_file(s: Source):
    own = s("files").select(F.col("path").alias("source_file"), "module", "loc")
    return s("dependencies").join(_target(s), F.col("target_file") == F.col("root")).join(own, "source_file").select("source_file", "import_name", "import_type", "module", "loc")


@query(f"""WITH RECURSIVE up(node, depth) AS (SELECT {TARGET_SQL}, 0 UNION SELECT d.source_file, u.depth + 1 FROM up u JOIN dependencies d ON d.target_file = u.node WHERE u.depth < 2)
    SELECT {TARGET_SQL} AS root, node, min(depth) AS depth FROM up GROUP BY node HAVING min(depth) > 0""")
def impact_set(s: Source):
    return s.code.impact(_target(s), 2)


@query(f"""WITH one AS (SELECT source_file AS node, target_file AS via FROM dependencies WHERE target_file = {TARGET_SQL}),
    two AS (SELECT d.source_file AS node, d.target_file AS via FROM dependencies d WHERE d.target_file IN (SELECT node FROM one) AND d.source_file <> {TARGET_SQL} AND d.source_file NOT IN (SELECT node FROM one))
    SELECT node, via, 1 AS depth, count(*) AS n FROM one GROUP BY node, via UNION ALL SELECT node, via, 2, count(*) FROM two GROUP BY node, via""")
def impact_rows(s: Source):
    return s.code.impact(_target(s), 2, mode="rows").groupBy("node", "via", "depth").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE down(node, depth) AS (SELECT {TARGET_SQL}, 0 UNION SELECT d.target_file, u.depth + 1 FROM down u JOIN dependencies d ON d.source_file = u.node WHERE u.depth < 2),
    near AS (SELECT node, min(depth) AS depth FROM down GROUP BY node)
    SELECT DISTINCT d.source_file AS src, d.target_file AS dst, near.depth + 1 AS depth FROM near JOIN dependencies d ON d.source_file = near.node WHERE near.depth <= 2""")
def dependency_chain(s: Source):
    return graph.dependency_chain(s.code.edges(), _target(s), 3).select("src", "dst", "depth")


@query(f"""WITH RECURSIVE up(node, depth) AS (SELECT {TARGET_SQL}, 0 UNION SELECT d.source_file, u.depth + 1 FROM up u JOIN dependencies d ON d.target_file = u.node WHERE u.depth < 2)
    SELECT DISTINCT concat(f.module, ' -> ', o.module) AS boundary FROM up JOIN files f ON f.path = up.node JOIN files o ON o.path = {TARGET_SQL} WHERE f.module <> o.module""")
def impact_boundaries(s: Source):
    return s.code.boundaries(_target(s), 2).select("boundary")


@query("""WITH hit AS (SELECT path FROM files WHERE module = 'Brand#7' AND loc >= 45),
    d AS (SELECT DISTINCT source_file, target_file FROM dependencies), own AS (SELECT * FROM d WHERE target_file IN (SELECT path FROM hit)),
    x AS (SELECT (SELECT count(*) FROM own) AS consumers,
      (SELECT count(*) FROM (SELECT DISTINCT own.target_file, d.source_file FROM own JOIN d ON d.target_file = own.source_file) q) AS transitive,
      (SELECT count(*) FROM symbols WHERE exported AND file IN (SELECT path FROM hit)) AS exported,
      (SELECT coalesce(max(CASE stability WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END), 0) FROM modules WHERE name IN (SELECT f.module FROM files f JOIN hit ON hit.path = f.path)) AS stability,
      (SELECT count(*) FROM (SELECT DISTINCT a.module AS am, b.module AS bm FROM own JOIN files a ON a.path = own.source_file JOIN files b ON b.path = own.target_file WHERE a.module <> b.module) q) AS boundaries),
    y AS (SELECT *, CASE WHEN consumers > 10 THEN 4 WHEN consumers > 5 THEN 3 WHEN consumers > 2 THEN 2 WHEN consumers > 0 THEN 1 ELSE 0 END
      + CASE WHEN transitive > 20 THEN 3 WHEN transitive > 5 THEN 2 WHEN transitive > 0 THEN 1 ELSE 0 END + stability
      + CASE WHEN boundaries > 2 THEN 2 WHEN boundaries > 0 THEN 1 ELSE 0 END + CASE WHEN exported > 5 THEN 1 ELSE 0 END AS score FROM x)
    SELECT consumers, transitive, exported, boundaries, stability, score, CASE WHEN score >= 8 THEN 'CRITICAL' WHEN score >= 5 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM y""")
def risk_assessment(s: Source):
    return s.code.risk(s("files").where("module = 'Brand#7' and loc >= 45").select("path")).drop("reasons")


@query("""WITH used AS (SELECT callee_name AS name FROM call_graph UNION SELECT import_name FROM dependencies), own AS (SELECT id, name FROM symbols WHERE kind IN ('function', 'class') AND exported = false)
    SELECT id, name FROM own o WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.name = o.name) AND NOT EXISTS (SELECT 1 FROM call_graph c WHERE c.caller_symbol_id = o.id)""")
def dead_code(s: Source):
    return s.code.detect_dead_code().select("id", "name")


@query("SELECT c.callee_name, s.name AS caller, f.module, c.call_site_line FROM call_graph c JOIN symbols s ON s.id = c.caller_symbol_id JOIN files f ON f.path = s.file WHERE c.callee_name = 'red_bolt_10'")
def callers(s: Source):
    return s.code.callers_of("red_bolt_10").select("callee_name", "caller", "module", "call_site_line")


@query("SELECT s.name AS caller, c.callee_name, c.callee_file FROM call_graph c JOIN symbols s ON s.id = c.caller_symbol_id WHERE s.name = 'helper12'")
def callees(s: Source):
    return s.code.callees_of("helper12").select("caller", "callee_name", "callee_file")


@query("""SELECT role, name, count(*) AS n FROM (SELECT 'parent' AS role, h.parent_name AS name FROM class_hierarchy h JOIN symbols c ON c.id = h.child_id WHERE c.name = 'small_ring_0'
    UNION ALL SELECT 'child', c.name FROM class_hierarchy h JOIN symbols c ON c.id = h.child_id WHERE h.parent_name = 'small_ring_0') x GROUP BY role, name""")
def class_hierarchy(s: Source):
    return s.code.hierarchy_of("small_ring_0").groupBy("role", "name").agg(F.count("*").alias("n"))


@query("SELECT source_file, target_file FROM dependencies WHERE target_file NOT IN (SELECT path FROM files WHERE NOT is_config)")
def orphan_imports(s: Source):
    kept = s("files").where("not is_config").select(F.col("path").alias("target_file"))
    return s("dependencies").join(kept, "target_file", "left_anti").select("source_file", "target_file")


@query("SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'modules', count(*) FROM modules UNION ALL SELECT 'interfaces', count(*) FROM interfaces UNION ALL SELECT 'module_dependencies', count(*) FROM module_dependencies")
def summary(s: Source):
    return s.code.summary()


@query("""SELECT e.src AS node FROM cyclic_edges e UNION SELECT dst FROM cyclic_edges""")
def graph_nodes(s: Source):
    e = s("cyclic_edges")
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


_CLOSURE = "WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM cyclic_edges UNION SELECT r.a, e.dst FROM r JOIN cyclic_edges e ON e.src = r.b), nodes AS (SELECT src AS n FROM cyclic_edges UNION SELECT dst FROM cyclic_edges)"


@query(f"{_CLOSURE} SELECT n AS node, coalesce(least(n, min(x.b)), n) AS component FROM nodes LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON q.a = p.b AND q.b = p.a) x ON x.a = n GROUP BY n")
def scc(s: Source):
    return graph.strong_components(s("cyclic_edges"))


@query(f"""{_CLOSURE}, c AS (SELECT n, coalesce(least(n, min(x.b)), n) AS component FROM nodes LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON q.a = p.b AND q.b = p.a) x ON x.a = n GROUP BY n)
    SELECT component, count(*) AS size, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS members FROM c GROUP BY component HAVING count(*) > 1""")
def cycles(s: Source):
    return graph.cycles(s("cyclic_edges")).withColumn("members", F.array_join("members", ","))


@query("""WITH RECURSIVE w(node, depth) AS (SELECT min(src), 0 FROM cyclic_edges UNION SELECT e.dst, w.depth + 1 FROM w JOIN cyclic_edges e ON e.src = w.node WHERE w.depth < 60)
    SELECT (SELECT min(src) FROM cyclic_edges) AS src, g.n AS dst, coalesce(min(w.depth), -1) AS length FROM (SELECT DISTINCT dst AS n FROM cyclic_edges) g LEFT JOIN w ON w.node = g.n GROUP BY g.n""")
def shortest_path(s: Source):
    e = s("cyclic_edges")
    first = e.agg(F.min("src")).first()[0]
    pairs = e.select(F.lit(first).cast("long").alias("src"), "dst").distinct()
    return graph.shortest_paths(e, pairs).select("src", "dst", "length")


@query("""WITH RECURSIVE w(node, layer) AS (SELECT src, 0 FROM layered_edges UNION SELECT e.dst, w.layer + 1 FROM w JOIN layered_edges e ON e.src = w.node)
    SELECT node, max(layer) AS layer FROM w GROUP BY node""")
def topo_layers(s: Source):
    return graph.topological_layers(s("layered_edges"))


@query("""SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS nth FROM cyclic_edges) x WHERE nth <= 3""")
def tree_children(s: Source):
    return graph.tree_children(s("cyclic_edges"), 3)
