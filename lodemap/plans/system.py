"""Queries over the system graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Source, query

METRICS = """m0 AS (SELECT s.id AS service_id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(f.n, 0) AS interface_count FROM services s
      LEFT JOIN (SELECT provider_id, count(DISTINCT consumer_id) AS n FROM service_dependencies GROUP BY 1) i ON i.provider_id = s.id
      LEFT JOIN (SELECT consumer_id, count(DISTINCT provider_id) AS n FROM service_dependencies GROUP BY 1) o ON o.consumer_id = s.id
      LEFT JOIN (SELECT service_id, count(*) AS n FROM service_interfaces GROUP BY 1) f ON f.service_id = s.id),
    m1 AS (SELECT *, CASE WHEN max(fan_in * fan_out) OVER () > 0 THEN CAST(fan_in * fan_out AS DOUBLE) / max(fan_in * fan_out) OVER () ELSE 0.0 END AS coupling_score FROM m0),
    m AS (SELECT *, CASE WHEN fan_in >= 10 THEN 'critical' WHEN fan_in >= 5 AND fan_out >= 3 THEN 'high' WHEN fan_in >= 3 OR coupling_score > 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM m1)"""
ROOT = "(SELECT min(id) FROM services)"
UP = f"up(node, depth) AS (SELECT {ROOT}, 0 UNION SELECT d.consumer_id, u.depth + 1 FROM up u JOIN service_dependencies d ON d.provider_id = u.node WHERE u.depth < 2)"


def _root(s: Source):
    return s("services").agg(F.min("id").alias("root"))


@query(f"WITH {METRICS} SELECT * FROM m")
def coupling_risk(s: Source):
    return s.system.metrics()


@query(f"WITH {METRICS} SELECT service_id, fan_in, coupling_score FROM m ORDER BY fan_in DESC, coupling_score DESC, service_id LIMIT 10")
def system_hotspots(s: Source):
    return s.system.hotspots().select("service_id", "fan_in", "coupling_score")


@query(f"""WITH {METRICS} SELECT 'services' AS what, count(*) AS n FROM services UNION ALL SELECT 'interfaces', count(*) FROM service_interfaces UNION ALL SELECT 'dependencies', count(*) FROM service_dependencies
    UNION ALL SELECT 'teams', count(DISTINCT team) FROM services UNION ALL SELECT concat('type:', type), count(*) FROM service_interfaces GROUP BY type UNION ALL SELECT concat('risk:', risk_level), count(*) FROM m GROUP BY risk_level""")
def system_overview(s: Source):
    return s.system.overview()


@query("SELECT i.id, i.name, s.team FROM service_interfaces i JOIN services s ON s.id = i.service_id WHERE i.type = 'api' AND (i.name ILIKE '%S1%' OR s.repo ILIKE '%S1%' OR s.id ILIKE '%S1%')")
def interface_registry(s: Source):
    return s.system.registry("api", "S1").select("id", "name", "team")


@query("SELECT d.consumer_id, d.provider_id, d.type, i.name AS interface_name, v.team AS provider_team FROM service_dependencies d LEFT JOIN service_interfaces i ON i.id = d.interface_id LEFT JOIN services v ON v.id = d.provider_id")
def service_imports(s: Source):
    return s.system.imports().select("consumer_id", "provider_id", "type", "interface_name", "provider_team")


@query("SELECT consumer_id, provider_id, type, count(*) AS weight FROM service_dependencies GROUP BY 1, 2, 3")
def service_edges(s: Source):
    return s.system.weighted_edges()


@query(f"WITH {METRICS} SELECT s.id, s.repo, s.team, m.fan_in, m.risk_level FROM services s LEFT JOIN m ON m.service_id = s.id")
def service_nodes(s: Source):
    return s.system.nodes().select("id", "repo", "team", "fan_in", "risk_level")


@query(f"WITH RECURSIVE {UP} SELECT {ROOT} AS root, node, min(depth) AS depth FROM up GROUP BY node HAVING min(depth) > 0")
def service_impact(s: Source):
    return s.system.impact(_root(s))


@query(f"""WITH RECURSIVE {UP}, hit AS (SELECT DISTINCT node FROM up WHERE node <> {ROOT}),
    t AS (SELECT coalesce(team, 'unassigned') AS team, count(*) AS services, string_agg(id, ',' ORDER BY id) AS ids FROM services JOIN hit ON hit.node = services.id GROUP BY 1)
    SELECT *, (SELECT count(*) FROM t) > 1 AS needs_coordination FROM t""")
def team_impact(s: Source):
    return s.system.team_impact(_root(s)).drop("root")


@query("SELECT team, string_agg(id, ',' ORDER BY id) AS services, count(*) AS n FROM services WHERE team IS NOT NULL GROUP BY team")
def teams(s: Source):
    return s.system.teams()


@query("SELECT provider_id AS id FROM service_dependencies WHERE consumer_id = 's1' UNION SELECT consumer_id FROM service_dependencies WHERE provider_id = 's1'")
def service_neighbours(s: Source):
    return s.system.neighbours("s1")


@query("""SELECT 'unused_service' AS "check", id AS subject FROM services WHERE id NOT IN (SELECT provider_id FROM service_dependencies UNION SELECT consumer_id FROM service_dependencies)
    UNION SELECT 'deprecated_dependency', concat(consumer_id, '->', provider_id) FROM service_dependencies WHERE deprecated
    UNION SELECT 'direct_database_access', concat(consumer_id, '->', provider_id) FROM service_dependencies WHERE interface_id IN (SELECT id FROM service_interfaces WHERE type = 'database')
    UNION SELECT 'unresolved_interface', concat(consumer_id, '->', provider_id) FROM service_dependencies WHERE interface_id IS NOT NULL AND interface_id NOT IN (SELECT id FROM service_interfaces)""")
def system_validation(s: Source):
    return s.system.validate()


@query("SELECT concat(upper(id), CASE WHEN k % 2 = 0 THEN '' ELSE '-service' END) AS name, CASE WHEN k % 2 = 0 THEN id END AS service FROM services")
def fuzzy_services(s: Source):
    name = F.concat(F.upper("id"), F.when(F.col("k") % 2 == 0, "").otherwise("-service"))
    return s.system.resolve(s("services").select(name.alias("name")))
