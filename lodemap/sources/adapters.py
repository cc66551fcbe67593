"""The engine's relations over the driver's tables: one SQL text per relation, valid on Spark and on the oracle.

A relation names the tables and relations it reads in its FROM clauses; ``relation`` binds them as DataFrames,
``with_clause`` writes them as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS: dict[str, str] = {
    "files": """
        SELECT concat('src/', p_brand, '/p', CAST(p_partkey AS STRING), '.js') AS path, p_brand AS module, p_type AS language,
          CAST(p_size AS BIGINT) AS loc, p_retailprice AS complexity_score, p_partkey % 10 = 0 AS is_test, p_partkey % 17 = 0 AS is_config, p_partkey AS k
        FROM part""",
    "dependencies": """
        SELECT DISTINCT s.path AS source_file, t.path AS target_file, concat('m', CAST(t.k % 7 AS STRING)) AS import_name,
          CASE a.l_returnflag WHEN 'A' THEN 'named' WHEN 'N' THEN 'default' ELSE 'require' END AS import_type
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN files s ON s.k = a.l_partkey JOIN files t ON t.k = b.l_partkey WHERE a.l_partkey <> b.l_partkey""",
    "symbols": """
        SELECT p_partkey * 2 AS id, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 40 AS STRING)) AS name,
          CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'const' ELSE 'function' END AS kind,
          concat('src/', p_brand, '/p', CAST(p_partkey AS STRING), '.js') AS file, 1 AS line_start, p_size AS line_end, p_partkey % 3 <> 0 AS exported
        FROM part
        UNION ALL
        SELECT p_partkey * 2 + 1, concat('helper', CAST(p_partkey AS STRING)), 'function', concat('src/', p_brand, '/p', CAST(p_partkey AS STRING), '.js'), 2, p_size, p_partkey % 4 = 0
        FROM part""",
    "change_frequency": """
        SELECT f.path AS file, count(CASE WHEN e.ts >= e.anchor - INTERVAL '7' DAY THEN 1 END) AS changes_7d,
          count(CASE WHEN e.ts >= e.anchor - INTERVAL '30' DAY THEN 1 END) AS changes_30d, count(*) AS changes_90d, CAST(CAST(max(e.ts) AS DATE) AS STRING) AS last_changed
        FROM (SELECT user_id, ts, max(ts) OVER () AS anchor FROM events) e JOIN files f ON f.k = e.user_id GROUP BY f.path""",
    "interfaces": """
        SELECT s.id, s.name, s.file, concat('export_', s.kind) AS kind, count(DISTINCT d.source_file) AS consumer_count, concat('h', CAST(s.id % 11 AS STRING)) AS contract_hash
        FROM symbols s LEFT JOIN dependencies d ON d.target_file = s.file WHERE s.exported GROUP BY s.id, s.name, s.file, s.kind""",
    "module_dependencies": """
        SELECT s.module AS source_module, t.module AS target_module, count(*) AS edge_count
        FROM dependencies d JOIN files s ON s.path = d.source_file JOIN files t ON t.path = d.target_file WHERE s.module <> t.module GROUP BY s.module, t.module""",
    "modules": """
        SELECT module AS name, concat('src/', module) AS root_path, count(*) AS file_count, count(CASE WHEN k % 3 <> 0 THEN 1 END) AS public_api_count,
          CASE WHEN avg(loc) <= 24.5 THEN 'high' WHEN avg(loc) <= 25.5 THEN 'medium' ELSE 'low' END AS stability
        FROM files GROUP BY module""",
    "module_capabilities": """
        SELECT module AS module_name, language AS capability, floor(count(*) * 100.0 / max(total) * 3 + 0.5) / 100 AS confidence, concat(CAST(count(*) AS STRING), ' files') AS evidence
        FROM (SELECT module, language, count(*) OVER (PARTITION BY module) AS total FROM files) f GROUP BY module, language""",
    "call_graph": """
        SELECT DISTINCT s.id AS caller_symbol_id, t.name AS callee_name, a.l_linenumber AS call_site_line, t.file AS callee_file
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_quantity >= 40
        JOIN symbols s ON s.id = a.l_partkey * 2 + 1 JOIN symbols t ON t.id = b.l_partkey * 2 WHERE a.l_partkey <> b.l_partkey""",
    "class_hierarchy": """
        SELECT c.id AS child_id, p.name AS parent_name, p.file AS parent_file, CASE WHEN c.id % 3 = 0 THEN 'implements' ELSE 'extends' END AS relation
        FROM symbols c JOIN symbols p ON p.id = (c.id % 97) * 10 WHERE c.kind = 'class' AND c.id <> p.id""",
    "warnings": """
        SELECT event_id AS id, concat('Brand#', CAST(user_id % 25 + 1 AS STRING)) AS module, event_type AS warning_text,
          CASE WHEN value > 50 THEN 'critical' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity, ts AS created_at
        FROM events""",
    "services": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, concat('repo-', CAST(s_suppkey AS STRING)) AS repo, CASE WHEN s_suppkey % 7 <> 0 THEN n_name END AS team, s_suppkey AS k
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "service_interfaces": """
        SELECT concat(s.id, ':', p.p_type) AS id, s.id AS service_id, CASE p.p_type WHEN 'ECONOMY' THEN 'api' WHEN 'SMALL' THEN 'event' WHEN 'LARGE' THEN 'package' WHEN 'MEDIUM' THEN 'rpc' ELSE 'database' END AS type,
          concat(lower(p.p_type), '-', s.id) AS name, count(*) AS uses
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN services s ON s.k = l.l_suppkey GROUP BY s.id, p.p_type""",
    "service_dependencies": """
        SELECT DISTINCT c.id AS consumer_id, v.id AS provider_id, CASE WHEN a.l_linenumber % 2 = 0 THEN concat(v.id, ':', p.p_type) END AS interface_id,
          lower(a.l_returnflag) AS type, b.l_linenumber % 5 = 0 AS deprecated
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN part p ON p.p_partkey = b.l_partkey JOIN services c ON c.k = a.l_suppkey JOIN services v ON v.k = b.l_suppkey
        WHERE a.l_suppkey <> b.l_suppkey AND a.l_quantity >= 30 AND b.l_quantity >= 30""",
    "cyclic_edges": """
        SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN supplier s ON s.s_suppkey = a.l_suppkey JOIN supplier t ON t.s_suppkey = b.l_suppkey AND t.s_nationkey = s.s_nationkey
        WHERE a.l_suppkey <> b.l_suppkey""",
    "layered_edges": """
        SELECT DISTINCT src, dst FROM cyclic_edges WHERE src < dst""",
    "requirements": """
        SELECT p_partkey AS id, p_brand AS category, concat(p_name, ' ', lower(p_type), ' must handle size ', CAST(p_size % 4 AS STRING)) AS text, p_partkey AS line
        FROM part""",
    "decisions": """
        SELECT conv_id * 100 + turn AS id, role AS type, text, concat('c', CAST(conv_id % 20 AS STRING)) AS module, turn AS seq, turn % 3 <> 2 AS active
        FROM conversations""",
    "metric_units": """
        SELECT event_id AS id, event_type AS phase, concat('model-', CAST(user_id % 4 AS STRING)) AS model, value AS cost_usd, user_id AS tokens, ts AS started_at
        FROM events""",
    "snapshot_a": """
        SELECT path, module, loc, complexity_score FROM files WHERE k % 11 <> 0""",
    "snapshot_b": """
        SELECT path, module, loc + CASE WHEN k % 13 = 0 THEN 5 ELSE 0 END AS loc, CASE WHEN k % 29 = 0 THEN NULL ELSE complexity_score END AS complexity_score FROM files WHERE k % 9 <> 0""",
}


# Spark takes a window over a whole table to one task; there a relation with one says the same by an aggregate
SPARK_RELATIONS = {"change_frequency": RELATIONS["change_frequency"].replace("max(ts) OVER () AS anchor FROM events", "(SELECT max(ts) FROM events) AS anchor FROM events")}


def _reads(text: str) -> list[str]:
    return list(dict.fromkeys(n for n in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text) if n in RELATIONS or n in TABLES))


def needed(text: str) -> list[str]:
    """Relations (not tables) that a text reads, each after what it reads itself."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in RELATIONS and name not in out:
            for n in _reads(RELATIONS[name]):
                visit(n)
            out.append(name)

    for n in _reads(text):
        visit(n)
    return out


def with_clause(text: str) -> str:
    """``text`` with the relations it reads as common table expressions before it."""
    names = needed(text)
    if not names:
        return text
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text)
    head = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names)
    if recursive:
        return f"WITH {recursive[1] or ''}{head}, {text[recursive.end():]}"
    return f"WITH {head} {text}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named relation or table as a DataFrame, declared lazily over the tables' files."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_RELATIONS.get(name, RELATIONS[name])
    reads = _reads(text)
    bound = re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in reads else m[0], text)
    return spark.sql(bound, **{n: relation(spark, sf_dir, n) for n in reads})
