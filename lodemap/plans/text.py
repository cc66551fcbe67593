"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capabilities
from ..operators import similarity as S
from ..sources import markdown, source_code
from .registry import Source, query

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)"


@query(f"""WITH t AS (SELECT unnest({WORDS}) AS word FROM benchmark), p AS (SELECT list_zip(w[:-2], w[2:]) AS z FROM (SELECT {WORDS} AS w FROM benchmark) q WHERE len(w) > 1),
    u AS (SELECT z1[1] AS a, z1[2] AS b FROM (SELECT unnest(z) AS z1 FROM p) q),
    c AS (SELECT word FROM t WHERE length(word) >= 3 AND word NOT IN ({STOP}) UNION ALL SELECT concat(a, ' ', b) FROM u WHERE a NOT IN ({STOP}) AND b NOT IN ({STOP}))
    SELECT word, count(*) AS n FROM c GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def keyword_tf(s: Source):
    per = S.keywords(s("benchmark"), "item_id", "text")
    return per.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(20)


_SETS = "s AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))) AS t FROM requirements), k AS (SELECT t, min(id) AS id FROM s WHERE len(t) > 0 GROUP BY t)"


def _word_sets(s: Source):
    return s("requirements").select("id", T.word_set(F.col("text")).alias("t"))


@query(f"""WITH {_SETS} SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS similarity
    FROM k a JOIN k b ON a.id < b.id AND len(list_intersect(a.t, b.t)) >= 0.75 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))""")
def jaccard_pairs(s: Source):
    return S.similar_pairs(_word_sets(s), "id", "t", 0.75)


@query(f"WITH {_SETS}, m AS (SELECT id, min(id) OVER (PARTITION BY t) AS class_id FROM s) SELECT id, class_id FROM m")
def jaccard_classes(s: Source):
    return S.class_members(_word_sets(s), "id", "t")


_COLOURS = {"colour": ["red", "blue", "green"], "database": ["ring", "bolt", "widget"]}


@query("""WITH m AS (SELECT id, grp, tech FROM requirements, (VALUES ('colour', 'red'), ('colour', 'blue'), ('colour', 'green'), ('database', 'ring'), ('database', 'bolt'), ('database', 'widget')) v(grp, tech)
    WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || tech || '($|[^a-z0-9])')), f AS (SELECT grp, tech, min(id) AS id, count(*) AS n FROM m GROUP BY grp, tech)
    SELECT x.grp, x.tech AS tech_a, y.tech AS tech_b, x.id AS a, y.id AS b, x.n AS rows_a, y.n AS rows_b, CASE WHEN x.grp = 'database' THEN 'blocker' ELSE 'warning' END AS severity
    FROM f x JOIN f y ON x.grp = y.grp AND x.tech < y.tech""")
def conflict_groups(s: Source):
    return S.tech_conflicts(S.tech_mentions(s("requirements"), "id", "text", _COLOURS), "id")


@query("""WITH sig(capability, signal) AS (VALUES ('fasteners', 'bolt'), ('fasteners', 'ring'), ('gadgets', 'widget'), ('gadgets', 'ring'), ('paint', 'red'), ('paint', 'blue'), ('paint', 'small')),
    u AS (SELECT signal, count(DISTINCT capability) AS used FROM sig GROUP BY signal), t AS (SELECT capability, count(*) AS total FROM sig GROUP BY capability),
    h AS (SELECT DISTINCT p_brand AS module, signal FROM part JOIN u ON contains(p_name, signal)),
    g AS (SELECT module, capability, least(sum(CASE used WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END) / max(total), 1.0) * 4 AS points
      FROM h JOIN sig USING (signal) JOIN u USING (signal) JOIN t USING (capability) GROUP BY module, capability)
    SELECT module, capability, floor(points / 4.0 * 100 + 0.5) / 100 AS confidence FROM g WHERE floor(points / 4.0 * 100 + 0.5) / 100 >= 0.1""")
def capability_scores(s: Source):
    rows = [("fasteners", "bolt"), ("fasteners", "ring"), ("gadgets", "widget"), ("gadgets", "ring"), ("paint", "red"), ("paint", "blue"), ("paint", "small")]
    signals = s.rows([(c, "content", x) for c, x in rows], "capability string, kind string, signal string")
    hits = capabilities.content_hits(s("part"), ["p_brand"], sorted({x for _, x in rows}), "p_name").distinct()
    hits = hits.select(F.col("p_brand").alias("module"), F.lit("content").alias("kind"), "signal")
    return S.capability_scores(signals, hits.withColumn("n", F.lit(1)))


_CUSTOM = """
fasteners:
  signals:
    - "bolt"
    - 'ring'
  filePatterns:
    - p1\\d*[.]js
    - "([unbalanced"
  importPatterns:
    - m[0-2]$
  symbolPatterns:
    - HELPER1
  weight: 0.9
paint:
  signals:
    - red
    - blue
    - no such words
caching:
  signals:
    - widget
  weight: 0.5
"""


@query("""WITH p AS (SELECT p_brand AS module, count(*) AS paths, count(CASE WHEN regexp_matches(path, 'p1[0-9]*[.]js') THEN 1 END) AS nf FROM part JOIN files ON k = p_partkey GROUP BY p_brand),
    i AS (SELECT module, count(*) AS n FROM dependencies JOIN files ON path = source_file WHERE import_name IN ('m0', 'm1', 'm2') GROUP BY module),
    y AS (SELECT module, count(*) AS n FROM symbols s JOIN files f ON f.path = s.file WHERE contains(s.name, 'helper1') GROUP BY module),
    w(capability, signal, nth) AS (VALUES ('fasteners', 'bolt', 0), ('fasteners', 'ring', 1), ('paint', 'red', 0), ('paint', 'blue', 1), ('caching', 'widget', 0)),
    c AS (SELECT module, capability, count(*) AS said, string_agg(signal, ', ' ORDER BY nth) AS signals FROM (SELECT DISTINCT p_brand AS module, capability, signal, nth FROM part JOIN w ON contains(p_name, signal)) x GROUP BY module, capability),
    r AS (SELECT p.module, 'fasteners' AS capability, coalesce(least(said / 2.0, 1) * 4, 0) + least(nf / paths, 1) * 3 + least(coalesce(i.n, 0), 5) * 0.6 + least(coalesce(y.n, 0), 5) * 0.4 AS points, 12 AS most, 0.9 AS weight, signals, nf, i.n AS ni, y.n AS ny
        FROM p LEFT JOIN i ON i.module = p.module LEFT JOIN y ON y.module = p.module LEFT JOIN c ON c.module = p.module AND c.capability = 'fasteners'
      UNION ALL SELECT module, capability, least(said / CASE capability WHEN 'paint' THEN 3.0 ELSE 1.0 END, 1) * 4, 4, CASE capability WHEN 'paint' THEN 0.8 ELSE 0.5 END, signals, 0, 0, 0 FROM c WHERE capability <> 'fasteners')
    SELECT module, capability, floor(points / most * weight * 100 + 0.5) / 100 AS confidence, concat_ws('; ', CASE WHEN signals IS NOT NULL THEN concat('content signals: ', signals) END, CASE WHEN nf > 0 THEN concat(nf, ' file(s) match') END,
      CASE WHEN ni > 0 THEN 'imports: m0, m1, m2' END, CASE WHEN ny > 0 THEN concat('symbols: ', (SELECT string_agg(name, ', ') FROM (SELECT DISTINCT s.name FROM symbols s JOIN files f ON f.path = s.file WHERE f.module = r.module AND contains(s.name, 'helper1') ORDER BY s.name LIMIT 3) z)) END) AS evidence
    FROM r WHERE points / most * weight >= 0.1""")
def detected_capabilities(s: Source):
    files = s("files").join(s("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("text")), "k").select("module", "path", "text")
    symbols = s("symbols").join(s("files"), F.col("file") == F.col("path")).select("module", "name")
    imports = s("dependencies").join(s("files"), F.col("source_file") == F.col("path")).select("module", F.col("import_name").alias("name"))
    return capabilities.detect(files, symbols, imports, capabilities.definitions(s.spark, _CUSTOM))


_SIGNALS = ", ".join(f"('{c}', {w}, {k}, {len(xs)}, '{x.replace(chr(39), chr(39) * 2)}')" for c, (w, xs) in capabilities.CONTENT_SIGNALS.items() for k, x in enumerate(xs))


@query(f"""WITH w(capability, weight, nth, total, signal) AS (VALUES {_SIGNALS}), u AS (SELECT lower(signal) AS s, count(DISTINCT capability) AS used FROM w GROUP BY lower(signal)),
    h AS (SELECT DISTINCT source AS module, signal FROM documents JOIN (SELECT DISTINCT signal FROM w) x ON contains(text, signal)),
    g AS (SELECT module, capability, weight, count(*) AS n, least(sum(CASE used WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END) / max(total), 1.0) AS share, string_agg(signal, ', ' ORDER BY nth) FILTER (WHERE true) AS signals, list(signal ORDER BY nth) AS listed
      FROM h JOIN w USING (signal) JOIN u ON s = lower(signal) GROUP BY module, capability, weight)
    SELECT module, capability, floor(share * weight * 100 + 0.5) / 100 AS confidence, concat('content signals: ', array_to_string(listed[1:3], ', '), CASE WHEN n > 3 THEN concat(' (+', n - 3, ')') ELSE '' END) AS evidence FROM g WHERE share * weight >= 0.1""")
def document_capabilities(s: Source):
    files = s("documents").select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("path"), "text")
    none = s.rows([], "module string, name string")
    return capabilities.detect(files, none, none, capabilities.definitions(s.spark))


@query("""WITH w(capability, signal, total) AS (VALUES ('paint', 'red', 3.0), ('paint', 'blue', 3.0), ('caching', 'widget', 1.0)),
    c AS (SELECT capability, module, floor(least(count(*) / max(total), 1) * CASE capability WHEN 'paint' THEN 0.8 ELSE 0.5 END * 100 + 0.5) / 100 AS c FROM (SELECT DISTINCT p_brand AS module, capability, signal, total FROM part JOIN w ON contains(p_name, signal)) x GROUP BY module, capability)
    SELECT capability, string_agg(concat(module, ': ', printf('%.2f', c)), '|' ORDER BY c DESC, module) AS modules, max(c) AS max_confidence FROM c GROUP BY capability""")
def capability_templates(s: Source):
    files = s("part").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("text"))
    none = s.rows([], "module string, name string")
    found = capabilities.detect(files, none, none, capabilities.definitions(s.spark, _CUSTOM, catalogue=False)).where("capability <> 'fasteners'")
    return capabilities.templates(found).withColumn("modules", F.array_join("modules", "|"))


@query("""SELECT count(*) AS total, count(CASE WHEN regexp_matches(name, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 1 END) AS camel, count(CASE WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 1 END) AS snake,
    count(CASE WHEN regexp_matches(name, '^([A-Z][a-z0-9]*)+$') THEN 1 END) AS pascal, CASE WHEN count(CASE WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 1 END) > 0.6 * count(*) THEN 'snake_case' ELSE 'mixed' END AS style
    FROM symbols WHERE exported AND kind NOT IN ('class', 'interface', 'type', 'enum')""")
def naming_conventions(s: Source):
    return S.naming_conventions(s("symbols"))


_COUNT = " + ".join(f"len(regexp_extract_all(text, '{b}'))" for b in T.BRANCHES)


@query(f"SELECT doc_id, 1 + {_COUNT} AS complexity, len(string_split(text, chr(10))) AS loc, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def text_complexity(s: Source):
    t = F.col("text")
    return s("documents").select("doc_id", T.complexity(t).alias("complexity"), T.loc(t).alias("loc"), T.token_estimate(t).alias("tokens"))


@query("""SELECT page_id, count(*) AS urls, count(DISTINCT u) AS distinct_urls FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=[^ >]+')) AS u FROM pages) x GROUP BY page_id""")
def detect_urls(s: Source):
    found = s("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?:href|src)=[^ >]+"), F.lit(0))).alias("u"))
    return found.groupBy("page_id").agg(F.count("*").alias("urls"), F.countDistinct("u").alias("distinct_urls"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(concat(p_name, '!! ', p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(sha256(p_name), 1, 16) AS hash FROM part")
def slugs(s: Source):
    return s("part").select(F.col("p_partkey").alias("id"), T.slug(F.concat("p_name", F.lit("!! "), "p_brand")).alias("slug"), T.content_hash(F.col("p_name")).alias("hash"))


_SOURCE = "concat('import { a', CAST(p_partkey AS STRING), ' } from ''./m', CAST(p_partkey % 7 AS STRING), ''';\n', 'export function f', CAST(p_partkey AS STRING), '(x, y) {\n  return x;\n}\nconst v', CAST(p_partkey AS STRING), ' = 1;\nexport class C', CAST(p_partkey AS STRING), ' extends Base {}\n')"


@query("""SELECT concat('p', p_partkey) AS path, 'function' AS kind, concat('f', p_partkey) AS name, 2 AS line, true AS exported FROM part
    UNION ALL SELECT concat('p', p_partkey), 'const', concat('v', p_partkey), 5, false FROM part UNION ALL SELECT concat('p', p_partkey), 'class', concat('C', p_partkey), 6, true FROM part""")
def extract_symbols(s: Source):
    src = s("part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr(_SOURCE).alias("text"), F.lit("javascript").alias("language"))
    return source_code.symbols(src).select("path", "kind", "name", "line", "exported")


@query("SELECT concat('p', p_partkey) AS path, concat('./m', p_partkey % 7) AS target, 'named' AS import_type, 1 AS line FROM part")
def extract_imports(s: Source):
    src = s("part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr(_SOURCE).alias("text"), F.lit("javascript").alias("language"))
    return source_code.imports(src).select("path", "target", "import_type", "line")


@query("SELECT concat('p', p_partkey) AS path, concat('C', p_partkey) AS child, 'extends' AS relation, 'Base' AS parent FROM part")
def extract_hierarchy(s: Source):
    src = s("part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr(_SOURCE).alias("text"), F.lit("javascript").alias("language"))
    return source_code.hierarchy(src)


_REQ = "concat('## ', p_brand, '\n- [ ] **REQ-', CAST(p_partkey AS STRING), '**: ', p_name, '\n  depends_on: [REQ-', CAST(p_partkey % 10 AS STRING), ', AUTH-1]\n- [x] **AUTH-', CAST(p_partkey AS STRING), '**: second\n')"


@query("""SELECT p_partkey AS doc, concat('REQ-', p_partkey) AS id, p_brand AS category, p_name AS text, concat('REQ-', p_partkey % 10, ',AUTH-1') AS depends_on, 2 AS line FROM part
    UNION ALL SELECT p_partkey, concat('AUTH-', p_partkey), p_brand, 'second', '', 4 FROM part""")
def parse_requirements(s: Source):
    src = s("part").select(F.col("p_partkey").alias("doc"), F.expr(_REQ).alias("text"))
    return markdown.requirements(src, "doc").withColumn("depends_on", F.array_join("depends_on", ","))


@query("""SELECT p_partkey AS doc, p_name AS term, p_brand AS definition FROM part""")
def parse_glossary(s: Source):
    body = "concat('# Terms\n\n| Term | Definition |\n|---|---|\n| ', p_name, ' | ', p_brand, ' |\n| lone |\n')"
    return markdown.glossary(s("part").select(F.col("p_partkey").alias("doc"), F.expr(body).alias("text")), "doc").select("doc", "term", "definition")


@query("""SELECT p_partkey AS doc, 'api' AS type, p_brand AS provider, p_type AS consumer, concat('/v1/', p_partkey) AS endpoint FROM part""")
def parse_contracts(s: Source):
    body = "concat('## ', p_brand, ' -> ', p_type, '\n### api\n- **Endpoint**: /v1/', CAST(p_partkey AS STRING), '\n- **Response**: { id: string, n: number }\n')"
    return markdown.contracts(s("part").select(F.col("p_partkey").alias("doc"), F.expr(body).alias("text")), "doc").select("doc", "type", "provider", "consumer", "endpoint")
