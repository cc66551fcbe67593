"""Queries over parsed documents, sources and streams; texts are made from the tables, in several shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import manifests as M
from ..sources import markdown as D
from ..sources import source_code as C
from ..sources import structure, tables, versioned
from ..streaming import feed, monitor
from .registry import Source, query


def _say(*parts):
    """Texts end to end: strings as they are, columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _folder(s: Source) -> str:
    return f"{tables.shared_folder(s.spark)}/in-{uuid.uuid4().hex}"


# sources
@query("""SELECT concat('src/', replace(p_brand, '#', '-'), CASE WHEN p_brand < 'Brand#3' THEN '/main.js' ELSE '/deep/Main.PY' END) AS path, CASE WHEN p_brand < 'Brand#3' THEN 'javascript' ELSE 'python' END AS language, CAST(count(*) + 1 AS INTEGER) AS loc FROM part GROUP BY p_brand""")
def discover_files(s: Source):
    """Sources that Spark writes, one for each brand, under the names of sources, beside folders and files to be passed over."""
    root, raw = _folder(s), _folder(s)
    s("part").select(F.regexp_replace("p_brand", "#", "-").alias("brand"), _say("x = ", F.col("p_partkey")).alias("value")).repartition("brand").write.partitionBy("brand").text(raw)
    path = s.spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(s.spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(raw)):  # a file for each brand
        brand = folder.getPath().getName().partition("=")[2]
        for file in fs.listStatus(folder.getPath()) if brand else ():
            for name in ["main.js" if brand < "Brand-3" else "deep/Main.PY"]:
                fs.mkdirs(path(f"{root}/src/{brand}/{name}").getParent())
                fs.rename(file.getPath(), path(f"{root}/src/{brand}/{name}"))
    for name in ("src/.git/e.js", "node_modules/f.js", "src/g.txt", "src/dist/h.ts"):
        fs.create(path(f"{root}/{name}")).close()
    return C.discover(s.spark, root).select("path", "language", T.loc(F.col("text")).alias("loc"))


@query("""SELECT concat('p', p_partkey, '.py') AS path, v.* REPLACE (replace(v.name, '?', CAST(p_partkey AS VARCHAR)) AS name) FROM part, (VALUES (1, 5, 'class', 'Shop?', true, ''), (3, 5, 'function', 'sell', true, '(self, item: str, *, price=1) -> int'), (6, 7, 'function', '_hide?', false, '(*args)')) v(line, end_line, kind, name, exported, signature)
    WHERE p_partkey % 3 <> 0""")
def python_declarations(s: Source):
    k = F.col("p_partkey")
    whole = _say("class Shop", k, "(Base):\n    # def no():\n    async def sell(self, item: str,\n        *, price=1) -> int:\n        return 'def x(): pass'\ndef _hide", k, "(*args):\n    pass\n")
    text = F.when(k % 3 == 0, "def broken(:\n").otherwise(whole)
    return C.python_symbols(s("part").select(_say("p", k, ".py").alias("path"), F.lit("python").alias("language"), text.alias("text")))


@query("""SELECT concat('p', p_partkey) AS path, v.line, v.kind, replace(v.name, '?', CAST(p_partkey AS VARCHAR)) AS name, v.exported FROM part, (VALUES
    (0, 1, 'class', 'Shop', true), (0, 2, 'function', 'sell?', true), (0, 3, 'function', 'hide', false), (0, 5, 'interface', 'Goods', true), (0, 6, 'enum', 'Size', true),
    (1, 2, 'class', 'Shop', true), (1, 3, 'interface', 'goods', false), (1, 4, 'function', 'Sell?', true), (1, 5, 'function', 'hide', false),
    (2, 1, 'interface', 'Goods', true), (2, 2, 'type', 'Size', false), (2, 3, 'component', 'Panel?', true), (2, 4, 'function', 'run', false), (2, 5, 'class', 'Shop', true),
    (3, 1, 'function', 'load', true), (3, 2, 'const', 'LIMIT', true), (3, 3, 'function', 'tick?', false)) v(r, line, kind, name, exported) WHERE p_partkey % 4 = v.r""")
def language_symbols(s: Source):
    k = F.col("p_partkey")
    java = _say("public final class Shop extends Base {\n  public static int sell", k, "(int n) {\n  private void hide() {\n  // class Ghost\n}\npublic interface Goods { }".replace("}\npublic", "public"), "\nenum Size { S }")
    go = _say("package shop\ntype Shop struct {\ntype goods interface {\nfunc (s *Shop) Sell", k, "(n int) int {\nfunc hide() {")
    ts = _say("export interface Goods { n: number }\ntype Size = 's' | 'm';\nexport const Panel", k, " = (props) => null;\nconst run = async () => {};\nexport abstract class Shop {}")
    js = _say("export async function load(url) {\nexport const LIMIT = 4;\nlet tick", k, " = n => n;\n// function ghost()")
    files = s("part").select(_say("p", k).alias("path"), F.when(k % 4 == 0, "java").when(k % 4 == 1, "go").when(k % 4 == 2, "typescript").otherwise("javascript").alias("language"), F.when(k % 4 == 0, java).when(k % 4 == 1, go).when(k % 4 == 2, ts).otherwise(js).alias("text"))
    return C.symbols(files)


@query("""SELECT concat('src/m', p_partkey, '/a.js') AS source_file, v.target, replace(v.file, '?', CAST(p_partkey AS VARCHAR)) AS target_file FROM part,
    (VALUES ('./b', 'src/m?/b.js'), ('../util', 'src/util/index.js'), ('./b.js', 'src/m?/b.js')) v(target, file)""")
def resolve_imports(s: Source):
    k = F.col("p_partkey")
    p = s("part").select(_say("src/m", k, "/a.js").alias("path"), _say("src/m", k, "/b.js").alias("other"))
    found = p.select("path", F.explode(F.array(*[F.lit(x) for x in ("./b", "../util", "./b.js", "react", "./none")])).alias("target"))
    files = p.select(F.col("other").alias("path")).unionByName(s.rows([("src/util/index.js",), ("src/util/index.ts",)], "path string"))
    return C.resolve_imports(found, files).select("source_file", "target", "target_file")


@query("""SELECT concat('p', p_partkey) AS path, v.line, v.target, v.import_type FROM part, (VALUES (0, 1, 'lib', 'named'), (0, 2, './own', 'default'), (0, 3, 'all', 'namespace'), (0, 4, './lazy', 'dynamic'), (0, 5, 'old', 'require'),
    (1, 1, 'os', 'namespace'), (1, 2, 'a.b', 'named'), (2, 1, 'java.util.List', 'named'), (2, 2, 'a.B.c', 'named'), (3, 2, 'fmt', 'named'), (3, 3, 'net/http', 'named')) v(r, line, target, import_type) WHERE p_partkey % 4 = v.r""")
def language_imports(s: Source):
    k = F.col("p_partkey")
    js = "import { a, b as c } from 'lib';\nimport Own from \"./own\";\nimport * as all from 'all';\nconst l = await import('./lazy');\nconst o = require('old');\n// nothing"
    text = F.when(k % 4 == 0, js).when(k % 4 == 1, "import os\nfrom a.b import c").when(k % 4 == 2, "import java.util.List;\nimport static a.B.c;").otherwise('import (\n  "fmt"\n  h "net/http"\n)')
    files = s("part").select(_say("p", k).alias("path"), F.when(k % 4 == 0, "javascript").when(k % 4 == 1, "python").when(k % 4 == 2, "java").otherwise("go").alias("language"), text.alias("text"))
    return C.imports(files)


@query("""SELECT concat('p', p_partkey) AS path, v.* FROM part, (VALUES ('load', 'fetchAll', 2), ('load', 'parse', 2), ('save', 'load', 5), ('save', 'write', 6)) v(caller, callee, line)""")
def function_calls(s: Source):
    files = s("part").select(_say("p", F.col("p_partkey")).alias("path"), F.lit("javascript").alias("language"), F.lit("function load(a) {\n  if (a) return parse(fetchAll(a));\n}\nfunction save(a) {\n  load(a);\n  write(a.size());\n}").alias("text"))
    return C.calls(files, C.symbols(files))


def _shops(s: Source):
    """A source of each of four languages in turn, with declarations over several lines, comments and literals."""
    k = F.col("p_partkey")
    ts = _say("import {\n  a,\n  b as c\n} from 'lib", k, "';\n// class Ghost {}\nexport class Shop", k, "<T>\n  extends Base<T>\n  implements Goods, Priced {\n  sell(item: string,\n    n = 1): void {\n    load(price(n), '}');\n  }\n}\n")
    java = _say("import java.util.List;\npublic class Shop", k, " extends Base\n    implements Goods, Priced {\n  public int sell(String item,\n      int n) {\n    return load(price(n)); // }\n  }\n}\n")
    go = _say('import (\n  "fmt"\n)\ntype Shop', k, " struct {\n}\nfunc (s *Shop", k, ") Sell(item string,\n  n int) int {\n  return load(price(n), \"}\")\n}\n")
    py = _say("from lib import (\n    a,\n    b,\n)\nclass Shop", k, "(Base, Goods):\n    def sell(self, item,\n             n=1):\n        return load(price(n), 'def x():')\n")
    return s("part").select(_say("p", k).alias("path"), F.when(k % 4 == 0, "typescript").when(k % 4 == 1, "java").when(k % 4 == 2, "go").otherwise("python").alias("language"), F.when(k % 4 == 0, ts).when(k % 4 == 1, java).when(k % 4 == 2, go).otherwise(py).alias("text"))


@query("""SELECT concat('p', p_partkey) AS path, v.line, v.end_line, v.kind, replace(v.name, '?', CAST(p_partkey AS VARCHAR)) AS name, v.signature FROM part, (VALUES
    (0, 6, 13, 'class', 'Shop?', ''), (0, 9, 12, 'method', 'sell', '(item: string, n = 1): void'), (1, 2, 8, 'class', 'Shop?', ''), (1, 4, 7, 'method', 'sell', '(String item, int n)'),
    (2, 4, 5, 'class', 'Shop?', ''), (2, 6, 9, 'method', 'Sell', '(item string, n int) int'), (3, 5, 8, 'class', 'Shop?', ''), (3, 6, 8, 'method', 'sell', '(self, item, n=1)')) v(r, line, end_line, kind, name, signature) WHERE p_partkey % 4 = r""")
def tree_symbols(s: Source):
    return structure.symbols(_shops(s)).select("path", "line", "end_line", "kind", "name", "signature")


def _varied(s: Source):
    """A script of as many methods as the part's size says (modulo seven), with brackets in expressions and templates."""
    k, n = F.col("p_partkey"), F.expr("p_size % 7")
    method = F.transform(F.sequence(F.lit(1), n), lambda i: _say("  m", i, "(x) {\n    return f", i, "(`${x} }`, /[(]/);\n  }\n"))
    text = _say("class Shop", k, " {\n", F.when(n > 0, F.array_join(method, "")).otherwise(""), "}\nconst Panel", k, " = (p) => {\n  go(p / 2);\n};\n")
    return s("part").select(_say("p", k).alias("path"), F.lit("javascript").alias("language"), text.alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 7 AS n FROM part) SELECT concat('p', k) AS path, 1 AS line, CAST(3 * n + 2 AS INTEGER) AS end_line, 'class' AS kind, concat('Shop', k) AS name FROM p
    UNION ALL SELECT concat('p', k), CAST(3 * n + 3 AS INTEGER), CAST(3 * n + 5 AS INTEGER), 'component', concat('Panel', k) FROM p
    UNION ALL SELECT concat('p', k), CAST(3 * i - 1 AS INTEGER), CAST(3 * i + 1 AS INTEGER), 'method', concat('m', i) FROM p, range(1, 7) r(i) WHERE i <= n""")
def varied_symbols(s: Source):
    return structure.symbols(_varied(s)).select("path", "line", "end_line", "kind", "name")


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 7 AS n FROM part) SELECT concat('p', k) AS path, concat('Panel', k) AS caller, 'go' AS callee, CAST(3 * n + 4 AS INTEGER) AS line FROM p
    UNION ALL SELECT concat('p', k), concat('m', i), concat('f', i), CAST(3 * i AS INTEGER) FROM p, range(1, 7) r(i) WHERE i <= n""")
def varied_calls(s: Source):
    return structure.calls(_varied(s))


@query("""SELECT concat('p', p_partkey) AS path, v.line, replace(v.target, '?', CAST(p_partkey AS VARCHAR)) AS target, v.names FROM part, (VALUES (0, 1, 'lib?', 'a,b as c'), (1, 1, 'java.util.List', 'List'), (2, 2, 'fmt', ''), (3, 1, 'lib', 'a,b')) v(r, line, target, names) WHERE p_partkey % 4 = r""")
def tree_imports(s: Source):
    return structure.imports(_shops(s)).select("path", "line", "target", "names")


@query("""SELECT concat('p', p_partkey) AS path, concat('Shop', p_partkey) AS child, v.relation, v.parent FROM part, (VALUES (0, 'extends', 'Base'), (0, 'implements', 'Goods'), (0, 'implements', 'Priced'), (1, 'extends', 'Base'), (1, 'implements', 'Goods'), (1, 'implements', 'Priced'),
    (3, 'extends', 'Base'), (3, 'extends', 'Goods')) v(r, relation, parent) WHERE p_partkey % 4 = r""")
def tree_hierarchy(s: Source):
    return structure.hierarchy(_shops(s))


@query("""SELECT concat('p', p_partkey) AS path, CASE p_partkey % 4 WHEN 2 THEN 'Sell' ELSE 'sell' END AS caller, v.callee, CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN 6 ELSE 8 END AS line FROM part, (VALUES ('load'), ('price')) v(callee)""")
def tree_calls(s: Source):
    return structure.calls(_shops(s))


# manifests and detectors
_MANIFEST = """CASE p_partkey % 4 WHEN 0 THEN concat('{"service": {"name": "s', p_partkey, '", "team": "t', p_size, '"}, "exports": [{"type": "api", "name": "/a"}]}')
    WHEN 1 THEN concat('{"service": {"name": "s', p_partkey, '"}, "exports": [{"type": "odd", "name": "x"}, {"type": "event"}]}') WHEN 2 THEN '{"service": ' ELSE '{"exports": []}' END"""


def _manifests(s: Source):
    return M.read_manifests(s("part").select(F.col("p_partkey").cast("string").alias("key"), F.expr(_MANIFEST).alias("text")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 4 < 2 THEN concat('s', p_partkey) END AS service, CASE WHEN p_partkey % 4 = 0 THEN concat('t', p_size) END AS team,
    CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 END AS exports, p_partkey % 4 = 2 AS broken FROM part""")
def read_manifests(s: Source):
    n = F.size(F.from_json("exports", "array<struct<type:string,name:string>>"))
    return _manifests(s).select("key", "service", "team", F.when(F.col("exports").isNotNull(), n).alias("exports"), F.col("error").isNotNull().alias("broken"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, v.path, v.severity FROM part, (VALUES (1, 'service.team', 'warning'), (1, 'exports[0]', 'error'), (1, 'exports[1]', 'error'), (2, '', 'error'), (3, 'service.name', 'error'), (3, 'service.team', 'warning')) v(r, path, severity) WHERE p_partkey % 4 = r""")
def validate_manifests(s: Source):
    return M.validate_manifests(_manifests(s)).select("key", "path", "severity")


@query("""SELECT concat('f', p_partkey) AS path, v.* FROM part, (VALUES ('export', 'express', 'api', '/items/:id'), ('export', 'kafka_producer', 'event', 'orders.made'), ('export', 'orm_model', 'database', 'orders'), ('export', 'grpc', 'rpc', 'GetItem'),
    ('import', 'http_client', 'api', 'stock.internal'), ('import', 'kafka_consumer', 'event', 'orders.paid'), ('import', 'env_url', 'api', 'BILLING')) v(direction, detector, type, name) WHERE p_partkey % 2 = 0""")
def detect_interfaces(s: Source):
    text = "app.get('/items/:id', h)\nproducer.send({ topic: 'orders.made' })\n__tablename__ = 'orders'\nservice S { rpc GetItem (A) returns (B); }\naxios.get('https://stock.internal/x')\nconsumer.subscribe({ topics: ['orders.paid'] })\nprocess.env.BILLING_URL"
    k = F.col("p_partkey")
    files = s("part").select(_say("f", k).alias("path"), F.when(k % 2 == 0, text).otherwise("nothing to see").alias("text"))
    return M.detect_interfaces(files).select("path", "direction", "detector", "type", "name")


@query("""SELECT replace(v.path, '?', CAST(p_partkey AS VARCHAR)) AS path, v.direction, v.detector, v.type, replace(v.name, '?', CAST(p_partkey AS VARCHAR)) AS name FROM part, (VALUES (0, 'a?/openapi.yaml', 'export', 'openapi', 'api', '/items'), (0, 'a?/openapi.yaml', 'export', 'openapi', 'api', '/items/{id}'),
    (1, 'b?/shop.ts', 'export', 'nest', 'api', 'list'), (1, 'b?/shop.ts', 'export', 'entity', 'database', 'goods'), (1, 'b?/shop.ts', 'import', 'kafka_reader', 'event', 'paid.?'), (2, 'c?/tasks.py', 'export', 'celery_function', 'event', 'send_mail'), (2, 'c?/tasks.py', 'export', 'redis_publisher', 'event', 'news'),
    (2, 'c?/tasks.py', 'import', 'celery_delay', 'event', 'clean_up'), (3, 'd?/package.json', 'export', 'npm', 'package', '@shop/core?'), (4, 'e?/.env.local', 'import', 'compose', 'api', 'stock'), (4, 'e?/.env.local', 'import', 'env_url', 'api', 'STOCK_SERVICE'), (5, 'f?/pyproject.toml', 'export', 'pypi', 'package', 'shop-core')) v(r, path, direction, detector, type, name) WHERE p_partkey % 7 = r""")
def detect_more(s: Source):
    k = F.col("p_partkey")
    shapes = [
        (_say("a", k, "/openapi.yaml"), F.lit("openapi: 3.0.0\npaths:\n  /items:\n    get:\n  /items/{id}:\n    put:\n")),
        (_say("b", k, "/shop.ts"), _say("@Controller('shop')\nclass A { @Get('list') all() {} }\n@Entity('goods')\nclass B {}\nawait consumer.subscribe({ fromBeginning: true, topic: 'paid.", k, "' })")),
        (_say("c", k, "/tasks.py"), F.lit("import redis\n@shared_task(bind=True)\ndef send_mail(self):\n    r.publish('news', 1)\n    clean_up.delay(3)\n")),
        (_say("d", k, "/package.json"), _say('{"name": "@shop/core', k, '", "version": "1.0.0"}')),
        (_say("e", k, "/.env.local"), F.lit("STOCK_SERVICE_URL=https://stock-api.internal:80/x\nMODE=dev\n")),
        (_say("f", k, "/pyproject.toml"), F.lit('[project]\nname = "shop-core"\n')),
        (_say("g", k, "/notes.yaml"), F.lit("x:\n  /items:\n")),
    ]
    path, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, (p, t) in enumerate(shapes):
        path, text = F.when(k % 7 == r, p).otherwise(path), F.when(k % 7 == r, t).otherwise(text)
    return M.detect_interfaces(s("part").select(path.alias("path"), text.alias("text"))).select("path", "direction", "detector", "type", "name")


@query("""WITH f AS (SELECT p_size AS phase, p_partkey % 20 + 1 AS n, max(CASE WHEN p_partkey % 5 > 0 THEN '1' END) AS wave, max(CASE WHEN p_partkey % 40 < 20 THEN 1 ELSE 0 END) AS planned FROM part GROUP BY 1, 2),
    d AS (SELECT DISTINCT phase FROM f), l AS (SELECT DISTINCT p_size AS phase FROM part WHERE p_size % 7 > 0 UNION SELECT 77), g AS (SELECT phase, lag(phase) OVER (ORDER BY phase) AS last FROM d),
    p AS (SELECT phase, n, lag(n) OVER (PARTITION BY phase ORDER BY n) AS last FROM f WHERE planned = 1)
    SELECT 'not_on_disk' AS "check", CAST(phase AS VARCHAR) AS subject FROM l WHERE phase NOT IN (SELECT phase FROM d) UNION ALL SELECT 'not_in_roadmap', CAST(phase AS VARCHAR) FROM d WHERE phase NOT IN (SELECT phase FROM l)
    UNION ALL SELECT 'phase_gap', concat(last, ' -> ', phase) FROM g WHERE phase > last + 1 UNION ALL SELECT 'plan_gap', concat(lpad(CAST(phase AS VARCHAR), 2, '0'), '-base: ', last, ' -> ', n) FROM p WHERE n > last + 1
    UNION ALL SELECT 'no_plan', printf('%02d-base/%02d-%02d-SUMMARY.md', phase, phase, n) FROM f WHERE planned = 0 UNION ALL SELECT 'no_wave', printf('%02d-base/%02d-%02d-PLAN.md', phase, phase, n) FROM f WHERE planned = 1 AND wave IS NULL""")
def consistency_report(s: Source):
    from ..operators import planning

    part = s("part")
    phases = part.where("p_size % 7 > 0").select("p_size").distinct().unionByName(s.rows([(77,)], "p_size int"))
    roadmap = phases.select(_say("## Roadmap\n### Phase 0", F.col("p_size"), ": Name\nPhase 9: no heading\n").alias("text"))
    f = part.groupBy("p_size", (F.col("p_partkey") % 20 + 1).alias("n")).agg(F.max(F.when(F.col("p_partkey") % 5 > 0, "1")).alias("wave"), F.max((F.col("p_partkey") % 40 < 20).cast("int")).alias("planned"))
    path = F.when(F.col("planned") == 1, F.format_string("%02d-base/%02d-%02d-PLAN.md", "p_size", "p_size", "n")).otherwise(F.format_string("%02d-base/%02d-%02d-SUMMARY.md", "p_size", "p_size", "n"))
    return planning.consistency(roadmap, f.select(path.alias("path"), "wave"))


@query("""SELECT 'export' AS direction, 'api' AS type, concat('/r', p_size) AS name, 'express' AS detector, min(concat('f', p_partkey)) AS path FROM part GROUP BY p_size""")
def dedup_interfaces(s: Source):
    files = s("part").select(_say("f", F.col("p_partkey")).alias("path"), _say("router.post('/r", F.col("p_size"), "', h); router.get('/r", F.col("p_size"), "', g)").alias("text"))
    return M.dedup_interfaces(M.detect_interfaces(files))


@query("""SELECT p_partkey AS k, concat('stock', p_partkey) AS service FROM part""")
def infer_service(s: Source):
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, _say("https://api-Stock", k, ".internal:8080/x")).when(k % 3 == 1, _say("http://stock", k, "-service/y")).otherwise(_say("stock", k))
    return s("part").select("p_partkey", url.alias("url")).select(k.alias("k"), M.service_name("url").alias("service"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, concat('repo-', n_nationkey) AS name, concat('git/', n_name) AS path FROM nation""")
def repo_registry(s: Source):
    text = _say('{"repos": [', F.array_join(F.array_sort(F.collect_list(_say('{"name": "repo-', F.col("n_nationkey"), '", "key": "', F.col("n_nationkey"), '", "path": "git/', F.col("n_name"), '"}'))), ", "), "]}")
    return M.registry(s("nation").agg(text.alias("text"))).select("key", "name", "path")


# documents
@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN concat('P', item_id) END AS title, CASE item_id % 3 WHEN 0 THEN 'a,b' END AS tags, item_id % 3 = 2 AS none FROM benchmark""")
def front_matter(s: Source):
    k = F.col("item_id")
    text = F.when(k % 3 == 0, _say("---\ntitle: P", k, "\ntags: [a, b]\n---\nBody")).when(k % 3 == 1, "---\nother: 1\n---\nBody").otherwise("Body\n---\nno")
    got = D.front_matter(s("benchmark").select("item_id", text.alias("text")), "item_id")
    tags = F.array_join(F.from_json(F.get_json_object("fields", "$.tags"), "array<string>"), ",")
    return got.select("item_id", F.get_json_object("fields", "$.title").alias("title"), tags.alias("tags"), F.col("fields").isNull().alias("none"))


@query("""SELECT item_id, v.* FROM benchmark, (VALUES ('Decisions', 1, '2024-01-02 10:00', NULL, 'Use one store'), ('Warnings', 1, NULL, 'high', 'high: slow query'), ('Warnings', 2, NULL, NULL, 'plain')) v(section, nth, stamp, severity, text)""")
def parse_ledger(s: Source):
    text = "# Log\n- before any section\n## Decisions\n[2024-01-02 10:00] Use one store\nfree text\n## Warnings\n- high: slow query\n\n- plain\n## Empty\n"
    return D.ledger(s("benchmark").select("item_id", F.lit(text).alias("text")), "item_id")


@query("""WITH d AS (SELECT item_id, v.* FROM benchmark, (VALUES ('decision', 'Use one store', 'cheap'), ('decision', 'Ship weekly', ''), ('preference', 'short names', '')) v(type, text, rationale))
    SELECT type, text, rationale FROM d WHERE text <> 'Ship weekly' GROUP BY type, text, rationale""")
def promote_from_ledger(s: Source):
    from ..operators import stores

    text = "# Log\n## Decisions\n[2024-01-02 10:00] Use one store\nRationale: cheap \n[2024-01-03 11:30] Ship weekly\n\n## User Preferences\n- short names\nnot an item\n"
    store = s.rows([("x", "decision", "ship WEEKLY!", "", True), ("y", "preference", "short names", "", False)], "id string, type string, text string, rationale string, active boolean")
    return stores.promote_from_ledger(store, s("benchmark").select("item_id", F.lit(text).alias("text")), "item_id").select("type", "text", "rationale")


@query("""SELECT item_id, concat('f', item_id, '.js') AS file, CAST(item_id % 3 + 1 AS INTEGER) AS covered, 4 AS total FROM benchmark""")
def coverage_report(s: Source):
    k = F.col("item_id")
    text = _say('{"f', k, '.js": {"s": {"0": 7, "1": ', F.when(k % 3 >= 1, 2).otherwise(0), ', "2": ', F.when(k % 3 >= 2, 1).otherwise(0), ', "3": 0}}}')
    return D.coverage(s("benchmark").select("item_id", text.alias("text")), "item_id")


@query("""SELECT item_id, CASE item_id % 4 WHEN 3 THEN NULL ELSE item_id + 1 END AS passed, CASE item_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 END AS failed FROM benchmark""")
def test_counts(s: Source):
    k = F.col("item_id")
    text = F.when(k % 4 == 0, _say("ok\nTests: 2 failed, ", k + 1, " passed, 99 total")).when(k % 4 == 1, _say("== ", k + 1, " passed in 0.1s ==")).when(k % 4 == 2, _say("# pass ", k + 1, "\n# fail 3")).otherwise("no summary")
    return D.test_counts(s("benchmark").select("item_id", text.alias("text")), "item_id").select("item_id", F.col("passed").cast("long").alias("passed"), "failed")


@query("""SELECT item_id, v.* FROM benchmark, (VALUES ('src/a.ts', '3', '7', 'TS2304', 'Cannot find name'), ('b.go', '10', '2', '', 'undefined: x'), ('c.py', '4', '', '', 'bad type')) v(file, "row", col, code, message)""")
def compile_errors(s: Source):
    text = "src/a.ts(3,7): error TS2304: Cannot find name\nnote: none\nb.go:10:2: undefined: x\nc.py:4: error: bad type\nc.py:5: note: see"
    return D.compile_errors(s("benchmark").select("item_id", F.lit(text).alias("text")), "item_id")


@query("""SELECT item_id, v.field, replace(v.value, '?', CAST(item_id AS VARCHAR)) AS value FROM benchmark, (VALUES ('Phase', '?'), ('Status', 'In progress')) v(field, value)""")
def state_fields(s: Source):
    text = _say("# State\n**Phase:** ", F.col("item_id"), "\n- **Status:** In progress  \nplain: no\n**Bold** text")
    return D.state_fields(s("benchmark").select("item_id", text.alias("text")), "item_id")


@query("""SELECT item_id, v.nth, v.type, replace(v.name, '?', CAST(item_id AS VARCHAR)) AS name, v.files FROM benchmark, (VALUES (1, 'auto', 'Make ?', 'a.js,b.js'), (2, '', 'Check', '')) v(nth, type, name, files)""")
def plan_tasks(s: Source):
    text = _say('<plan>\n<task type="auto" id="1">\n<name>Make ', F.col("item_id"), "</name><files>a.js,\n b.js</files>\n<action>do\nit</action></task>\n<task>\n<name> Check </name></task></plan>")
    got = D.plan_tasks(s("benchmark").select("item_id", text.alias("text")), "item_id")
    return got.select("item_id", "nth", "type", "name", F.array_join("files", ",").alias("files"))


@query("""SELECT concat('src/f', item_id % 7, '.test.js') AS path, min(item_id) AS first FROM benchmark GROUP BY item_id % 7 UNION ALL SELECT 'pkg/x_test.go', min(item_id) FROM benchmark""")
def test_references(s: Source):
    text = _say("run `src/f", F.col("item_id") % 7, ".test.js` and pkg/x_test.go, not src/test.js")
    return D.test_references(s("benchmark").select("item_id", text.alias("text")), "item_id")


@query("""SELECT p_partkey AS k, concat('get_item_', p_partkey) AS name, CASE WHEN p_partkey % 2 = 0 THEN concat(repeat('a', 200), '...') ELSE '(a)' END AS signature FROM part""")
def names_and_signatures(s: Source):
    k = F.col("p_partkey")
    return s("part").select(k.alias("k"), T.snake_case(_say("getItem_", k)).alias("name"), T.signature(F.when(k % 2 == 0, F.repeat(F.lit("a"), 230)).otherwise("(a)")).alias("signature"))


@query("""SELECT p_size % 10 AS loop, count(*) AS times FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1 HAVING count(*) >= 3""")
def stuck_patches(s: Source):
    k = F.col("p_partkey")
    patch = F.when(k % 4 == 0, _say("--- a\n+++ b\n+let y = ", k, ";")).otherwise(_say("--- a", k, "\n+++ b\n context\n-let  x = 1;\n+let x = 2;"))
    return monitor.stuck_patches(s("part").select((F.col("p_size") % 10).alias("loop"), patch.alias("patch"))).select("loop", "times")


# streams, run to the end of what is there
def _ended(s: Source, stream, mode: str = "append"):
    """What a stream gives for the files at hand, through a table in the shared folder."""
    out, state = _folder(s), _folder(s)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.schema(stream.schema).parquet(out)


def _stream(s: Source, df):
    folder = _folder(s)
    df.repartition(*df.columns).write.parquet(folder)  # all files are one batch
    return s.spark.readStream.schema(df.schema).parquet(folder)


_MANIFEST_FEED = "SELECT user_id AS service, ts, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS nth FROM events) q WHERE nth = 1"


def _manifest_feed(s: Source):
    return s("events").groupBy(F.col("user_id").alias("service"), "ts").agg(F.min_by("event_type", "event_id").alias("text"))


@query(f"""SELECT service, count(*) AS synced FROM (SELECT service, text, lag(text) OVER (PARTITION BY service ORDER BY ts) AS last FROM ({_MANIFEST_FEED}) a) b WHERE last IS NULL OR last <> text GROUP BY service""")
def hash_gated_sync(s: Source):
    return monitor.changed_services(_manifest_feed(s)).groupBy("service").agg(F.count("*").alias("synced"))


@query(f"""SELECT service, count(*) AS synced FROM (SELECT service, text, lag(text) OVER (PARTITION BY service ORDER BY ts) AS last FROM ({_MANIFEST_FEED}) a) b WHERE last IS NULL OR last <> text GROUP BY service""")
def hash_gated_stream(s: Source):
    return _ended(s, monitor.changed_services(_stream(s, _manifest_feed(s)))).groupBy("service").agg(F.count("*").alias("synced"))


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL '20' MINUTE THEN 0 ELSE 1 END AS opens FROM events), b AS (SELECT *, sum(opens) OVER (ORDER BY ts, event_id) AS burst FROM o)
    SELECT min(ts) AS started, count(DISTINCT user_id) AS paths FROM b GROUP BY burst HAVING max(ts) + INTERVAL '20' MINUTE < (SELECT max(ts) FROM events) - INTERVAL '2' SECOND""")
def debounced_stream(s: Source):
    changes = s("events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    out = _folder(s)
    feed.debounce(_stream(s, changes), out, _folder(s), "20 minutes").awaitTermination()
    return feed.bursts(s.spark, out).groupBy(F.col("started").cast("timestamp_ntz").alias("started")).agg(F.count("path").alias("paths"))


@query("""WITH l AS (SELECT user_id AS path, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'error' THEN 'D' WHEN 'view' THEN 'A' ELSE 'M' END DESC) AS n FROM events)
    SELECT concat('f', path, '.py') AS path, 'python' AS language FROM l WHERE n = 1 AND event_type <> 'error'
    UNION SELECT concat('f', p_partkey, '.py'), 'python' FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)""")
def maintained_files(s: Source):
    e = s("events")
    status = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "view", "A").otherwise("M")
    changes = e.select(status.alias("status"), _say("f", F.col("user_id"), ".py").alias("path"), F.lit(None).cast("string").alias("old_path"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    path, inbox, state = _folder(s), _folder(s), _folder(s)
    changes.repartition(*changes.columns).write.parquet(inbox)
    base = s("part").select(_say("f", F.col("p_partkey"), ".py").alias("path"), F.lit("python").alias("language"), F.lit("x").alias("text"))
    tables.overwrite(base, path)
    feed.maintain(feed.watch(s.spark, inbox), lambda: s.spark.read.parquet(path), lambda df: tables.overwrite(df, path), state).awaitTermination()
    return s.spark.read.parquet(path).select("path", "language")


@query("""WITH l AS (SELECT user_id AS path, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'error' THEN 'D' WHEN 'view' THEN 'A' ELSE 'M' END DESC) AS n FROM events)
    SELECT concat('f', path, '.py') AS path, event_type AS text FROM l WHERE n = 1 AND event_type <> 'error'
    UNION SELECT concat('f', p_partkey, '.py'), 'x' FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)""")
def versioned_files(s: Source):
    e = s("events")
    status = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "view", "A").otherwise("M")
    changes = e.select(status.alias("status"), _say("f", F.col("user_id"), ".py").alias("path"), F.lit(None).cast("string").alias("old_path"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    inbox, store = _folder(s), versioned.Store(s.spark, _folder(s))
    changes.repartition(*changes.columns).write.parquet(inbox)
    base = s("part").select(_say("f", F.col("p_partkey"), ".py").alias("path"), F.lit("python").alias("language"), F.lit("x").alias("text"))
    store.commit({"files": versioned.Change(["path"], upserts=base)})
    feed.maintain_store(feed.watch(s.spark, inbox), store, "files", _folder(s)).awaitTermination()
    return store.read("files").select("path", "text")


@query("""SELECT consumer_id, count(*) AS n FROM service_dependencies WHERE consumer_id <> 's1' AND consumer_id <> 's2' GROUP BY consumer_id UNION ALL SELECT 's1', 2""")
def synced_service(s: Source):
    d = s("service_dependencies").select("consumer_id", "provider_id").distinct()
    store = versioned.Store(s.spark, _folder(s))
    kept = s("service_dependencies").groupBy("consumer_id", "provider_id").agg(F.count("*").alias("n"))
    store.commit({"dependencies": versioned.Change(["consumer_id", "provider_id"], upserts=kept), "metrics": versioned.Change(["consumer_id"], upserts=kept.groupBy("consumer_id").agg(F.sum("n").alias("n")))})
    fresh = s.rows([("s1", "p", 1), ("s1", "q", 1)], "consumer_id string, provider_id string, n long")
    versioned.replace_owned(store, "consumer_id", "s1", {"dependencies": fresh, "metrics": fresh.groupBy("consumer_id").agg(F.sum("n").alias("n"))})
    versioned.replace_owned(store, "consumer_id", "s2", {"dependencies": fresh.limit(0), "metrics": d.select("consumer_id", F.lit(1).cast("long").alias("n")).limit(0)})
    whole = store.read("dependencies").groupBy("consumer_id").agg(F.sum("n").alias("n"))
    return store.read("metrics").join(whole.withColumnRenamed("n", "of"), "consumer_id").where("n = of").select("consumer_id", "n")


@query("""SELECT concat('u', user_id) AS session, count(*) AS spoken FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) q WHERE n % 5 = 1 GROUP BY user_id""")
def context_alerts(s: Source):
    usage = s("events").select(_say("u", F.col("user_id")).alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.lit(30.0).alias("remaining"), F.lit(1.0).alias("age"))
    return _ended(s, monitor.context_alerts(_stream(s, usage))).groupBy("session").agg(F.count("*").alias("spoken"))


_IN_ORDER = "SELECT user_id AS key, ts, event_type AS result FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_type) AS nth FROM events) q WHERE nth = 1"


def _in_order(s: Source):
    return s("events").groupBy(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")).agg(F.min("event_type").alias("result"))


@query(f"""WITH RECURSIVE e AS (SELECT key, ts, result, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM ({_IN_ORDER}) a),
    w(key, n, stored, hit) AS (SELECT key, n, ts, false FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, CASE WHEN e.ts - w.stored <= INTERVAL '12' HOUR THEN w.stored ELSE e.ts END, e.ts - w.stored <= INTERVAL '12' HOUR FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT key, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits FROM w GROUP BY key""")
def cached_stream(s: Source):
    got = _ended(s, monitor.cached_stream(_stream(s, _in_order(s)), keep="12 hours"))
    return got.groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"""WITH e AS (SELECT key, ts, nullif(result, 'view') AS error, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM ({_IN_ORDER}) a),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY key, error ORDER BY ts) AS run FROM e), t AS (SELECT key, error, row_number() OVER (PARTITION BY key, error, run ORDER BY ts) AS times FROM g WHERE error IS NOT NULL)
    SELECT key AS loop, error, CAST(max(times) AS INTEGER) AS times FROM t WHERE times >= 2 GROUP BY key, error""")
def stuck_errors(s: Source):
    attempts = _in_order(s).select(F.col("key").alias("loop"), "ts", F.nullif(F.col("result"), F.lit("view")).alias("error"))
    got = _ended(s, monitor.stuck_errors(_stream(s, attempts), limit=2, keep="60 days"))
    return got.groupBy("loop", "error").agg(F.max("times").alias("times"))


@query("""WITH c AS (SELECT p_brand AS project, count(*) AS total, count(CASE WHEN p_partkey % 3 = 0 OR p_size > 25 THEN 1 END) AS changes FROM part GROUP BY p_brand)
    SELECT project, CAST(changes AS INTEGER) AS changes, CASE WHEN changes > 0.3 * total AND changes > 50 THEN 'full' ELSE 'incremental' END AS plan FROM c""")
def update_plan(s: Source):
    k = (F.col("p_partkey") % 3 == 0) | (F.col("p_size") > 25)
    counts = s("part").groupBy(F.col("p_brand").alias("project")).agg(F.count("*").alias("total"), F.count_if(k).cast("int").alias("changes"))
    return counts.select("project", "changes", feed.update_plans(F.col("total"), F.col("changes")).alias("plan"))


@query("""SELECT modules, count(*) AS cycles, CAST(sum(n) AS BIGINT) AS members FROM (SELECT p_partkey - p_partkey % 6 AS g, string_agg(DISTINCT p_brand, ' <-> ' ORDER BY p_brand) AS modules, count(*) AS n FROM part WHERE p_partkey - p_partkey % 6 >= (SELECT min(p_partkey) FROM part)
      AND p_partkey - p_partkey % 6 + 5 <= (SELECT max(p_partkey) FROM part) GROUP BY 1) x GROUP BY modules""")
def cycles_by_modules(s: Source):
    from ..operators import code_graph, graph

    k = F.col("p_partkey")
    edges = s("part").select(k.cast("string").alias("src"), F.when(k % 6 == 5, k - 5).otherwise(k + 1).cast("string").alias("dst"))
    return code_graph.cycles_by_modules(graph.cycles(edges), s("part").select(k.cast("string").alias("path"), F.col("p_brand").alias("module")))


_GRAPHS = """WITH RECURSIVE old AS (SELECT src, dst FROM cyclic_edges WHERE src % 3 > 0 AND dst % 3 > 0), r(a, b) AS (SELECT src, dst FROM cyclic_edges UNION SELECT r.a, e.dst FROM r JOIN cyclic_edges e ON e.src = r.b),
    q(a, b) AS (SELECT src, dst FROM old UNION SELECT q.a, e.dst FROM q JOIN old e ON e.src = q.b),
    x AS (SELECT p.a AS n, min(p.b) AS component FROM r p JOIN r z ON z.a = p.b AND z.b = p.a GROUP BY p.a), y AS (SELECT p.a AS n, min(p.b) AS component FROM q p JOIN q z ON z.a = p.b AND z.b = p.a GROUP BY p.a)"""


@query(f"""{_GRAPHS}, f AS (SELECT component, list(n ORDER BY n) AS members FROM x GROUP BY component), b AS (SELECT list(n ORDER BY n) AS members FROM y GROUP BY component)
    SELECT component, array_to_string(members, ',') AS members FROM f WHERE members NOT IN (SELECT members FROM b) AND list_has_any(members, [1, 2, 3, 5, 8, 13, 21])""")
def cycle_gate(s: Source):
    from ..operators import code_graph, graph

    now = s("cyclic_edges")
    got = code_graph.cycle_gate(graph.cycles(now), graph.cycles(now.where("src % 3 > 0 and dst % 3 > 0")), [1, 2, 3, 5, 8, 13, 21])
    return got.select("component", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"{_GRAPHS} SELECT concat('s', component) AS component, count(*) AS size FROM (SELECT n, CAST(min(CAST(component AS VARCHAR)) OVER (PARTITION BY component) AS VARCHAR) AS component FROM (SELECT a.n, (SELECT min(CAST(b.n AS VARCHAR)) FROM x b WHERE b.component = a.component) AS component FROM x a) t) u GROUP BY component")
def service_cycles(s: Source):
    from ..operators.system_graph import SystemGraph

    deps = s("cyclic_edges").select(_say("s", F.col("src")).alias("consumer_id"), _say("s", F.col("dst")).alias("provider_id"))
    graph_ = SystemGraph({"services": s("services"), "service_interfaces": s("service_interfaces"), "service_dependencies": deps}.__getitem__)
    return graph_.cycles().select("component", "size")
