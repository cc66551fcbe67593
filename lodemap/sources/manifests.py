"""Service manifests and interface detection over source text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import spread

#: Export and import detectors, with the group that names what is found.
EXPORTS = {
    "express": ("api", r"(?:app|router)\.(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    "fastapi": ("api", r"@(?:app|router)\.(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    "nest": ("api", r"@(?:Get|Post|Put|Patch|Delete)\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    "openapi": ("api", r"(?m)^\s{2,4}(/[^\s:]*):\s*$"),
    "grpc": ("rpc", r"\brpc\s+(\w+)\s*\("),
    "kafka_producer": ("event", r"(?:producer\.send|kafkaTemplate\.send|\.produce)\(\s*(?:\{\s*topic:\s*)?['\"]([\w.-]+)['\"]"),
    "rabbit_publisher": ("event", r"(?:basic_publish|publish)\([^)]*?routing_key\s*=\s*['\"]([\w.-]+)['\"]"),
    "rabbit_queue": ("event", r"\.sendToQueue\(\s*['\"]([^'\"]+)['\"]"),
    "redis_publisher": ("event", r"(?i)redis[\s\S]*?\.publish\(\s*['\"]([^'\"]+)['\"]"),
    "celery_function": ("event", r"@(?:app\.task|shared_task|celery\.task)(?:\s*\([^)]*\))?\s*\n(?:async\s+)?def\s+(\w+)"),
    "celery_task": ("event", r"@(?:celery|app|shared)_?\.?task\(.*?name\s*=\s*['\"]([\w.]+)['\"]"),
    "sql_table": ("database", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)"),
    "orm_model": ("database", r"(?:__tablename__|db_table)\s*=\s*['\"](\w+)['\"]"),
    "entity": ("database", r"@Entity\(\s*['\"](\w+)['\"]\s*\)"),
}
IMPORTS = {
    "http_client": ("api", r"(?:axios|requests|fetch|http)(?:\.\w+)?\(\s*[`'\"]https?://([\w.-]+)"),
    "env_url": ("api", r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)_(?:URL|HOST|ENDPOINT)\b"),
    "kafka_consumer": ("event", r"(?:subscribe|consume)\(\s*(?:\{\s*topics?:\s*\[?\s*)?\[?['\"]([\w.-]+)['\"]"),
    "kafka_reader": ("event", r"(?:KafkaConsumer\(\s*|subscribe\(\s*\{[^}]*?topic:\s*|@KafkaListener\([^)]*?topics\s*=\s*)['\"]([\w.-]+)['\"]"),
    "celery_delay": ("event", r"\b(\w+)\.(?:delay|apply_async)\("),
    "celery_call": ("event", r"send_task\(\s*['\"]([\w.]+)['\"]"),
}


#: The files that a detector reads, where it does not read all.
FILES = {"openapi": r"(?i)(?:openapi|swagger)\.(?:ya?ml|json)$", "sql_table": r"(?i)\.(?:sql|migration)$|migration"}
#: Package files, and the pattern of the package's name; the last group that finds one counts.
PACKAGES = {"npm": (r"(?:^|/)package\.json$", r"\"name\"\s*:\s*\"([^\"]+)\""), "pypi": (r"(?:^|/)(?:pyproject\.toml|setup\.py)$", r"(?m)^\s*name\s*=\s*['\"]([^'\"]+)['\"]")}


def detect_packages(files: DataFrame) -> DataFrame:
    """path, detector, type, name of the package that a package file declares."""
    first = lambda d, on, p: F.when(F.col("path").rlike(on), F.struct(F.lit(d).alias("detector"), F.regexp_extract("text", p, 1).alias("name")))
    found = F.coalesce(*[first(d, on, p) for d, (on, p) in PACKAGES.items()])
    return files.withColumn("f", found).where("f.name <> ''").select("path", "f.detector", F.lit("package").alias("type"), "f.name")


def compose_services(files: DataFrame) -> DataFrame:
    """path, detector, type, name: the services that variables of environment and compose files point to, by their address."""
    own = files.where(F.col("path").rlike(r"(?i)(?:^|/)(?:\.env(?:\.\w+)?|[^/]*docker-compose[^/]*)$"))
    urls = F.regexp_extract_all("text", F.lit(r"\w+(?:_API_URL|_SERVICE_URL|_BASE_URL|_ENDPOINT|_HOST)\s*[=:]\s*['\"]?([^\s'\"#]+)"), F.lit(1))
    named = own.select("path", F.explode(F.array_distinct(urls)).alias("url")).select("path", F.lit("compose").alias("detector"), F.lit("api").alias("type"), service_name("url").alias("name"))
    return named.where("name <> ''").distinct()


def detect(files: DataFrame, detectors: dict[str, tuple[str, str]]) -> DataFrame:
    """path, detector, type, name: every distinct name that a detector finds in a file that it reads."""
    def hits(name: str, kind: str, pattern: str):
        names = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
        if name in FILES:
            names = F.when(F.col("path").rlike(FILES[name]), names).otherwise(F.array().cast("array<string>"))
        return F.transform(names, lambda x: F.struct(F.lit(name).alias("detector"), F.lit(kind).alias("type"), x.alias("name")))

    found = F.concat(*[hits(d, t, p) for d, (t, p) in detectors.items()])
    return files.select("path", F.explode(found).alias("f")).select("path", "f.*").where("name <> ''")


#: Web frameworks by the files they are in, their route calls (method and path), and paths that are passed over.
ROUTES = {
    "fastapi": (r"\.py$", r"@(?:app|router)\.(get|post|put|patch|delete|options|head)\s*\(\s*['\"]([^'\"]+)['\"]"),
    "express": (r"\.(?:js|ts|mjs|cjs)$", r"(?:router|app)\.(get|post|put|patch|delete|options|head)\s*\(\s*['\"]([^'\"]+)['\"]"),
    "nest": (r"\.(?:js|ts|mjs|cjs)$", r"@(Get|Post|Put|Patch|Delete)\s*\(\s*['\"]([^'\"]*)['\"]\s*\)"),
}
NO_ROUTES = r"(?i)detector|capability|signal|config.*pattern"
CONTROLLER = r"@Controller\s*\(\s*['\"]([^'\"]*)['\"]\s*\)"


def routes(files: DataFrame) -> DataFrame:
    """path, framework, method, route of every route call; a controller's prefix stands before its routes.

    Script files that hold patterns, and script routes with commas, blanks or over 200 characters, are passed over.
    """
    text = F.col("text")
    parts = []
    for name, (on, call) in ROUTES.items():
        calls = F.arrays_zip(F.regexp_extract_all(text, F.lit(call), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(call), F.lit(2)).alias("r"))
        prefix = F.regexp_extract(text, CONTROLLER, 1) if name == "nest" else F.lit("")
        own = files.where(F.col("path").rlike(on) & (F.lit(name == "fastapi") | ~F.col("path").rlike(NO_ROUTES))).select("path", prefix.alias("prefix"), F.explode(calls).alias("c"))
        route = F.when(F.col("prefix") != "", F.regexp_replace(F.concat_ws("/", "prefix", "c.r"), "/+", "/")).otherwise(F.coalesce(F.nullif(F.col("c.r"), F.lit("")), F.lit("/")))
        plain = F.lit(True) if name != "express" else ~F.col("c.r").rlike(r"[,\s]") & (F.length("c.r") <= 200)
        parts.append(own.where(plain).select("path", F.lit(name).alias("framework"), F.upper("c.m").alias("method"), route.alias("route")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def base_paths(found: DataFrame, by: str) -> DataFrame:
    """``by``, base, routes: the whole segments that all routes of a group begin with (``/api`` if there are none), and how many routes there are."""
    ends = found.groupBy(by).agg(F.min("route").alias("a"), F.max("route").alias("b"), F.count("*").alias("routes"))  # what the first and the last share, all share
    a, b = (F.filter(F.split(F.col(c), "/"), lambda x: x != "") for c in "ab")
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: F.when(z["x"] == z["y"], -1).otherwise(i))
    differ = F.array_min(F.filter(same, lambda k: k >= 0))
    shared = F.when(differ.isNull(), a).otherwise(F.slice(a, F.lit(1), differ))
    return ends.select(by, F.when(F.size(shared) > 0, F.concat(F.lit("/"), F.array_join(shared, "/"))).otherwise("/api").alias("base"), "routes")


def detect_interfaces(files: DataFrame) -> DataFrame:
    """As ``detect`` for exports (packages too) and imports (addresses in environments too), with the direction."""
    out = detect(files, EXPORTS).unionByName(detect_packages(files)).withColumn("direction", F.lit("export"))
    return out.unionByName(detect(files, IMPORTS).unionByName(compose_services(files)).withColumn("direction", F.lit("import")))


def dedup_interfaces(found: DataFrame) -> DataFrame:
    """One row per direction, type and name: the first detector and path by name."""
    return found.groupBy("direction", "type", "name").agg(F.min(F.struct("detector", "path")).alias("first")).select("direction", "type", "name", "first.detector", "first.path")


def service_name(url: DataFrame | str):
    """The service that a host, topic or task name points to: its first label without usual affixes."""
    host = F.regexp_replace(F.col(url), r"^[a-z]+://", "")
    label = F.element_at(F.split(host, r"[.:/]"), 1)
    return F.regexp_replace(F.lower(label), r"^(api-|svc-)|(-api|-svc|-service)$", "")


def read_manifests(docs: DataFrame) -> DataFrame:
    """key, service, team, exports, imports (JSON texts) and error of YAML or JSON manifests; broken ones carry their error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml

            loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # libyaml, where it is there

            def load(text: str) -> object:
                return yaml.load(text, loader)  # noqa: S506 (both are safe loaders)
        except ImportError:
            load = json.loads
        for f in frames:
            rows = []
            for key, text in zip(f["key"], f["text"], strict=True):
                try:
                    got = load(text or "")
                    if not isinstance(got, dict):
                        raise ValueError("not a mapping")
                    service = got.get("service") or {}
                    rows.append((key, service.get("name"), service.get("team"), json.dumps(got.get("exports") or []), json.dumps(got.get("imports") or []), None))
                except Exception as e:  # the scan goes on; the row says why
                    rows.append((key, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["key", "service", "team", "exports", "imports", "error"])

    return spread(docs.select("key", "text")).mapInPandas(parse, "key string, service string, team string, exports string, imports string, error string")


def registry(docs: DataFrame) -> DataFrame:
    """key, name, path of the repositories that registry texts ({"repos": [{name, key, path}]}) list; broken texts give none."""
    listed = F.from_json("text", "repos array<struct<key:string,name:string,path:string>>")["repos"]
    return docs.select(F.inline(listed)).select(F.coalesce("key", "name").alias("key"), "name", F.coalesce("path", "name").alias("path"))


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """key, path, message, severity: rules over the rows of ``read_manifests``."""
    kinds = F.from_json("exports", "array<struct<type:string,name:string>>")
    known = ("api", "event", "package", "rpc", "database")
    e = lambda path, message, level: F.struct(F.lit(path).alias("path"), message.alias("message"), F.lit(level).alias("severity"))
    single = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), e("", F.concat(F.lit("unreadable: "), "error"), "error")),
            F.when(F.col("error").isNull() & F.col("service").isNull(), e("service.name", F.lit("is required"), "error")),
            F.when(F.col("error").isNull() & F.col("team").isNull(), e("service.team", F.lit("is missing"), "warning")),
        )
    )
    each = F.filter(F.transform(kinds, lambda x, i: F.struct(F.concat(F.lit("exports["), i.cast("string"), F.lit("]")).alias("path"), F.when(x["name"].isNull(), "has no name").when(~F.coalesce(x["type"], F.lit("")).isin(*known), "has an unknown type").alias("message"), F.lit("error").alias("severity"))), lambda x: x["message"].isNotNull())
    return manifests.select("key", F.explode(F.concat(single, F.coalesce(each, F.array().cast("array<struct<path:string,message:string,severity:string>>")))).alias("f")).select("key", "f.*")
