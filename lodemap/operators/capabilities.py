"""Capabilities of modules: signals in texts, found in one pass each by an automaton over all of them, and name patterns.

Definitions are rows (capability, weight, kind, nth, signal): the catalogue of content signals below, which a custom
definition text extends or, by capability, overrides. Patterns for paths, imports and symbols come from such texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import half_up

SCHEMA = "capability string, weight double, kind string, nth int, signal string"
DEFAULT_WEIGHT = 0.8
KINDS = {"signals": "content", "filePatterns": "file", "importPatterns": "import", "symbolPatterns": "symbol"}

#: Capability, its weight and the strings that stand for it in texts.
CONTENT_SIGNALS: dict[str, tuple[float, list[str]]] = {
    "jwt": (0.9, ["jsonwebtoken", "jose", "jwt.sign", "jwt.verify", "Bearer ", "JwtPayload", "token.split('.')"]),
    "oauth2": (0.9, ["oauth", "authorization_code", "client_credentials", "redirect_uri", "PKCE", "code_verifier"]),
    "stripe": (0.95, ["stripe", "payment_intent", "PaymentIntent", "subscription", "webhook_secret", "Stripe("]),
    "database_sql": (0.85, ["SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE TABLE", "ALTER TABLE", "knex(", "sequelize", "typeorm", "prisma"]),
    "react_advanced": (0.85, ["useMemo", "useCallback", "React.memo", "React.lazy", "Suspense", "ErrorBoundary", "forwardRef", "useImperativeHandle"]),
    "kubernetes": (0.85, ["apiVersion:", "kind: Deployment", "kind: Service", "helm", "kubectl", "spec:", "containers:", "replicas:"]),
    "graphql": (0.9, ["typeDefs", "resolvers", "gql`", "ApolloServer", "schema.graphql", "Query {", "Mutation {", "useQuery", "useMutation"]),
    "websockets": (0.8, ["socket.io", "ws://", "wss://", "WebSocket", "onmessage", "onclose", "socket.emit", "socket.on"]),
    "testing": (0.95, ["describe(", "it(", "test(", "expect(", "jest", "vitest", "mocha", "pytest", "beforeEach", "afterEach", "mock", "spy"]),
    "docker": (0.85, ["Dockerfile", "docker-compose", "ENTRYPOINT", "FROM ", "COPY ", "RUN ", "EXPOSE"]),
    "ci_cd": (0.8, [".github/workflows", "gitlab-ci", "Jenkinsfile", "pipeline:", "steps:", "jobs:", "stage:"]),
    "message_queue": (0.8, ["amqplib", "bullmq", "kafka", "SQS", "pubsub", "NATS", "RabbitMQ", "queue.add", "consumer"]),
    "caching": (0.8, ["redis", "memcached", "cache.get", "cache.set", "TTL", "invalidate", "cache-control"]),
    "security": (0.9, ["bcrypt", "argon2", "crypto", "helmet", "cors", "csrf", "XSS", "sanitize", "escape", "Content-Security-Policy"]),
    "file_processing": (0.8, ["multer", "formidable", "fs.createReadStream", "csv-parse", "xlsx", "pdf", "sharp", "imagemagick"]),
    "authentication": (0.9, ["passport", "next-auth", "auth0", "keycloak", "session", "login", "logout", "authenticate"]),
    "api_server": (0.9, ["app.get(", "app.post(", "app.use(", "router.get(", "@Controller", "@Get(", "@Post(", "@ApiOperation", "FastAPI", "@app.route"]),
    "ui_components": (0.85, ["useState", "useEffect", "createComponent", "template:", "<template>", "render()", "jsx", "tsx"]),
    "state_management": (0.8, ["createStore", "dispatch", "useSelector", "createSlice", "atom(", "useRecoilState", "create()", "defineStore"]),
    "email": (0.85, ["nodemailer", "sendgrid", "SES", "mailgun", "postmark", "sendEmail", "smtp"]),
    "scheduling": (0.75, ["cron", "schedule", "setInterval", "recurring", "agenda", "crontab"]),
    "search": (0.8, ["elasticsearch", "algolia", "meilisearch", "typesense", "lunr", "fullTextSearch", "searchIndex"]),
    "ai_ml": (0.85, ["openai", "anthropic", "langchain", "embedding", "vector", "chatCompletion", "inference", "llm"]),
    "logging": (0.7, ["winston", "pino", "bunyan", "morgan", "sentry", "opentelemetry", "datadog", "logger.info", "logger.error"]),
    "authorization": (0.85, ["casl", "casbin", "accesscontrol", "permission", "rbac", "policy", "guard", "can(", "ability"]),
    "graph_visualization": (0.8, ["cytoscape", "d3.select", "chart.js", "recharts", "plotly", "vis-network", "SVG", "canvas"]),
}


def read_definitions(text: str) -> dict[str, tuple[float, list[tuple[str, str]]]]:
    """Capability to (weight, [(kind, signal)]) of a definition text.

    A name without indent opens a capability; below it stand ``weight: 0.9`` and the lists of KINDS, an item a line, with
    or without quotes. Patterns that are no regular expressions are left out, other keys are passed over.
    """
    found: dict[str, tuple[float, list[tuple[str, str]]]] = {}
    name, kind = "", None
    for line in text.splitlines():
        if re.match(r"\S[^#]*:\s*$", line) and not line.startswith("-"):
            name, kind = line.strip()[:-1].strip(), None
            found[name] = (DEFAULT_WEIGHT, [])
        elif not name or not line.strip() or line.lstrip().startswith("#"):
            continue
        elif item := re.match(r"\s+-\s*(.+?)\s*$", line):
            value = item[1].strip("\"'")
            try:
                re.compile(value if kind in ("file", "import", "symbol") else "")
            except re.error:
                continue
            if kind:
                found[name][1].append((kind, value))
        elif key := re.match(r"\s+(\w+):\s*(.*?)\s*$", line):
            if key[2]:
                if key[1] == "weight" and re.fullmatch(r"\d*\.?\d+", key[2]):
                    found[name] = (float(key[2]), found[name][1])
            else:
                kind = KINDS.get(key[1])
    return found


def definitions(spark: SparkSession, custom: str = "", catalogue: bool = True) -> DataFrame:
    """Rows of SCHEMA, and used: by how many other capabilities of the catalogue a catalogue's signal is used (null for other signals)."""
    own = {name: (w, [("content", x) for x in signals]) for name, (w, signals) in CONTENT_SIGNALS.items()} if catalogue else {}
    users: dict[str, set[str]] = {}
    for name, (_, signals) in own.items():
        for _, x in signals:
            users.setdefault(x.lower(), set()).add(name)
    rows = []
    for name, (weight, signals) in (own | read_definitions(custom)).items():
        for nth, (kind, x) in enumerate(signals):
            known = (kind, x) in own.get(name, (0, []))[1]
            rows.append((name, weight, kind, nth, x, len(users[x.lower()] - {name}) if known else None))
    return spark.createDataFrame(rows, f"{SCHEMA}, used int")


def content_hits(texts: DataFrame, keys: list[str], signals: list[str], text: str = "text") -> DataFrame:
    """``keys`` and signal: each different signal that a text holds. Every text is read once, whatever the number of signals."""
    schema = texts.select(*keys).schema.add("signal", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for x in signals:
            machine.add_word(x, x)
        machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for x in sorted({x for _, x in machine.iter(value)}) if value else ():
                    at.append(k)
                    found.append(x)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(found, pa.string())], [*keys, "signal"])

    if not signals:
        return texts.select(*keys, F.lit("").alias("signal")).limit(0)
    return texts.select(*keys, F.col(text)).mapInArrow(scan, schema)


def _matching(value: Column, patterns: dict[str, list[str]]) -> Column:
    """Capabilities of which a pattern is found, in any case of letters."""
    return F.array_compact(F.array(*[F.when(value.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(c)) for c, ps in patterns.items()]))


def detect(files: DataFrame, symbols: DataFrame, imports: DataFrame, defined: DataFrame) -> DataFrame:
    """module, capability, confidence of at least 0.1, evidence.

    ``files`` (module, path, text), ``symbols`` (module, name), ``imports`` (module, name). Content gives up to 4 points
    by the share of a capability's signals, a signal of no other capability counting double and of one other half as
    much again; files 3 by the share of the module's paths; imports 0.6 each, symbols 0.4 each, of five at most. The
    confidence is the share of what the capability's kinds can give, times its weight. A module without any text has no
    content part. The definitions are a rule table; they go through the driver.
    """
    rows = defined.collect()
    patterns: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        patterns.setdefault(r["kind"], {}).setdefault(r["capability"], []).append(r["signal"])
    rules = defined.sparkSession.createDataFrame(
        [(c, next(r["weight"] for r in rows if r["capability"] == c), *(len(patterns.get(k, {}).get(c, [])) for k in KINDS.values())) for c in dict.fromkeys(r["capability"] for r in rows)],
        "capability string, weight double, content int, file int, import int, symbol int",
    )
    modules = files.groupBy("module").agg(F.countDistinct("path").alias("paths"), F.max(F.length("text") > 0).alias("has_text"))

    hits = content_hits(files, ["module"], sorted({r["signal"] for r in rows if r["kind"] == "content"})).distinct()
    factor = F.when(F.col("used") == 0, 2.0).when(F.col("used") == 1, 1.5).otherwise(1.0)
    used = defined.where("kind = 'content'").select("capability", "signal", "nth", factor.alias("factor"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "signal"))), lambda x: x["signal"])
    content = hits.join(F.broadcast(used), "signal").groupBy("module", "capability").agg(F.sum("factor").alias("said"), listed.alias("signals"))

    def counted(table: DataFrame, column: str, kind: str, name: str) -> DataFrame:
        those = patterns.get(kind)
        of = table.select("module", F.explode(_matching(F.col(column), those)).alias("capability"), F.col(column).alias("value")) if those else table.select("module", F.lit("").alias("capability"), F.lit("").alias("value")).limit(0)
        return of.groupBy("module", "capability").agg(F.count("*").alias(name), F.slice(F.array_sort(F.collect_set("value")), 1, 3).alias(f"{name}_first"))

    parts = [content, counted(files.select("module", "path").distinct(), "path", "file", "n_files"), counted(imports, "name", "import", "n_imports"), counted(symbols, "name", "symbol", "n_symbols")]
    joined = modules.join(parts[0].select("module", "capability").unionByName(parts[1].select("module", "capability")).unionByName(parts[2].select("module", "capability")).unionByName(parts[3].select("module", "capability")).distinct(), "module")
    for p in parts:
        joined = joined.join(p, ["module", "capability"], "left")
    joined = joined.join(F.broadcast(rules), "capability")
    five, n = F.lit(5), lambda c: F.coalesce(F.col(c), F.lit(0))
    texts = F.col("has_text") & (F.col("content") > 0)
    points = F.when(texts, F.least(F.coalesce("said", F.lit(0.0)) / F.col("content"), F.lit(1.0)) * 4).otherwise(0.0) + F.least(n("n_files") / F.greatest("paths", F.lit(1)), F.lit(1.0)) * 3 + F.least(n("n_imports"), five) * 0.6 + F.least(n("n_symbols"), five) * 0.4
    most = F.when(texts, 4).otherwise(0) + F.when(F.col("file") > 0, 3).otherwise(0) + F.when(F.col("import") > 0, 3).otherwise(0) + F.when(F.col("symbol") > 0, 2).otherwise(0)
    more = F.when(F.size("signals") > 3, F.concat(F.lit(" (+"), (F.size("signals") - 3).cast("string"), F.lit(")"))).otherwise("")
    evidence = F.concat_ws(
        "; ",
        F.when(F.col("signals").isNotNull(), F.concat(F.lit("content signals: "), F.array_join(F.slice("signals", 1, 3), ", "), more)),
        F.when(F.col("n_files") > 0, F.concat(F.col("n_files").cast("string"), F.lit(" file(s) match"))),
        F.when(F.col("n_imports") > 0, F.concat(F.lit("imports: "), F.array_join("n_imports_first", ", "))),
        F.when(F.col("n_symbols") > 0, F.concat(F.lit("symbols: "), F.array_join("n_symbols_first", ", "))),
    )
    sure = points / most * F.col("weight")
    return joined.where((most > 0) & (sure >= 0.1)).select("module", "capability", half_up(sure, 2).alias("confidence"), evidence.alias("evidence"))


def templates(detected: DataFrame) -> DataFrame:
    """capability, modules (names with confidence, best first), max_confidence: what a capability's template file says."""
    by = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("module").alias("m"))))
    said = F.transform(by, lambda x: F.concat(x["m"], F.lit(": "), F.format_number(-x["c"], 2)))
    return detected.groupBy("capability").agg(said.alias("modules"), F.max("confidence").alias("max_confidence"))
