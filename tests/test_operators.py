import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodemap.functions import text as T
from lodemap.operators import diff, similarity, stores
from lodemap.operators.code_graph import score_risk
from lodemap.sources import manifests, markdown, source_code, tables
from lodemap.streaming import feed, monitor


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_rounding_and_names(spark):
    assert one(spark, T.half_up(F.lit(0.285), 2)) == 0.28
    assert one(spark, T.snake_case(F.lit("OrderItemLine"))) == "order_item_line"
    assert one(spark, T.slug(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, T.loc(F.lit("a\nb\n"))) == 3
    assert one(spark, T.complexity(F.lit("if (a && b) {} else if (c) {}"))) == 5
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty, 1.0)) == 1.0 and one(spark, T.jaccard(empty, empty, 0.0)) == 0.0


def test_risk_levels(spark):
    df = spark.createDataFrame([(11, 21, 6, 2, 3), (0, 0, 0, 0, 0), (1, 1, 0, 0, 1)], "consumers int, transitive int, exported int, stability int, boundaries int")
    assert [(r["score"], r["level"]) for r in score_risk(df).collect()] == [(12, "CRITICAL"), (0, "LOW"), (3, "MEDIUM")]


def test_entropy_numbers(spark):
    f = lambda x: one(spark, diff.health_band(F.lit(x)))
    assert [f(0.29), f(0.3), f(0.5)] == ["green", "yellow", "red"]
    v = lambda a, b: one(spark, diff.verdict(F.lit(a), F.lit(b)))
    assert [v(0.20, 0.25), v(0.20, 0.30), v(0.20, 0.21)] == ["warn", "block", "ok"]
    base = spark.createDataFrame([("a", 0.2, 0.2, 0.5)], "module string, distance double, instability double, cohesion double")
    now = spark.createDataFrame([("a", 0.3, 0.3, 0.5), ("b", 0.1, 0.1, 0.1)], base.schema)
    assert [(r["module"], r["status"]) for r in diff.compare_entropy(base, now).orderBy("module").collect()] == [("a", "degraded"), ("b", "new")]


def test_contracts(spark):
    schema = "provider string, consumer string, endpoint string, response string, status_codes string"
    base = spark.createDataFrame([("p", "c", "/a", "{ id: x, n: y }", "200"), ("p", "c", "/b", None, "200")], schema)
    now = spark.createDataFrame([("p", "c", "/a", "{ id: x }", "200")], schema)
    assert rows(diff.contract_breaks(base, base)) == []
    assert {(r["endpoint"], r["kind"]) for r in diff.contract_breaks(base, now).collect()} == {("/a", "response_changed"), ("/b", "endpoint_removed")}


def test_diff_is_empty_on_itself_and_mirrors(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert rows(diff.diff(a, a, ["k"], ["v"])) == []
    there, back = ({(r["k"], r["change"]) for r in diff.diff(*p, ["k"], ["v"]).collect()} for p in ((a, b), (b, a)))
    swap = {"added": "removed", "removed": "added", "modified": "modified"}
    assert there == {(k, swap[c]) for k, c in back} == {(1, "removed"), (2, "modified"), (3, "added")}


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "use PostgreSQL"), (2, "use MongoDB"), (3, "cache in redis")], "id int, text string")
    got = similarity.tech_conflicts(similarity.tech_mentions(df, "id", "text"), "id").collect()
    assert [(r["tech_a"], r["tech_b"], r["severity"]) for r in got] == [("mongodb", "postgresql", "blocker")]


def test_similar_pairs_match_brute_force(spark):
    import random

    r = random.Random(5)
    sets = [(i, sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 7))})) for i in range(60)]
    got = {(a, b) for a, b, _ in rows(similarity.similar_pairs(spark.createDataFrame(sets, "id int, t array<string>"), "id", "t", 0.6))}
    first = {}
    for i, t in sets:
        first.setdefault(tuple(t), i)
    reps = [(i, set(t)) for t, i in first.items()]
    assert got == {(min(a, b), max(a, b)) for k, (a, x) in enumerate(reps) for b, y in reps[:k] if len(x & y) >= 0.6 * len(x | y)}


def test_stores(spark):
    d = spark.createDataFrame([(1, "t", "use spark for batch", True), (2, "t", "other words", False)], "id int, type string, text string, active boolean")
    new = spark.createDataFrame([(3, "t", "Use Spark, for batch!", True), (4, "t", "other words", True), (5, "u", "use spark for batch", True), (6, "t", "", True)], d.schema)
    assert {r["id"] for r in stores.add_decisions(d, new).collect()} == {4, 5, 6}
    up = tables.upsert(d, d.withColumn("text", F.lit("x")), ["id"])
    assert rows(tables.upsert(up, up, ["id"])) == rows(up)  # idempotent
    lines = spark.createDataFrame([("L", i, f"t{i}") for i in range(1, 14)], "led string, nth long, text string")
    got = rows(stores.compact_ledger(lines, "led"))
    assert len(got) == 11 and ("L", 11, "... 3 earlier lines compacted") in got


def test_snapshots_and_overwrite(spark, tmp_path):
    df = spark.range(3)
    for k in range(4):
        kept = tables.save_snapshot(df, f"file://{tmp_path}/snap", f"2024010{k}", keep=2)
    assert kept == ["20240103", "20240102"]
    tables.overwrite(df, f"file://{tmp_path}/t")
    tables.overwrite(spark.range(5), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5


def test_source_parsing(spark):
    js = "import x, { y } from './lib/u';\nconst z = require('fs');\nexport const Card = () => 1;\nexport default class A extends B {}\nfunction go(a) {\n  return helper(a) + obj.skip(1);\n}\n"
    py = "from os import path\nclass _Hid(Base):\n    def run(self, a: int = 1) -> int:\n        return call(a)\n"
    files = spark.createDataFrame([("src/a.js", "javascript", js), ("src/lib/u.ts", "typescript", ""), ("m.py", "python", py), ("n.py", "python", "def ("), ("e.js", "javascript", "")], "path string, language string, text string")
    syms = source_code.symbols(files)
    assert {(r["path"], r["kind"], r["name"], r["exported"]) for r in syms.collect()} >= {("src/a.js", "component", "Card", True), ("src/a.js", "class", "A", True), ("src/a.js", "function", "go", False), ("m.py", "class", "_Hid", False)}
    imps = source_code.imports(files)
    assert {(r["target"], r["import_type"]) for r in imps.collect()} == {("./lib/u", "default"), ("fs", "require"), ("os", "named")}
    assert rows(source_code.resolve_imports(imps, files)) == [("src/a.js", "./lib/u", "src/lib/u.ts")]
    assert ("src/a.js", "go", "helper", 6) in rows(source_code.calls(files, syms))
    got = {(r["name"], r["signature"]) for r in source_code.python_symbols(files).collect()}
    assert got == {("_Hid", ""), ("run", "(self, a: int=1) -> int")}
    assert ("src/a.js", "A", "extends", "B") in rows(source_code.hierarchy(files))
    mods = spark.createDataFrame([("lib", "src/lib"), ("src", "src")], "name string, root_path string")
    assert dict(rows(source_code.assign_modules(files, mods)))["src/lib/u.ts"] == "lib"


def test_discover(spark, tmp_path):
    for p, t in {"a.js": "1", "node_modules/b.js": "2", ".git/c.py": "3", "d/e.py": "4", "f.txt": "5"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert rows(source_code.discover(spark, str(tmp_path)).select("path", "language")) == [("a.js", "javascript"), ("d/e.py", "python")]


def test_markdown(spark):
    doc = lambda t: spark.createDataFrame([(1, t)], "d int, text string")
    led = markdown.ledger(doc("# L\n## Decisions\n- [2024-01-01T10:00] high: keep it\n- plain\n## Empty\n"), "d").orderBy("nth").collect()
    assert [(r["section"], r["stamp"], r["severity"]) for r in led] == [("Decisions", "2024-01-01T10:00", "high"), ("Decisions", None, None)]
    fm = markdown.front_matter(doc("---\nphase: 1\ntags: [a, b]\n---\nbody"), "d").first()
    assert '"tags": ["a", "b"]' in fm["fields"] and fm["body"] == "body"
    assert rows(markdown.coverage(doc('{"a.js": {"s": {"0": 1, "1": 0}}}'), "d")) == [(1, "a.js", 1, 2)]
    assert rows(markdown.test_counts(doc("Tests: 2 failed, 5 passed, 7 total"), "d")) == [(1, 5, 2)]
    assert rows(markdown.compile_errors(doc("a.ts(3,4): error TS1: bad\nx.py:9: error: no\nfine"), "d")) == [(1, "a.ts", "3", "4", "TS1", "bad"), (1, "x.py", "9", "", "", "no")]
    assert rows(markdown.requirements(doc(""), "d")) == []


def test_manifests(spark):
    docs = spark.createDataFrame([("a", '{"service": {"name": "s"}, "exports": [{"type": "api", "name": "x"}, {"type": "odd", "name": "y"}]}'), ("b", "[1"), ("c", None)], "key string, text string")
    found = {(r["key"], r["path"]) for r in manifests.validate_manifests(manifests.read_manifests(docs)).collect()}
    assert found == {("a", "service.team"), ("a", "exports[1]"), ("b", ""), ("c", "")}
    src = spark.createDataFrame([("p", "app.get('/x', f); axios.get('https://users.svc/v1'); producer.send({ topic: 'orders' })")], "path string, text string")
    got = {(r["direction"], r["type"], r["name"]) for r in manifests.dedup_interfaces(manifests.detect_interfaces(src)).collect()}
    assert {("export", "api", "/x"), ("import", "api", "users.svc"), ("export", "event", "orders")} <= got


def test_incremental_equals_rebuild(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    base = spark.createDataFrame([("a.js", "javascript", "const a = 1;"), ("b.js", "javascript", "const b = 1;")], "path string, language string, text string")
    changes = [("M", "a.js", None, "const a2 = 1;", t(1)), ("R100", "c.js", "b.js", "const c = 1;", t(2)), ("A", "d.js", None, "x", t(3)), ("D", "d.js", None, None, t(4)), ("A", "node_modules/z.js", None, "z", t(5))]
    for k, c in enumerate(changes):
        spark.createDataFrame([c], feed.FEED).coalesce(1).write.parquet(f"{tmp_path}/feed/{k}")
    flat = str(tmp_path / "flat")
    spark.createDataFrame(changes, feed.FEED).coalesce(1).write.parquet(flat)
    target = f"file://{tmp_path}/files"
    tables.overwrite(base, target)
    stream = feed.watch(spark, flat)
    q = feed.maintain(stream, lambda: spark.read.schema(base.schema).parquet(target), lambda df: tables.overwrite(df, target), f"{tmp_path}/ck")
    q.awaitTermination(60)
    got = spark.read.parquet(target)
    assert rows(got) == [("a.js", "javascript", "const a2 = 1;"), ("c.js", "javascript", "const c = 1;")]
    assert rows(feed.derive(got)["symbols"].select("name")) == [("a2",), ("c",)]
    assert feed.plan_update(1000, 10) == "incremental" and feed.plan_update(100, 60) == "full" and feed.plan_update(10, 9) == "incremental"


def test_monitor(spark):
    assert monitor.step(0, "ok", 30, 1) == (0, "warning", True)
    assert monitor.step(0, "warning", 20, 1) == (0, "critical", True)
    assert monitor.step(0, "ok", 30, 61) == (0, "ok", False)
    calls, last, spoke = 0, "warning", []
    for _ in range(10):
        calls, last, s = monitor.step(calls, last, 30, 1)
        spoke.append(s)
    assert sum(spoke) == 2
    p = spark.createDataFrame([("l", "+ a\n- b"), ("l", "+  a \n- b"), ("l", "+ a\n- b\n ctx"), ("l", "+ c")], "loop string, patch string")
    assert [(r["loop"], r["times"]) for r in monitor.stuck_patches(p).collect()] == [("l", 3)]


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = feed.rolling(s).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("rolled")) == rows(feed.rolling(e))
    u = e.select(F.col("path").alias("session"), "ts", F.lit(30.0).alias("remaining"), F.lit(1.0).alias("age"))
    u.write.parquet(f"{tmp_path}/use")
    s = spark.readStream.schema(u.schema).parquet(f"{tmp_path}/use")
    q = monitor.context_alerts(s).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    n = {r["session"]: r["count"] for r in u.groupBy("session").count().collect()}
    got = {r["session"]: r["count"] for r in spark.table("alerts").groupBy("session").count().collect()}
    assert got == {k: 1 + (v - 1) // monitor.EVERY for k, v in n.items()}


def brute_bursts(batches, gap, late):
    """(started, ended, path) of the closed bursts, batch by batch, in milliseconds."""
    seen, held, out = None, [], []
    for batch in batches:
        pieces = [(t, t, {p}) for p, t in batch if t is not None and (seen is None or t + gap >= seen - late)]
        merged = []
        for first, last, paths in sorted(held + pieces, key=lambda x: x[:2]):
            if merged and first <= merged[-1][1] + gap:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] | paths)
            else:
                merged.append((first, last, paths))
        seen = max([last for _, last, _ in merged], default=seen)
        out += [(a, b, p) for a, b, paths in merged if b + gap < seen - late for p in paths]
        held = [x for x in merged if x[1] + gap >= seen - late]
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [feed.HEAVY, 3])
def test_bursts_over_batches(spark, tmp_path, monkeypatch, heavy):
    import random

    monkeypatch.setattr(feed, "CHUNK", 3)
    monkeypatch.setattr(feed, "HEAVY", heavy)
    draw = random.Random(3)
    batches, now = [], 1_700_000_000_000
    for k in range(5):
        at = lambda: draw.choice([draw.randrange(60) * 500, draw.randrange(60_000)])  # noqa: E731  # many lie just ``quiet`` apart
        batches.append([(draw.choice(["a", "b", "c", None]), None if draw.random() < 0.05 else now + at()) for _ in range(40)] if k != 2 else [("late", now - 40_000), (None, None)])
        now += draw.choice([500, 20_000, 55_000])
    for b in batches:
        e = spark.createDataFrame(b, "path string, ms long").select("path", F.timestamp_millis("ms").alias("ts"))
        e.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def run():
        feed.debounce(s, out, f"{tmp_path}/ck").awaitTermination(120)
        got = feed.bursts(spark, out).select(F.unix_millis("started"), F.unix_millis("ended"), "path")
        return sorted(map(tuple, got.collect()), key=str)

    want = brute_bursts(batches, 500, 2000)
    assert run() == want and len({w[0] for w in want}) > 20 and any(a < b for a, b, _ in want) and any(p is None for *_, p in want)
    assert not (tmp_path / "out/batch=0/closed=false").exists()
    for name in ("4", ".4.crc"):  # as if the last batch had ended before it was noted
        (tmp_path / "ck/commits" / name).unlink()
    assert run() == want and (tmp_path / "ck/commits/4").exists()


def test_a_feed_without_events_has_no_bursts(spark, tmp_path):
    s = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path))
    feed.debounce(s, f"{tmp_path}-out", f"{tmp_path}-ck").awaitTermination(60)
    assert feed.bursts(spark, f"{tmp_path}-out").columns == ["started", "ended", "path"] and feed.bursts(spark, f"{tmp_path}-out").isEmpty()
    spark.range(3).selectExpr("'a' AS path", "CAST(NULL AS TIMESTAMP) AS ts").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    feed.debounce(s, f"{tmp_path}-out", f"{tmp_path}-ck2").awaitTermination(60)
    assert feed.bursts(spark, f"{tmp_path}-out").isEmpty()
