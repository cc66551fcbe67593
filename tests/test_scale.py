"""What keeps work in proportion to the input: small joins, work dealt out over the tasks."""

import pytest

from lodemap.llm import spelling
from lodemap.operators import code_graph, graph, stores
from lodemap.sources import manifests, source_code, structure
from lodemap.streaming import feed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_meet_by_rare_words_only(spark, monkeypatch):
    rows = [(i, "user", f"able also any w{i // 2} x{i // 2} y{i // 2} z{i // 2} {'q' if i % 4 else 'r'}{i}", True) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, type string, text string, active boolean")
    kept = {}

    def staged(df, name, real=stores.staged):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(stores, "staged", staged)
    got = {r["id"] for r in stores.add_decisions(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.8).select("id").collect()}
    assert got == {i for i in range(400) if i % 2}  # 7 words of 9 in common, less than the bound
    assert {r["id"] for r in stores.add_decisions(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.7).select("id").collect()} == set()
    assert kept["decision-words"].where("word in ('able', 'also', 'any')").isEmpty()  # all 400 would meet there


def test_decisions_by_brute_force(spark):
    import random

    draw = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, draw.choice(["a", "b", None]), " ".join(draw.sample(words, draw.randrange(0, 9))) if draw.random() < 0.95 else None, draw.random() < 0.8) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, type string, text string, active boolean")
    for least in (0.5, 0.8, 1.0):
        got = {r["id"] for r in stores.add_decisions(d.where("id % 2 = 0"), d.where("id % 2 = 1"), least).select("id").collect()}
        held = [(t, set(x.split())) for i, t, x, on in rows if i % 2 == 0 and on and t is not None and x is not None]
        want, met = set(), set()
        for i, t, x, _ in rows:
            w = None if x is None else frozenset(x.split())
            if i % 2 and (t, w) not in met:
                met.add((t, w))
                if w is None or not any(u == t and (len(w & v) / len(w | v) if w | v else 1.0) >= least for u, v in held):
                    want.add(i)
        assert got == want


def test_import_candidates_are_not_sent_through_the_driver(spark):
    p = spark.range(50).selectExpr("concat('src/m', id, '/a.js') AS path", "'./b' AS target")
    files = spark.createDataFrame([("src/m3/b.js",), ("src/m3/b/index.js",)], "path string")
    got = source_code.resolve_imports(p, files)
    assert "Broadcast" not in plan_of(got) and [r["target_file"] for r in got.collect()] == ["src/m3/b.js"]


def test_parsers_are_dealt_out(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.range(40).selectExpr("concat('f', id) AS path", "'javascript' AS language", "'function f() {}' AS text").coalesce(1)
    assert structure.symbols(files).rdd.getNumPartitions() == n and structure.symbols(files).count() == 40
    docs = files.selectExpr("path AS key", "'{\"service\": {\"name\": \"s\"}}' AS text")
    assert manifests.read_manifests(docs).rdd.getNumPartitions() == n and manifests.read_manifests(docs).where("service = 's'").count() == 40


def test_pairs_of_one_folder_lie_on_many_tasks(spark):
    files = spark.range(400).selectExpr("concat('src/a/p', id, '.js') AS path", "id % 4 = 0 AS is_test")
    got = code_graph.tests_near(files, files.where("not is_test"))
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 300 * 100 == got.distinct().count() and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_two_hops_are_counted_in_tasks_of_bounded_size(spark):
    deps = spark.range(600).selectExpr("concat('f', id % 40) AS source_file", "concat('f', (id * 7 + id div 40) % 40) AS target_file", "'x' AS import_name")
    graph = code_graph.CodeGraph({"dependencies": deps.unionByName(deps.limit(1).selectExpr("NULL AS source_file", "target_file", "import_name"))}.get)
    want = sorted(map(tuple, graph.two_hop().where("source is not null").groupBy("target").count().collect()))
    assert sorted(map(tuple, graph.two_hop_sources().collect())) == want
    small = graph.two_hop_sources(most=100)
    assert sorted(map(tuple, small.collect())) == want and "REPARTITION_BY_NUM" in plan_of(small)


def test_meetings_of_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("letter", 50), ("leter", 5), ("lettter", 6), ("better", 9)], "word string, n long")
    got = spelling.near_words(words)
    assert "Broadcast" not in plan_of(got) and {(r["a"], r["b"]) for r in got.collect()} == {("leter", "letter"), ("letter", "lettter"), ("better", "letter")}


def kept_tables(monkeypatch):
    kept = []

    def staged(df, name, real=graph.staged):
        kept.append((name, real(df, name)))
        return kept[-1][1]

    monkeypatch.setattr(graph, "staged", staged)
    return kept


def test_dense_graphs_are_walked_by_numbers_and_on_a_part_of_their_edges(spark, monkeypatch):
    import random

    draw = random.Random(5)
    edges = {(a // 30, draw.randrange(30), b // 30, draw.randrange(30)) for a in range(90) for b in range(90) if a // 30 <= b // 30 for _ in range(2) if draw.random() < 0.9}
    df = spark.createDataFrame([(f"{a}-{i:02}", f"{b}-{k:02}") for a, i, b, k in edges], "src string, dst string")
    kept = kept_tables(monkeypatch)
    got = {(r["component"], r["size"]) for r in graph.cycles(df).collect()}
    assert got == {("0-00", 30), ("1-00", 30), ("2-00", 30)}  # three dense parts, edges lead from each to the later ones only
    sizes = [(n, t.count()) for n, t in kept if n in ("edges", "part")]
    assert sizes[0] == sizes[1] == ("edges", df.distinct().count()) and 0 < dict(sizes)["part"] < sizes[0][1] / 2
    assert all(t.schema["colour"].dataType.typeName() == "long" for n, t in kept if n == "colour")


def test_the_newest_event_is_not_sought_in_one_task(spark, tmp_path):
    from lodemap.sources.adapters import relation

    spark.range(8).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'T' AS p_type", "1 AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id % 8 AS user_id", "timestamp_seconds(id * 86400) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = relation(spark, str(tmp_path), "change_frequency")
    assert "Window" not in plan_of(got)
    want = {f"src/Brand#1/p{k}.js": (sum(i % 8 == k for i in range(32, 40)), sum(i % 8 == k for i in range(9, 40)), 5) for k in range(8)}
    assert {r["file"]: (r["changes_7d"], r["changes_30d"], r["changes_90d"]) for r in got.collect()} == want


def test_the_register_makes_its_edges_once(spark, tmp_path):
    from lodemap.plans import catalogue

    spark.range(6).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'T' AS p_type", "1 AS p_size", "1.0D AS p_retailprice", "concat('n', id) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6).selectExpr("1L AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id % 3 AS l_partkey", "'A' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(6).selectExpr("id AS user_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["risk_register"](spark, str(tmp_path))
    assert not any("lineitem.parquet" in f for f in got.inputFiles())
    found = {(r["kind"], r["subject"]): r["metric"] for r in got.collect()}
    assert found["cycle", "src/Brand#1/p0.js"] == 3.0 and found["interface", "src/Brand#1/p1.js:n1_1"] == 1.0 and found["interface", "src/Brand#1/p4.js:n4_4"] == 0.0


def test_a_layer_takes_one_table(spark, monkeypatch):
    n = 24
    dense = spark.range(n).selectExpr("id AS src").crossJoin(spark.range(n).selectExpr("id AS dst")).where("src < dst")
    kept = kept_tables(monkeypatch)
    got = graph.topological_layers(dense)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(n)]
    assert len(kept) < 2 * n


def most_read(spark, after=-1):
    """(last job's last stage, records that the largest task since has read from a shuffle)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    most, last = 0, after
    for i in range(found.size()):
        stage = found.apply(i)
        if stage.stageId() > after:
            last = max(last, stage.stageId())
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            most = max([most, *[m.get().shuffleReadMetrics().recordsRead() for k in range(tasks.size()) if (m := tasks.apply(k).taskMetrics()).isDefined()]])
    return last, most


@pytest.mark.parametrize("apart", [10, 0.1])
def test_bursts_of_one_feed_do_not_meet_in_one_task(spark, tmp_path, monkeypatch, apart):
    from lodemap.plans import catalogue

    monkeypatch.setattr(feed, "HEAVY", 1000, raising=False)
    n = 6000  # one burst of 16 hours or 10 minutes, then an event much later that closes it
    spark.range(n + 1).selectExpr("id AS user_id", f"timestamp_seconds(id * {apart} + if(id = {n}, 86400, 0)) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before, _ = most_read(spark)
        got = catalogue.queries()["debounced_stream"](spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["paths"] for r in got] == [n]
    assert 0 < most_read(spark, before)[1] < n / 2
