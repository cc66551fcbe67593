from pyspark.sql import functions as F

from lodemap.operators import code_graph as C
from lodemap.operators import diff, planning, stores
from lodemap.operators import system_graph as S
from lodemap.sources import markdown


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_code(spark):
    files = spark.createDataFrame([("src/a.js", "m", False), ("src/t/a.test.js", "m", True), ("srcab/b.test.js", "m", True)], "path string, module string, is_test boolean")
    one = spark.createDataFrame([("src/a.js",)], "path string")
    assert rows(C.tests_near(files, one)) == [("src/a.js", "src/t/a.test.js")]
    deps = spark.createDataFrame([("x", "src/a.js"), ("src/a.js", "y"), ("p", "q")], "source_file string, target_file string")
    assert rows(C.affected_files(deps, one)) == [("src/a.js",), ("x",), ("y",)]
    faces = spark.createDataFrame([(1, "src/a.js"), (2, "z")], "id int, file string")
    assert rows(C.consumer_counts(faces, deps)) == [(1, 1), (2, 0)] and rows(C.consumer_counts(faces, deps, one)) == [(1, 1)]
    syms = spark.createDataFrame([(1, "f", "class", "a"), (2, "f", "class", "b")], "id int, name string, kind string, file string")
    assert C.resolve_callees(spark.createDataFrame([("f",), ("g",)], "callee string"), syms).orderBy("callee").select("callee_file", "call_type").collect()[0][:] == ("b", "direct")
    assert C.resolve_parents(spark.createDataFrame([("f",)], "parent string"), syms).first()["parent_file"] == "a"
    mods = spark.createDataFrame([("m", "src")], "name string, root_path string")
    assert rows(C.visibility(files, mods)) == [("src/a.js", "public"), ("src/t/a.test.js", "internal"), ("srcab/b.test.js", "internal")]
    cyc = spark.createDataFrame([(1, 2, [1, 2]), (3, 2, [3, 4])], "component int, size int, members array<int>")
    assert [r["component"] for r in C.cycle_gate(cyc, cyc.limit(0), [4]).collect()] == [3] and C.cycle_gate(cyc, cyc, [4]).count() == 0


def test_system(spark):
    s = spark.createDataFrame([("users", "git/users-repo", "t"), ("orders", "/x/orders", None)], "id string, repo string, team string")
    assert S.find_service(s, "/x/orders").first()["id"] == "orders" and S.find_service(s, "/y/users/").first()["id"] == "users" and S.find_service(s, "/q/none").count() == 0
    ex = spark.createDataFrame([("a", "t1", 1), ("b", "t1", 2)], "service_id string, name string, seq int")
    assert rows(S.resolve_topics(spark.createDataFrame([("t1",), ("t2",)], "topic string"), ex)) == [("t1", "b"), ("t2", None)]
    f = spark.createDataFrame([("a", "x", [("src/x.js",)]), ("a", "y", [("src/y.js",)])], "service_id string, name string, endpoints array<struct<source:string>>")
    assert [r["name"] for r in S.task_interfaces(f, "a", ["src/x.js"]).collect()] == ["x"] and S.task_interfaces(f, "a", ["q"]).count() == 2
    old = spark.createDataFrame([("s", "api", "a"), ("s", "api", "b")], "service string, type string, name string")
    new = spark.createDataFrame([("s", "api", "b"), ("s", "rpc", "b")], old.schema)
    assert rows(S.manifest_diff(old, new)) == [("s", 1, 1)]
    d = spark.createDataFrame([(f"c{k}", "p") for k in range(3)], "consumer_id string, provider_id string")
    assert S.ripple(spark.createDataFrame([("p",)], "provider_id string"), d, s).first()["risk"] == "high"


def test_changes(spark):
    a = spark.createDataFrame([("api", "x", "http", ["/a", "/b"]), ("api", "y", "http", None)], "type string, name string, protocol string, routes array<string>")
    b = spark.createDataFrame([("api", "x", "grpc", ["/a"])], a.schema)
    assert {r["finding"] for r in diff.compatibility(a, b).collect()} == {"protocol_change", "removed_endpoint:/b", "removed_interface"}
    docs = spark.createDataFrame([(1, "is VERIFIED, then PARTIAL")], "d int, text string")
    assert rows(diff.verdicts_in(docs, "d")) == [(1, "PARTIAL"), (1, "VERIFIED")]
    assert tuple(diff.drift_total(spark.createDataFrame([(0.0, "GREEN"), (1.0, "RED")], "drift double, level string")).first()) == (0.5, 1, 0, 1)


def test_planning(spark):
    docs = spark.createDataFrame([(1, "title: Fix\narea: ui\n"), (2, "x")], "d int, text string")
    assert rows(planning.todos(docs, "d")) == [(1, "Fix", "ui", "unknown"), (2, "Untitled", "general", "unknown")] and planning.todos(docs, "d", "ui").count() == 1
    ph = spark.createDataFrame([("10-z",), ("2-a",), ("2.1-b",)], "name string")
    assert [r["name"] for r in planning.list_phases(ph).collect()] == ["2-a", "2.1-b", "10-z"] and planning.list_phases(ph, "02").count() == 1
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "phase string")
    assert rows(planning.roadmap_vs_disk(p("1", "2"), p("01", "03"))) == [("02", "not_on_disk"), ("03", "not_in_roadmap")]
    refs = planning.references(spark.createDataFrame([(1, "see @a/b.js and `c/d.js`")], "d int, text string"), spark.createDataFrame([("a/b.js",)], "path string"), "d")
    assert rows(refs) == [(1, "a/b.js", True), (1, "c/d.js", False)]
    body = "intro\n### React\nuse it\n### Go\nno\n"
    assert spark.range(1).select(planning.prune_sections(F.lit(body), ["react"]).alias("x")).first()["x"] == "intro\n### React\nuse it\n"


def test_stores_and_documents(spark):
    st = spark.createDataFrame([(1, "global", "a", True), (2, "module", "Core", True), (3, "phase", "b", True), (4, "module", "z", True), (5, "global", "a", False)], "id int, scope string, module string, active boolean")
    tags = spark.createDataFrame([(3, "P1")], "decision_id int, tag string")
    assert {r["id"] for r in stores.decisions_for(st, tags, "p1", ["core"], []).collect()} == {1, 2, 3}
    d = spark.createDataFrame([(1, '**Phase:** 3\n<task type="auto"><name>n</name><files>a.js, b.js</files><action>do</action></task>\nsee src/a.test.js')], "d int, text string")
    assert rows(markdown.state_fields(d, "d")) == [(1, "Phase", "3")]
    assert rows(markdown.plan_tasks(d, "d")) == [(1, 1, "auto", "n", ["a.js", "b.js"], "do")]
    assert rows(markdown.test_references(d, "d")) == [("src/a.test.js", 1)]
