from pyspark.sql import functions as F

from lodemap.operators import checks, planning


def test_brackets():
    f = checks.first_bracket_error
    assert f("a(b[c]{d})") is None and f("x = '(' // )\n/* [ */ y") is None and f("`a\n${(`") is None
    assert f("a(\nb]") == "2: stray ]" and f("{\n(") == "2: open (" and f("/* x") == "1: open comment" and f("") is None


def test_mutants_are_capped(spark):
    text = "function f(a, b) { return a === b && true; }" + " && true" * 20 + " " * 20
    got = checks.mutants(spark.createDataFrame([("p", text), ("tiny", "a && b"), ("none", None)], "path string, text string")).collect()
    assert len(got) == 10 and {r["path"] for r in got} == {"p"} and got[0]["before"] == "==="


def test_budget_passes_over_what_is_too_large(spark):
    rows = [("a", 1, 6), ("a", 2, 7), ("a", 3, 4), ("b", 1, 11)]
    got = planning.fill_budget(spark.createDataFrame(rows, "plan string, ord int, size int"), "plan", "ord", "size", 10)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 6), ("a", 3, 4)]


def test_small_expressions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(planning.phase_number(F.lit("02.1-name"))) == 2.1 and one(planning.normal_phase(F.lit("3.1"))) == "03.1"
    assert one(planning.template_size(F.lit("### Task 1\n`a.js`"))) == "minimal" and one(planning.template_size(F.lit("a decision"))) == "complex"
    assert one(checks.severity_of(F.lit("serious"))) == "error" and one(planning.concern(F.lit("db/schema.sql"))) == "schema"


def test_byte_diff_and_links(spark):
    df = spark.createDataFrame([("a", b"abcd", b"abxdyy"), ("b", None, b""), ("c", b"q", b"q")], "key string, a binary, b binary")
    assert dict(map(tuple, checks.byte_diff(df).collect())) == {"a": 0.5, "b": 0.0, "c": 0.0}
    links = spark.createDataFrame([("x.js", "go("), ("x.js", "no("), ("gone.js", "go(")], "source string, pattern string")
    files = spark.createDataFrame([("x.js", "go(1)")], "path string, text string")
    assert sorted(r["found"] for r in checks.key_links(links, files).collect()) == [False, False, True]


def test_freshness(spark):
    df = spark.createDataFrame([("graph", "2024-01-01 00:00:00"), ("graph", "2024-01-02 00:00:00"), ("old", "2023-12-01 00:00:00")], "what string, ts string")
    out = checks.freshness(df, F.lit("2024-01-02 12:00:00").cast("timestamp"), F.lit(24.0))
    assert {r["what"]: r["stale"] for r in out.collect()} == {"graph": False, "old": True}


def test_register_and_outcomes_are_whole(spark, tmp_path):
    from lodemap.plans import catalogue

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    table("part", [(k, "Brand#1", "SMALL", 5, 10.0, f"part {k}") for k in range(1, 7)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double, p_name string")
    walk = [1, 2, 3, 1, 4, 5, 6]  # 1, 2 and 3 are a cycle; 4, 5 and 6 hang behind it
    table("lineitem", [(7, n, k, "A") for n, k in enumerate(walk)], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    events = [(k, u, t, 1.0) for k, (u, t) in enumerate([(u, t) for t in ("click", "error", "view") for u in range(10)])]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600))
    df.write.parquet(f"{tmp_path}/events.parquet")

    register = catalogue.queries()["risk_register"](spark, str(tmp_path)).collect()
    assert [(r["subject"], r["metric"], r["level"]) for r in register if r["kind"] == "cycle"] == [("src/Brand#1/p1.js", 3.0, "MEDIUM")]
    assert {r["kind"] for r in register} == {"hotspot", "interface", "cycle", "churn"}

    def verdict(k, user, kind):
        code = user % 3
        if k % 5 == 0:
            return "PASS" if code == 2 else "FAIL"
        if k % 5 == 1:
            return "PASS" if kind == "click" else "FAIL"
        if code:
            return "FAIL"
        if k % 5 == 4:
            return "INCONCLUSIVE"  # the output is empty whatever the event
        return "FAIL" if kind == "error" else "PASS"

    got = dict(map(tuple, catalogue.queries()["evaluate_outcomes"](spark, str(tmp_path)).collect()))
    assert got == {k: verdict(k, u, t) for k, u, t, _ in events}
