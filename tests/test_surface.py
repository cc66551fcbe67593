from lodemap import sql
from lodemap.operators import hash_tree as H

FILES = "path string, hash string"


def test_only_changed_folders_are_entered(spark, monkeypatch):
    old = [(f"a/b{i}/c{j}.js", "1") for i in range(30) for j in range(20)] + [("top.js", "1")]
    new = [(p, "2" if p == "a/b7/c3.js" else h) for p, h in old if p != "a/b9/c1.js"] + [("a/b9/c1.js/deep.js", "1")]
    seen = []
    plain = H.staged
    a, b = (H.hash_tree(spark.createDataFrame(x, FILES)) for x in (old, new))
    monkeypatch.setattr(H, "staged", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    got = sorted(map(tuple, H.stale(a, b).collect()))
    assert got == [("a/b7/c3.js", "modified"), ("a/b9/c1.js", "removed"), ("a/b9/c1.js/deep.js", "added")]
    assert sum(d.count() for d in seen) < 12  # of 632 nodes
    assert H.stale(a, a).count() == 0 and H.input_hash(a).collect() != H.input_hash(b).collect()
    none = H.hash_tree(spark.createDataFrame([], FILES))
    assert H.stale(none, none).count() == 0 and H.stale(none, a).count() == len(old)


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = [(f"d{i % 7}/f{i}", str(i)) for i in range(200)]
    one = H.input_hash(H.hash_tree(spark.createDataFrame(rows, FILES).coalesce(1))).collect()
    assert one == H.input_hash(H.hash_tree(spark.createDataFrame(rows[::-1], FILES).repartition(9))).collect() and len(one) == 1


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("a.py", "python", "class A(B):\n    def f(self):\n        return g(1)\n"), ("b", None, None)], "path string, language string, text string").createOrReplaceTempView("some_files")
    ask = lambda f, c: sorted(map(tuple, spark.sql(f"SELECT {c} FROM some_files s, LATERAL {f}(s.path, s.language, s.text) e").collect()))
    assert ask("extract_symbols", "e.path, e.kind, e.name, e.end_line") == [("a.py", "class", "A", 3), ("a.py", "method", "f", 3)]
    assert ask("extract_calls", "e.caller, e.callee") == [("f", "g")] and ask("extract_parents", "e.parent") == [("B",)] and ask("extract_imports", "*") == []
    assert spark.catalog.dropTempView("some_files")
