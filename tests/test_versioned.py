import os

import pytest
from pyspark.sql import functions as F

from lodemap.sources.versioned import Change, Conflict, Store, replace_owned, retried
from lodemap.streaming import feed


def made(spark, n, text="x"):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit(text), "id").alias("t"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_change_writes_what_it_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=4)
    store.commit({"a": Change(["k"], upserts=spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t")))})
    before = size(tmp_path)
    store.commit({"a": Change(["k"], upserts=spark.range(0, 20_000, 200).select(F.col("id").alias("k"), F.sha2(F.concat(F.lit("n"), "id"), 256).alias("t")), deletes=spark.range(1, 20_000, 200).select(F.col("id").alias("k")))})
    assert size(tmp_path) - before < 0.03 * before
    got = store.read("a")
    assert got.count() == 19_900 and got.where("t <> sha2(cast(k as string), 256)").count() == 100 and got.where("k % 200 = 1").isEmpty()
    assert store.read("a", 1).count() == 20_000


def test_merges_null_keys_deletes_and_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=3)
    schema = "k long, j string, m map<string,int>"
    store.commit({"a": Change(["k", "j"], upserts=spark.createDataFrame([(1, None, {"a": 1}), (None, "x", None), (2, "b", {})], schema))})
    want = {(1, None): {"a": 1}, (None, "x"): None, (2, "b"): {}}
    for n in range(7):
        up = [(1, None, {"a": n + 2}), (n, "new", {"n": n})]
        store.commit({"a": Change(["k", "j"], upserts=spark.createDataFrame(up, schema), deletes=spark.createDataFrame([(n - 1, "new"), (None, "x"), (n, "new")], "k long, j string"))})
        want |= {(1, None): {"a": n + 2}, (n, "new"): {"n": n}}
        want.pop((n - 1, "new"), None)
        want.pop((None, "x"), None)
        if n == 4:
            store.compact("a", most=2)
    assert {(r["k"], r["j"]): r["m"] for r in store.read("a").collect()} == want
    store.compact("a", most=0)
    assert all(p["base"] for p in store.manifest()["tables"]["a"]["parts"])
    store.vacuum(1)
    assert {(r["k"], r["j"]): r["m"] for r in store.read("a").collect()} == want and store.compact("a") == store.version()
    store.commit({"a": Change(["k", "j"], replace=True, upserts=spark.createDataFrame([], schema))})
    assert store.read("a").count() == 0


def test_a_reader_sees_a_whole_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    store.commit({t: Change(["k"], upserts=made(spark, 5)) for t in "ab"})
    seen = []
    plain = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, *x: (plain(self, *x), seen.append([store.read(t).count() for t in "ab"]))[0])
    held = store.read("a")
    store.commit({t: Change(["k"], deletes=made(spark, 3).select("k")) for t in "ab"})
    assert seen == [[5, 5], [5, 5]] and [store.read(t).count() for t in "ab"] == [2, 2] and held.count() == 5


def test_two_writers(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}") for _ in range(2))
    one.commit({"a": Change(["k"], upserts=made(spark, 3))})
    version = two.version()
    one.commit({"a": Change(["k"], upserts=made(spark, 1, "one"))})
    with pytest.raises(Conflict):
        two.commit({"a": Change(["k"], upserts=made(spark, 2, "two"))}, expected=version)
    assert rows(two.read("a")) == [(0, "one0"), (1, "x1"), (2, "x2")]
    tried = []

    def change(v):
        if not tried:  # the other writer comes in between
            one.commit({"a": Change(["k"], upserts=made(spark, 1, "again"))})
        tried.append(v)
        return {"a": Change(["k"], upserts=two.read("a", v).where("k = 0").withColumn("t", F.concat("t", F.lit("!"))))}

    retried(two, change)
    assert len(tried) == 2 and rows(one.read("a"))[0] == (0, "again0!")


def test_a_service_is_replaced_in_all_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    deps = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "service string, on string")
    faces = spark.createDataFrame([("s", "i1"), ("t", "i2")], "service string, name string")
    store.commit({"dependencies": Change(["service", "on"], upserts=deps), "interfaces": Change(["name"], upserts=faces)})
    version = replace_owned(store, "service", "s", {"dependencies": deps.where("on = 'b'"), "interfaces": faces.limit(0)})
    assert version == 2 and rows(store.read("dependencies")) == [("s", "b"), ("t", "a")] and rows(store.read("interfaces")) == [("t", "i2")]


def test_a_feed_is_merged_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"files": Change(["path"], upserts=spark.createDataFrame([("a.js", "javascript", "1"), ("b.js", "javascript", "1")], "path string, language string, text string"))})
    batch = spark.createDataFrame([("M", "a.js", None, "2"), ("D", "b.js", None, None), ("A", "c.py", None, "3"), ("A", "node_modules/d.js", None, "4")], "status string, path string, old_path string, text string").withColumn("ts", F.current_timestamp())
    batch.write.parquet(f"{tmp_path}/in")
    for state in ("state", "state", "lost"):  # a lost checkpoint reads the batch again
        feed.maintain_store(feed.watch(spark, f"{tmp_path}/in"), store, "files", f"{tmp_path}/{state}").awaitTermination()
    assert rows(store.read("files")) == [("a.js", "javascript", "2"), ("c.py", "python", "3")] and store.version() == 2
