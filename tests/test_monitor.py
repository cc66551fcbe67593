"""State that lives as long as it is used: expiry by event time, over several micro-batches."""

import datetime as D


from lodemap.streaming import monitor

AT = D.datetime(2024, 1, 1, tzinfo=D.UTC)
at = lambda s: AT + D.timedelta(seconds=s)


def run(spark, tmp_path, make, batches, schema):
    """Rows of a stream over batches, one file each, and the number of keys in state behind each."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={n}")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in").drop("n")
        q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
        yield sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str), states[-1] if states else 0


def test_cache_gives_the_stored_result_until_it_is_old(spark, tmp_path):
    batches = [[("k", at(0), 1), ("k", at(60), 2)], [("k", at(119), 3), ("k", at(121), 4)], [("j", at(100_000), 5)], [("k", at(100_001), 6)]]
    steps = list(run(spark, tmp_path, lambda df: monitor.cached_stream(df, "2 minutes", "1 minute"), batches, "key string, ts timestamp, result long"))
    got = sorted((r[0], r[2], r[3]) for r in steps[-1][0])
    assert got == [("j", 5, False), ("k", 1, False), ("k", 1, True), ("k", 1, True), ("k", 4, False), ("k", 6, False)]
    assert steps[2][1] == 1  # k has gone once the watermark passed


def test_alerts_start_anew_behind_a_silence(spark, tmp_path):
    batches = [[("s", at(k), 30.0, 1.0) for k in range(3)], [("s", at(4000), 30.0, 1.0)], [("t", at(500_000), 90.0, 1.0)]]
    steps = list(run(spark, tmp_path, lambda df: monitor.context_alerts(df, keep="1 hour", late="1 minute"), batches, "session string, ts timestamp, remaining double, age double"))
    assert [r[2] for r in steps[-1][0]] == ["warning", "warning"] and steps[-1][1] == 1


def test_identical_errors(spark, tmp_path):
    rows = [("a", at(k), e) for k, e in enumerate(["x", "x", "x", "y", "y", None, "y", "y", "y", "x"])]
    steps = list(run(spark, tmp_path, lambda df: monitor.stuck_errors(df, limit=3), [rows[:2], rows[2:6], rows[6:]], "loop string, ts timestamp, error string"))
    assert [(r[2], r[3]) for r in steps[-1][0]] == [("x", 3), ("y", 3)]


def test_hash_gate_is_open_again_behind_a_silence(spark, tmp_path):
    batches = [[("s", at(0), "m"), ("s", at(5), "m")], [("s", at(10), "m2"), ("s", at(8000), "m2")]]
    steps = list(run(spark, tmp_path, lambda df: monitor.changed_services(df, keep="1 hour"), batches, "service string, ts timestamp, text string"))
    assert len(steps[0][0]) == 1 and len(steps[1][0]) == 3
