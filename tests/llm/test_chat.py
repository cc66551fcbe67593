"""Chat formatting against digests written plainly; layouts; escapes."""

import hashlib
import random

from pyspark.sql import functions as F

from lodemap.llm import chat

SAID = "</s>[INST] ok [/INST]"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def expected(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = [(c, [(r, t) for *_, r, t in sorted(turns)]) for c, turns in held.items()]
    out = []
    for conv, turns in [*convs, (-1, [("user", SAID), ("assistant", SAID)])]:
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(map(str, out))


def test_report_equals_plain_digests(spark):
    r, rows = random.Random(2), []
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/s>", "s>", "INST]", "日", "𝔸", "\n", "ok ", "$1", "<\\s>", "[\\\\/INST]"]
    text = lambda: r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 14)))])
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 4, ["system", "user", "assistant", "user"], ["user"], ["human", "gpt"], ["tool<s>", "assistant", None, ""], ["assistant"]]
    for conv in [*range(150), None, -1]:
        for turn, role in enumerate(r.choice(shapes)):
            rows.append((conv, r.choice([turn] * 9 + [None, 3]), role, text()))
    rows += rows[:3]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, record string, extra int")
    got = chat.chat_report(df).collect()
    want = expected([x for x in rows if x[0] != -1])
    own = expected([x for x in rows if x[0] == -1])
    assert sorted(str(tuple(x)[:5]) for x in got) == sorted(want + [x for x in own if x not in want])
    assert all(x["fits"] for x in got) and {x["layout"] for x in got} == {"messages", "share", "prompt"}
    assert [x["conv_id"] for x in chat.chat_report(df.limit(0)).collect()] == [-1]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    r = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "s>", "/", "INST]", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 10))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("back", chat.unescaped(F.col("e"))).collect()
    assert all(x["back"] == x["t"] and not any(c in x["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]")) for x in got)
    assert len({x["e"] for x in got}) == len({x["t"] for x in got})


def test_layouts_are_told_by_their_paths(spark):
    lines = [
        '{"id": 1, "messages": [{"role": "user", "content": "a", "weight": 1}, {"role": "assistant", "content": "b"}], "tag": {"x": 1}}',
        '{"id": 2, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"id": 4, "instruction": "do", "output": "done", "system": "be"}',
        '{"id": 5, "prompt": "p", "completion": "c"}',
        '{"id": 6, "question": "q", "answer": "a"}',
        '{"id": 7, "data": {"turns": [{"speaker": {"role": "bot"}, "text": "hi"}]}}',
        '{"id": 8, "prompt": "p"}',
        '{"id": 9, "instruction": "do", "input": "", "output": "done"}',
        '{"id": 10, "messages": []}',
    ]
    table = spark.read.json(spark.sparkContext.parallelize(lines))
    got = {x["id"]: x for x in chat.canonical(table.select("id", F.struct(*[c for c in table.columns if c != "id"]).alias("record")), "record").collect()}
    turns = lambda k: [tuple(t) for t in got[k]["turns"]]
    assert turns(1) == turns(2) == [("user", "a"), ("assistant", "b")]
    assert turns(3) == [("user", "do\n\nthis"), ("assistant", "done")] and turns(4) == [("system", "be"), ("user", "do"), ("assistant", "done")]
    assert turns(5) == [("user", "p"), ("assistant", "c")] and turns(6) == [("user", "q"), ("assistant", "a")]
    assert turns(7) == [("assistant", "hi")] and turns(9) == [("user", "do"), ("assistant", "done")]
    assert got[8]["layout"] is None and got[8]["turns"] is None and got[10]["turns"] is None
    assert len({x["fingerprint"] for x in got.values()}) == 9  # 3 and 9 fill the same paths


def test_mask_covers_the_string(spark):
    df = spark.createDataFrame([(1, 0, "user", "é<s>"), (1, 1, "assistant", "a𝔸"), (1, 2, "user", "")], "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(False))
    row = chat.formatted(chat.canonical(chat.as_records(df), "record")).first()
    assert row["formatted"] == "<s>user[INST]é<\\s>[/INST]<s>assistant[/INST]a𝔸</s><s>user[INST][/INST]"
    at, loss = 0, ""
    for run in row["mask"]:
        loss += row["formatted"][at : at + run["chars"]] if run["loss"] else ""
        at += run["chars"]
    assert at == len(row["formatted"]) and loss == "a𝔸"


def test_report_equals_its_sql(spark, tmp_path):
    import duckdb

    bits = ["</s>", "<\\s>", "[INST]", "\\", "x", "é", ""]
    rows = [(k // 4, k % 4, ("system", "user", "assistant", "user")[k % 4], bits[k % 7] + bits[k % 5]) for k in range(80)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    want = sorted(map(str, con.execute(chat.REPORT_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in chat.chat_report(spark.read.parquet(f"{tmp_path}/c.parquet")).collect()) == want
