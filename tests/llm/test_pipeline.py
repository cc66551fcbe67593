import duckdb
import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_columns_and_order(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    want = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(list(p.columns) == want for p in stages[:-1])


def test_each_stage_keeps_what_it_should(stages):
    tox, lines, near, clean, packed = stages
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE toxic = 0").fetchall()}
    assert len(toxic & set(tox.doc_id)) >= 0.9 * len(toxic)
    assert set(lines.doc_id) == set(tox.doc_id) and set(near.doc_id) <= set(lines.doc_id) and set(clean.doc_id) <= set(near.doc_id)
    from test_corpus_operators import components

    rows = list(lines[["doc_id", "text"]].itertuples(index=False, name=None))
    assert set(near.doc_id) == {d for d, _, _, kept in components(rows, corpus_pipeline.PERCENT) if kept} | {d for d, t in rows if not (t or "").split()}
    assert set(packed.doc_id) == set(clean.doc_id)


def test_rows_go_by_id_and_text(spark, tmp_path):
    import random

    r = random.Random(8)
    prose = lambda n=60: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    a, b, c, d, e, f, g = (prose() for _ in range(7))
    rows = [(1, a), (None, near(a)), (None, b), (None, ""), (None, None), (None, ""), (5, c), (5, near(a)), (5, d)]
    rows += [(7, e), (7, e), (7, e), (None, f), (None, near(f)), (None, f), (9, near(g)), (9, g)]
    data = [(i, t, lang, "s", len(t or "")) for (i, t), lang in zip(rows, "abcdefghijklmnopqr", strict=False)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    got = [(x["doc_id"], x["text"]) for x in out]
    for row in [(1, a), (None, b), (None, None), (5, c), (5, d), (7, e)]:
        assert got.count(row) == 1
    assert got.count((None, "")) == 2 and (None, near(a)) not in got and (5, near(a)) not in got
    assert got.count((None, f)) + got.count((None, near(f))) == 1 and got.count((9, g)) + got.count((9, near(g))) == 1
    assert len(got) == 10 and [x["lang"] for x in out if x["doc_id"] == 7] == ["j"]

    spark.createDataFrame([(1, " ".join(a.split()[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.reject_contaminated(spark, docs, str(tmp_path)).collect()
    want = [x for x in rows if x[1] not in (a, near(a))]
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in clean))) == sorted(map(str, want))


def test_stages_equal_plain_versions(spark, stages):
    """Each stage on its own input: the report's SQL, windows of ten words, the tokenizer's ids; the classifier by its score."""
    import hashlib
    import re
    import zlib

    import numpy as np

    from lodemap.llm import linetree, packing, queries, toxicity

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tox, lines, near, clean, packed = stages
    scores = toxicity.score(documents, toxicity.train(documents, queries.table(spark, FOLDER, "labels"))).toPandas()
    assert sorted(tox.doc_id) == sorted(scores[scores.score < 0.5].doc_id)

    con = duckdb.connect()
    con.register("documents", tox)
    want = {d: sha for d, _, _, sha in con.execute(linetree.REPORT_SQL).fetchall()}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in zip(lines.doc_id, lines.text, strict=True)} == want
    assert all(n == len(t) for n, t in zip(lines.n_chars, lines.text, strict=True) if t is not None)

    def windows(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    items = [windows(t)[1] for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    marks = set().union(*items)
    short = {len(m) for m in marks if len(m) < 10}

    def contaminated(text):
        w, own = windows(text)
        return bool(marks & own) or any(tuple(w[i : i + n]) in marks for n in short for i in range(len(w) - n + 1))

    assert sorted(clean.doc_id) == sorted(d for d, t in zip(near.doc_id, near.text, strict=True) if not contaminated(t))

    encoder = packing._Encoder(queries.tokenizer_path()).encoder
    pieces = set()
    for d, t in zip(clean.doc_id, clean.text, strict=True):
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        pieces |= {(d, k, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert set(zip(packed.doc_id, packed.piece, packed.length, packed.ids_crc32, strict=True)) == pieces
    ends = packed.assign(end=packed.offset + packed.length).groupby("sequence_id").agg(n=("length", "sum"), end=("end", "max"))
    assert (ends.n == ends.end).all() and ends.end.max() <= 2048


def test_columns_of_any_type(spark):
    """Maps, arrays and structs pass through, also in repeated rows."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", 200, {"a": 1}, [1, 2], (3, "x")), (1, text, "en", "s", 200, {"a": 1}, [1, 2], (3, "x")), (2, text, "en", "s", 200, None, None, None), (None, "", None, None, None, {}, [], (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, l array<int>, p struct<k:int,v:string>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        want = [(1, {"a": 1}, [1, 2], (3, "x"))] * (1 if name == "minhash_near_dedup" else 2) + [(2, None, None, None)] * (name != "minhash_near_dedup") + [(None, {}, [], (None, None))]
        got = [(x["doc_id"], x["m"], x["l"], x["p"] and tuple(x["p"])) for x in out.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name
