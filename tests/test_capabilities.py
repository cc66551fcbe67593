from lodemap.operators import capabilities as C


def test_definitions():
    text = "# none\nmine:\n  signals:\n    - \"a b\"\n    - 'c'\n  filePatterns:\n    - (open\n    - x.*y\n  agent_context: \"some: text\"\n  weight: 0.25\n\nother:\n  importPatterns:\n    - lib\n"
    assert C.read_definitions(text) == {"mine": (0.25, [("content", "a b"), ("content", "c"), ("file", "x.*y")]), "other": (C.DEFAULT_WEIGHT, [("import", "lib")])}
    assert C.read_definitions("") == {} and C.read_definitions("  - stray\n  weight: 1\n") == {}


def test_custom_definitions_override_and_signals_are_weighed_by_use(spark):
    rows = C.definitions(spark, "caching:\n  signals:\n    - redis\n    - mine\nnew:\n  signals:\n    - redis\n").collect()
    assert [(r["signal"], r["used"]) for r in rows if r["capability"] == "caching"] == [("redis", 0), ("mine", None)]
    assert [(r["signal"], r["used"], r["weight"]) for r in rows if r["capability"] == "new"] == [("redis", None, C.DEFAULT_WEIGHT)]
    assert len({r["capability"] for r in rows}) == len(C.CONTENT_SIGNALS) + 1


def test_hits_overlap_and_empty_texts(spark):
    texts = spark.createDataFrame([(1, "x", "ushers"), (2, "x", None), (3, "x", ""), (4, "x", "hishe he")], "id long, signal_of string, text string")
    got = {tuple(r) for r in C.content_hits(texts, ["id"], ["he", "she", "his", "hers"]).collect()}
    assert got == {(1, "she"), (1, "he"), (1, "hers"), (4, "his"), (4, "he"), (4, "she")}
    assert C.content_hits(texts, ["id"], []).count() == 0 and C.content_hits(texts.limit(0), ["id"], ["he"]).count() == 0


def test_scores_without_texts_have_no_content_part(spark):
    files = spark.createDataFrame([("m", "src/cache/a.js", None), ("m", "src/b.js", "")], "module string, path string, text string")
    names = spark.createDataFrame([("m", "getCache")] * 7, "module string, name string")
    custom = "c:\n  signals:\n    - redis\n  filePatterns:\n    - CACHE\n  symbolPatterns:\n    - getcache\n  weight: 1\n"
    got = C.detect(files, names, names.limit(0), C.definitions(spark, custom, catalogue=False)).collect()
    assert [tuple(r) for r in got] == [("m", "c", 0.7, "1 file(s) match; symbols: getCache")]  # (1.5 + 2) / 5
    assert C.templates(C.detect(files, names, names.limit(0), C.definitions(spark, custom, catalogue=False))).first()["modules"] == ["m: 0.70"]
