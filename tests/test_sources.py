import datetime as dt

import pytest

from lodemap.operators import checks, code_graph, stores
from lodemap.sources import source_code, tables
from lodemap.streaming import monitor


def test_a_manifest_that_goes_back_is_synced_again(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(hours=k), x) for k, x in enumerate("ABBA")] + [("b", t, "A"), ("b", t + dt.timedelta(hours=1), "A"), ("c", t, None)]
    out = monitor.changed_services(spark.createDataFrame(rows, "service string, ts timestamp, text string")).collect()
    assert sorted((r["service"], r["ts"].hour) for r in out) == [("a", 0), ("a", 1), ("a", 3), ("b", 0), ("c", 0)]


def test_mutants_by_operator_and_place(spark):
    text = "function f(a, b) {\n  if (a !== b && a < b) return a + b;\n  return a - 1 > 2;\n}\n" + " " * 20
    files = [("src/f.js", text), ("src/vendor/f.js", text), ("src/f.min.js", text), ("f.CSS", text), ("short.js", "a === b"), ("none.js", None)]
    out = checks.mutants(spark.createDataFrame(files, "path string, text string")).collect()
    assert {r["path"] for r in out} == {"src/f.js"}
    assert [(r["operator"], r["line"], r["before"]) for r in out] == [
        ("negate_inequality", 2, "!=="), ("remove_return", 2, "return a + b;"), ("remove_return", 3, "return a - 1 > 2;"), ("boundary_lt", 2, "< "), ("boundary_gt", 3, "> "), ("arith_plus", 2, "+ "), ("arith_minus", 3, "- "),
    ]


def test_nested_calls_count(spark):
    files = spark.createDataFrame([("a.js", "javascript", "function f() {\n g(h(1), x.skip(2), i());\n}")], "path string, language string, text string")
    assert {r["callee"] for r in source_code.calls(files, source_code.symbols(files)).collect()} == {"g", "h", "i"}


def test_promotion_passes_over_what_is_said(spark):
    docs = spark.createDataFrame([(1, "## Decisions\n[2024-01-02 10:00] Use one store\n[2024-01-03 10:00] Use one store!\n## User Preferences\n- \n- Tabs"), (2, None), (3, "")], "k long, text string")
    store = spark.createDataFrame([("x", "preference", "tabs", True)], "id string, type string, text string, active boolean")
    assert [(r["type"], r["text"]) for r in stores.promote_from_ledger(store, docs, "k").collect()] == [("decision", "Use one store")]


def test_cycles_by_modules_of_nothing(spark):
    none = spark.createDataFrame([], "component string, members array<string>, size long")
    assert code_graph.cycles_by_modules(none, spark.createDataFrame([], "path string, module string")).count() == 0


def test_no_folder_of_the_machine_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session)
