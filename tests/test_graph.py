import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodemap.operators import graph

EDGES = "src long, dst long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_micro_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (7, 8)], EDGES)
    assert dict(rows(graph.strong_components(e))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    got = {r["component"]: (r["size"], r["members"]) for r in graph.cycles(e).collect()}
    assert got == {1: (3, [1, 2, 3]), 4: (2, [4, 5]), 6: (1, [6])}
    roots = spark.createDataFrame([(1,)], "root long")
    assert rows(graph.reachable(e, roots)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4)]
    assert rows(graph.reachable(e, roots, 1)) == [(1, 1, 0), (1, 2, 1)]
    pairs = spark.createDataFrame([(1, 5), (5, 1), (1, 1)], EDGES)
    assert rows(graph.shortest_paths(e, pairs)) == [(1, 1, 0, [1]), (1, 5, 4, [1, 2, 3, 4, 5]), (5, 1, -1, None)]
    assert rows(graph.topological_layers(e)) == [(1, -1), (2, -1), (3, -1), (4, -1), (5, -1), (6, 0), (7, 0), (8, 1)]


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGES)
    assert rows(graph.strong_components(e)) == [] and rows(graph.topological_layers(e)) == [] and rows(graph.degrees(e)) == []


def test_impact_rows_keeps_multiplicity(spark):
    # two import rows 2->1, a diamond 3->2, 3->4, 4->1
    e = spark.createDataFrame([(2, 1), (2, 1), (4, 1), (3, 2), (3, 4)], EDGES)
    got = rows(graph.impact_rows(e, spark.createDataFrame([(1,)], "root long"), 2))
    assert got == [(1, 2, 1, 1), (1, 2, 1, 1), (1, 3, 2, 2), (1, 3, 4, 2), (1, 4, 1, 1)]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_components_partition_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(12)]
    reach = {a: {a} for a in range(9)}
    for _ in range(9):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    nodes = {x for e in edges for x in e}
    expect = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    assert dict(rows(graph.strong_components(spark.createDataFrame(edges, EDGES)))) == expect


def test_graph_queries_take_every_lineitem(spark, tmp_path):
    from lodemap.plans import catalogue

    r = random.Random(1)
    lines = [(k, n, r.randrange(40), 1.0) for k in range(14_900, 15_080) for n in range(1, 3)]  # order keys beyond 15,000, small quantities
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(40)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    edges = {(a[2], b[2]) for a, b in zip(lines[::2], lines[1::2], strict=True) if a[2] != b[2] and a[2] % 3 == b[2] % 3}
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    component = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    layer = dict.fromkeys({n for a, b in edges if a < b for n in (a, b)}, 0)
    for a, b in sorted(e for e in edges if e[0] < e[1]):
        layer[b] = max(layer[b], layer[a] + 1)
    root = min(a for a, _ in edges)
    length, todo = {root: 0}, [root]
    for n in todo:
        for a, b in sorted(edges):
            if a == n and b not in length:
                length[b] = length[n] + 1
                todo.append(b)
    got = {q: rows(catalogue.queries()[q](spark, str(tmp_path))) for q in ("graph_nodes", "scc", "cycles", "shortest_path", "topo_layers", "tree_children")}
    assert got["graph_nodes"] == [(n,) for n in sorted(nodes)] and dict(got["scc"]) == component and dict(got["topo_layers"]) == layer
    groups = {c: sorted(n for n in nodes if component[n] == c) for c in set(component.values())}
    assert got["cycles"] == sorted((c, len(g), ",".join(map(str, g))) for c, g in groups.items() if len(g) > 1)
    assert got["shortest_path"] == sorted((root, b, length.get(b, -1)) for b in {b for _, b in edges})
    assert got["tree_children"] == sorted((a, b, k) for a in nodes for k, b in enumerate(sorted(d for s, d in edges if s == a), 1) if k <= 3)


def plain_layers(edges):
    nodes, layer = {n for e in edges for n in e}, {}
    edges = {e for e in edges if e[0] != e[1]}
    while free := {n for n in nodes - set(layer) if all(a in layer for a, b in edges if b == n)}:
        layer |= {n: max([layer[a] + 1 for a, b in edges if b == n], default=0) for n in free}
    return {n: layer.get(n, -1) for n in nodes}


def plain_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    return {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}


def shapes():
    """Runs that meet, loop at a head, share their ends, hang off rings, and random graphs of few edges."""
    def run(*nodes):
        return list(zip(nodes, nodes[1:], strict=False))
    yield run(0, *range(10, 40), 1) + run(1, *range(40, 60), 0) + run(1, *range(60, 75), 2)
    yield run(5, *range(100, 120), 5) + run(5, *range(120, 130), 5) + run(5, *range(130, 140), 6)
    yield run(*range(200, 230), 200) + run(*range(300, 303), 300) + run(400, *range(401, 420), 430) + run(400, *range(440, 445), 430) + [(430, 431), (450, 450)]
    yield run(1, 2, 3, 4, 1) + run(4, 5, 6, 7, 8) + run(8, 9, 6) + [(3, 3)]
    for seed in range(4):
        r = random.Random(seed)
        yield [(r.randrange(40), r.randrange(40)) for _ in range(45)]
        yield [(a, b) if a < b else (b, a) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(40))]


def test_components_and_layers_of_many_shapes(spark):
    """All shapes in one graph, their nodes apart."""
    edges = [(k * 1000 + a, k * 1000 + b) for k, shape in enumerate(shapes()) for a, b in shape]
    df = spark.createDataFrame(edges, EDGES)
    assert dict(rows(graph.strong_components(df))) == plain_components(edges)
    assert dict(rows(graph.topological_layers(df))) == plain_layers(edges)


def test_long_runs_take_logarithmic_rounds(spark, monkeypatch):
    made = []
    plain = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: made.append(name) or plain(df, name))
    n = 10_000
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    got = graph.strong_components(ring)
    assert got.count() == n and got.select("component").distinct().collect() == [(0,)] and len(made) < 20
    made.clear()
    chain = spark.range(5000).selectExpr("id as src", "id + 1 as dst")
    got = graph.topological_layers(chain)
    assert got.count() == 5001 and got.where("layer <> node").isEmpty() and len(made) < 20


def test_walks_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr(graph, "DEPTH_CAP", 2, raising=False)
    e = spark.createDataFrame([(k, k + 1) for k in range(5)], EDGES)
    assert rows(graph.topological_layers(e)) == [(k, k) for k in range(6)]
    assert rows(graph.shortest_paths(e, spark.createDataFrame([(0, 5)], EDGES))) == [(0, 5, 5, [0, 1, 2, 3, 4, 5])]
    assert rows(graph.reachable(e, spark.createDataFrame([(0,)], "root long"))) == [(0, k, k) for k in range(6)]
