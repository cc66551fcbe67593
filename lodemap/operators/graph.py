"""Graph operators over edge DataFrames (``src``, ``dst``), driven level by level.

Every loop keeps its state as written tables in the shared folder, so lineage stays short and survives lost
executors; only counts reach the driver. Self loops and repeated edges are allowed, nodes are whatever the edges name.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.tables import staged

THIN = 6  # edges a node, on average, among which components of a dense graph are looked for first
THIN_ROUNDS = 16  # what is not found by then is found among all edges
STEPS = 8  # layers peeled off between two looks for runs


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: nodes reachable from each root (``root``), with the smallest depth (the root itself: 0).

    All roots are walked together; a level is one join with the edges and one anti join with what was seen.
    """
    edges = staged(distinct_edges(edges), "edges")
    seen = staged(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "seen")
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = staged(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dependency_chain(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """root, src, dst, depth: each edge out of a node less than ``max_depth`` from its root, at the node's smallest depth + 1."""
    near = reachable(edges, roots, max_depth - 1)
    plain = distinct_edges(edges)
    return near.join(plain, near["node"] == plain["src"]).select("root", "src", "dst", (F.col("depth") + 1).alias("depth"))


def impact_rows(edges: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """root, node, via, depth: reverse walk with the multiplicities of the row-counting definition.

    Depth 1 has every edge into the root. A deeper row is an edge into a node of the level before that was not yet
    expanded; a node may appear again through another one until it is expanded itself.
    """
    edges = staged(edges.select("src", "dst"), "edges")
    level = staged(roots.join(edges, roots["root"] == edges["dst"]).select("root", F.col("src").alias("node"), F.col("dst").alias("via"), F.lit(1).alias("depth")), "level")
    expanded = roots.select("root", F.col("root").alias("node"))
    out = level
    for depth in range(2, max_depth + 1):
        expand = staged(level.select("root", "node").distinct().join(expanded, ["root", "node"], "left_anti"), "expand")
        if expand.isEmpty():
            break
        expanded = expanded.unionByName(expand)
        step = expand.join(edges, expand["node"] == edges["dst"]).select("root", F.col("src").alias("hit"), F.col("dst").alias("via"))
        known = expanded.withColumnRenamed("node", "hit")
        level = staged(step.join(known, ["root", "hit"], "left_anti").select("root", F.col("hit").alias("node"), "via", F.lit(depth).alias("depth")), "level")
        out = out.unionByName(level)
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, length, path: the shortest path of each pair (ties: the smallest path); length -1 and null path if none.

    Parents are kept per level, one per node, so the state grows with the nodes and not with the paths.
    """
    edges = staged(distinct_edges(edges), "edges")
    goals = staged(pairs.select("src", "dst").distinct(), "goals")
    seen = staged(goals.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")), "seen")
    frontier = seen
    for depth in count(1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("root", "node").agg(F.min("path").alias("path")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = staged(step.select("root", "node", F.lit(depth).alias("depth"), "path"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        left = goals.join(seen, (goals["src"] == seen["root"]) & (goals["dst"] == seen["node"]), "left_anti")
        if left.isEmpty():
            break
    found = seen.select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("length"), "path")
    return goals.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("length", F.lit(-1)).alias("length"), "path")


def _degrees(live: DataFrame) -> DataFrame:
    """node, n_in, n_out of distinct edges."""
    ends = live.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(live.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def _runs(live: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """node, head, steps, first, least, ring of nodes with one edge in and one out (``links``, ``most`` of them).

    Head is the node before the run of links that each stands on, steps the way from there, first the run's first link.
    Pointers to the node before are doubled, three doublings a table, so a run of n links takes log n of them; least is
    the smallest link on the way. A pointer that is still among links once it spans all of them goes round a ring.
    """
    cur = staged(live.join(links.select(F.col("node").alias("dst")), "dst").select(F.col("dst").alias("node"), F.col("src").alias("head"), F.col("w").alias("steps"), F.col("dst").alias("first"), F.col("dst").alias("least")), "runs")

    def doubled(of: DataFrame) -> DataFrame:
        ahead = of.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"), F.col("first").alias("begin"), F.col("least").alias("other"))
        return of.join(ahead, "head", "left").select("node", F.coalesce("far", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("begin", "first").alias("first"), F.least("least", "other").alias("least"))

    for _ in range(-(-most.bit_length() // 3)):
        cur = staged(doubled(doubled(doubled(cur))), "runs")
    inside = cur.select(F.col("node").alias("head"), F.lit(True).alias("inside"))
    return staged(cur.join(inside, "head", "left").select("node", "head", "steps", "first", "least", F.coalesce("inside", F.lit(False)).alias("ring")), "runs")


def _without_runs(live: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges (src, dst, w) between other nodes, and one from the head of each run to the node behind it."""
    links = runs.select("node", "head", "steps")
    kept = live.join(links.select(F.col("node").alias("dst")), "dst", "left_anti").join(links.withColumnRenamed("node", "src"), "src", "left")
    over = kept.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("steps", F.lit(0))).alias("w"))
    return over.groupBy("src", "dst").agg(F.max("w").alias("w"))


def _shape(live: DataFrame) -> tuple[DataFrame, int, int, int, int]:
    """Degrees, and how many nodes there are, how many without an edge on one side, how many links, how many edges."""
    degrees_ = staged(_degrees(live), "degrees")
    n, ends, links, m = degrees_.agg(F.count("*"), F.count_if(F.expr("n_in = 0 or n_out = 0")), F.count_if(F.expr("n_in = 1 and n_out = 1")), F.sum("n_out")).first()
    return degrees_, n, ends, links, m or 0


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _without(live: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (src, dst, w) between nodes that are not gone."""
    rest = live.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return staged(rest.select("src", "dst", "w"), "live")


def strong_components(edges: DataFrame, ready: bool = False) -> DataFrame:
    """node, component: the smallest mutually reachable node, for every node of the edges.

    Nodes other than whole numbers are numbered in their order, once, and walked as numbers. Edges that are ``ready``
    are distinct, name no nulls and are cheap to read again.
    """
    if not ready:
        edges = staged(distinct_edges(edges), "edges")
    if all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("src", "dst")):
        return _components(edges, staged(_nodes(edges), "nodes"))
    names = staged(_nodes(edges).orderBy("node").select("node", F.monotonically_increasing_id().alias("id")), "names")
    walked = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = _components(staged(walked, "edges"), names.select(F.col("id").alias("node")))
    found = found.join(names.toDF("name", "node"), "node").join(names.toDF("least", "component"), "component")
    return found.select(F.col("name").alias("node"), F.col("least").alias("component"))


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component of distinct edges between ``nodes``.

    While runs of nodes with one edge in and one out make up a good part, each is replaced by one edge; its nodes belong
    to the component of its two ends if that is the same one. In a dense graph, components of an even part of the edges
    become one node each, and the edges between these are gone on with. Nodes without edges on one side go. What is left
    is coloured: the largest label is pushed forward to a fixed point, and from each colour's own node the colour is
    walked backward; whoever is met makes up one component.
    """
    live = edges.where("src <> dst").withColumn("w", F.lit(1))
    done: list[DataFrame] = []
    passed: list[tuple[DataFrame, DataFrame | None]] = []  # runs and the edges behind them, or components of a part of the edges
    before = None  # nodes there were when the graph was thinned last
    while True:
        degrees_, n, ends, links, m = _shape(live)
        if n == 0:
            break
        if links * 4 >= n:
            runs = _runs(live, degrees_.where("n_in = 1 and n_out = 1"), links)
            passed.append((runs, live))
            done.append(runs.where("ring").select("node", F.col("least").alias("component")))
            kept = _without_runs(live, runs.where("not ring")).join(runs.where("ring").select(F.col("node").alias("src")), "src", "left_anti")
            live = staged(kept.where("src <> dst").select("src", "dst", "w"), "live")
        elif m > 2 * THIN * n and (before is None or n * 2 <= before):
            before = n
            part = staged(live.where(F.pmod(F.xxhash64("src", "dst"), F.lit(m)) < THIN * n), "part")
            met = _coloured(part, degrees_.select("node"), THIN_ROUNDS, n // 1000)
            passed.append((met, None))
            over = live.join(met.toDF("src", "a"), "src", "left").join(met.toDF("dst", "b"), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
            live = staged(over.where("src <> dst").distinct().withColumn("w", F.lit(1)), "live")
        elif ends:
            live = _without(live, degrees_.where("n_in = 0 or n_out = 0"))
        else:
            found = _coloured(live, degrees_.select("node"))
            done.append(found)
            live = _without(live, found)
    found = nodes.select("node", F.col("node").alias("component")).limit(0)
    for d in done:
        found = found.unionByName(d)
    for runs, behind in reversed(passed):
        here = staged(found, "components")
        known = here.select("node", F.col("component").alias("c"))
        if behind is None:
            whole = runs.join(known.toDF("component", "c"), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
            found = here.join(runs.select("node"), "node", "left_anti").unionByName(whole)
            continue
        runs = runs.where("not ring")
        last = behind.join(runs.select(F.col("node").alias("src"), F.col("head").alias("of"), "first"), "src").join(runs.select(F.col("node").alias("dst")), "dst", "left_anti")
        # a run's ends are in one component, or are one node, which may stand in none yet
        closed = last.join(known.toDF("of", "ca"), "of", "left").join(known.toDF("dst", "cb"), "dst", "left").where((F.col("of") == F.col("dst")) | (F.col("ca") == F.col("cb")))
        heads = staged(closed.select("of", "first", F.coalesce("ca", "of").alias("component")), "closed-runs")
        whole = runs.join(heads.select("first", "component"), "first").select("node", "component")
        loops = heads.select(F.col("of").alias("node"), "component").distinct().join(here.select("node"), "node", "left_anti")
        found = here.unionByName(whole).unionByName(loops)
    found = staged(found, "components") if passed else found
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    found = found.join(least, "component").select("node", F.col("least").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(live: DataFrame, nodes: DataFrame, most: int | None = None, few: int = 0) -> DataFrame:
    """node, component of those met in one round of colouring and backward walks.

    Only nodes whose colour has changed push it on. Where this ends early, after ``most`` steps either way or with no more
    than ``few`` colours changed, whoever is met still belongs to its component, which may then have others.
    """
    colour = nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("moved"))
    for _ in count() if most is None else range(most):
        pushed = live.join(colour.where("moved").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        colour = staged(colour.join(pushed, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved")), "colour")
        if colour.where("moved").count() <= few:
            break
    colour = colour.drop("moved")
    inner = live.join(colour.toDF("src", "colour"), "src").join(colour.toDF("dst", "colour"), ["dst", "colour"])
    inner = staged(inner.select("src", "dst", "colour"), "inner")
    met = staged(colour.where("node = colour"), "met")
    frontier = met
    for _ in count() if most is None else range(most):
        back = inner.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        frontier = staged(back.join(met, ["node", "colour"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    return staged(met.select("node", F.col("colour").alias("component")), "met")


def cycles(edges: DataFrame, ready: bool = False) -> DataFrame:
    """component, size, members: strong components of more than one node, or of one with a self loop."""
    if not ready:
        edges = staged(distinct_edges(edges), "edges")
    comps = strong_components(edges, ready=True)
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    grouped = comps.join(loops, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"), F.max("loop").alias("loop"))
    return grouped.where("size > 1 or loop").drop("loop")


def topological_layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, layer: layer 0 has the nodes without incoming edges; -1 marks nodes on or behind a cycle (self loops order nothing).

    While runs of nodes with one edge in and one out make up a good part, each becomes one edge of the run's length;
    otherwise layers are peeled off: nodes without incoming edges pass on their layer, and those behind them count down
    their edges, one table a layer. Every step is a distributed one.
    """
    given = staged(distinct_edges(edges), "edges")
    every = _nodes(given)
    every = staged(every.union(nodes.select("node")).distinct() if nodes is not None else every, "nodes")
    live = given.where("src <> dst").withColumn("w", F.lit(1))
    reached = every.select("node", F.lit(0).alias("layer"))
    layers = reached.limit(0)
    passed: list[DataFrame] = []
    while True:
        degrees_, n, _, links, _ = _shape(live)
        if n and links * 4 >= n:
            runs = _runs(live, degrees_.where("n_in = 1 and n_out = 1"), links)
            passed.append(runs)
            ring = runs.where("ring").select(F.col("node").alias("src"))
            kept = _without_runs(live, runs.where("not ring")).join(ring, "src", "left_anti")
            reached = staged(reached.join(runs.select("node"), "node", "left_anti"), "reached")
            live = staged(kept.select("src", "dst", "w"), "live")
            continue
        state = staged(reached.join(degrees_.select("node", "n_in"), "node", "left").select("node", "layer", F.coalesce("n_in", F.lit(0).cast("long")).alias("n_in")), "state")
        peeled: list[DataFrame] = []
        ended = state.where("n_in = 0").isEmpty()
        while not ended and len(peeled) < STEPS:
            free = state.where("n_in = 0").select("node", "layer")
            peeled.append(free)
            pushed = live.join(free.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("layer") + F.col("w")).alias("new"), F.count("*").alias("gone"))
            state = staged(state.where("n_in > 0").join(pushed, "node", "left").select("node", F.greatest("layer", "new").alias("layer"), (F.col("n_in") - F.coalesce("gone", F.lit(0))).alias("n_in")), "state")
            ended = state.where("n_in = 0").isEmpty()
        for free in peeled:
            layers = layers.unionByName(free)
        layers = staged(layers, "layers")
        if ended:
            break
        reached = state.select("node", "layer")
        live = staged(live.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst", "w"), "live")
    for runs in reversed(passed):
        heads = layers.toDF("head", "from")
        layers = staged(layers.unionByName(runs.where("not ring").join(heads, "head").select("node", (F.col("from") + F.col("steps")).alias("layer"))), "layers")
    return every.join(layers, "node", "left").select("node", F.coalesce("layer", F.lit(-1)).alias("layer"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out: distinct neighbours on either side."""
    e = distinct_edges(edges)
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return ins.join(outs, "node", "full").select("node", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def tree_children(edges: DataFrame, most: int = 20) -> DataFrame:
    """src, dst, nth: at most ``most`` children of each node, by name."""
    from pyspark.sql import Window

    return distinct_edges(edges).withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("nth") <= most)


def risk_level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 5, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")
