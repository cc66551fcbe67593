"""The code graph: files, symbols, imports, modules, calls and inheritance, as lazily planned DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import graph


def pattern_filter(column: Column, pattern: str) -> Column:
    """SQL LIKE, ignoring case."""
    return column.ilike(pattern)


class CodeGraph:
    """``load(name)`` gives the relation of that name; every method returns a DataFrame with its documented order by key."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._load(name)

    # lookups and lists
    def list_files(self, module: str | None = None, language: str | None = None, is_test: bool | None = None, limit: int | None = None) -> DataFrame:
        out = self.files
        for column, value in (("module", module), ("language", language), ("is_test", is_test)):
            if value is not None:
                out = out.where(F.col(column) == value)
        out = out.orderBy(F.desc("loc"), "path")
        return out.limit(limit) if limit else out

    def file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def symbols_in_file(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("file") == path).orderBy("line_start", "id")

    def imports_of(self, path: str) -> DataFrame:
        return self.dependencies.where(F.col("source_file") == path).orderBy("target_file", "import_name")

    def imported_by(self, path: str) -> DataFrame:
        return self.dependencies.where(F.col("target_file") == path).orderBy("source_file", "import_name")

    def find_symbols(self, pattern: str, kind: str | None = None, exported: bool | None = None, limit: int | None = None) -> DataFrame:
        out = self.symbols.join(self.files.select(F.col("path").alias("file"), "module"), "file").where(pattern_filter(F.col("name"), pattern))
        if kind is not None:
            out = out.where(F.col("kind") == kind)
        if exported is not None:
            out = out.where(F.col("exported") == exported)
        out = out.orderBy("name", "id")
        return out.limit(limit) if limit else out

    def search_symbol(self, name: str, limit: int = 100) -> DataFrame:
        """Exact hits; with none, or with a wildcard in the name, pattern hits up to ``limit`` (a feature of the search)."""
        placed = self.symbols.join(self.files.select(F.col("path").alias("file"), "module"), "file")
        if "%" in name or "_" in name:
            return placed.where(pattern_filter(F.col("name"), name)).orderBy("name", "id").limit(limit)
        exact = placed.where(F.col("name") == name)
        loose = placed.where(pattern_filter(F.col("name"), f"%{name}%")).orderBy("name", "id").limit(limit)
        none = exact.agg(F.count("*").alias("_n")).where("_n = 0").select("_n")
        return exact.unionByName(loose.join(F.broadcast(none)).drop("_n"))

    def capabilities(self, least: float = 0.2) -> DataFrame:
        return self.module_capabilities.where(F.col("confidence") >= least).orderBy("module_name", F.desc("confidence"), "capability")

    def capability_providers(self, capability: str, least: float = 0.2) -> DataFrame:
        return self.module_capabilities.where((F.col("capability") == capability) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "module_name")

    def capability_map(self) -> DataFrame:
        return self.module_capabilities.groupBy("capability").agg(F.sort_array(F.collect_set("module_name")).alias("modules"), F.max("confidence").alias("max_confidence"))

    def list_warnings(self, module: str | None = None, severity: str | None = None, limit: int | None = None) -> DataFrame:
        out = self.warnings
        for column, value in (("module", module), ("severity", severity)):
            if value is not None:
                out = out.where(F.col(column) == value)
        out = out.orderBy(F.desc("created_at"), "id")
        return out.limit(limit) if limit else out

    # rankings
    def risk_scores(self) -> DataFrame:
        churn = self.change_frequency.select(F.col("file").alias("path"), "changes_30d")
        changes = F.coalesce("changes_30d", F.lit(0).cast("long"))
        out = self.files.where("not is_test and not is_config").join(churn, "path", "left")
        return out.select("path", "module", "complexity_score", changes.alias("changes_30d"), (F.col("complexity_score") * (1 + changes * 0.1)).alias("risk_score"))

    def hotspots(self, limit: int | None = 20) -> DataFrame:
        out = self.risk_scores().orderBy(F.desc("risk_score"), "path")
        return out.limit(limit) if limit else out

    def most_used_interfaces(self, limit: int = 20) -> DataFrame:
        return self.interfaces.orderBy(F.desc("consumer_count"), "id").limit(limit)

    def high_churn(self, limit: int = 20) -> DataFrame:
        return self.change_frequency.orderBy(F.desc("changes_30d"), "file").limit(limit)

    def top_files_per_module(self, most: int = 10) -> DataFrame:
        w = Window.partitionBy("module").orderBy(F.desc("loc"), "path")
        return self.files.select("module", "path", "loc", F.row_number().over(w).alias("nth")).where(F.col("nth") <= most)

    # modules
    def module_listing(self, least: float = 0.3) -> DataFrame:
        """Modules with their capabilities of at least ``least`` (null when there is none)."""
        strong = self.module_capabilities.where(F.col("confidence") >= least).groupBy("module_name").agg(F.array_join(F.sort_array(F.collect_set("capability")), ",").alias("capabilities"))
        return self.modules.join(strong, F.col("name") == F.col("module_name"), "left").drop("module_name")

    def module_api(self, module: str) -> DataFrame:
        own = self.files.where(F.col("module") == module).select(F.col("path").alias("file"))
        return self.symbols.where("exported").join(own, "file").join(self.interfaces.select("name", "file", "consumer_count"), ["name", "file"], "left")

    def module_edges(self) -> DataFrame:
        s, t = (self.files.select(F.col("path").alias(p), F.col("module").alias(m)) for p, m in (("source_file", "source_module"), ("target_file", "target_module")))
        joined = self.dependencies.join(s, "source_file").join(t, "target_file").where("source_module <> target_module")
        return joined.groupBy("source_module", "target_module").agg(F.count("*").alias("edge_count"))

    def module_stats(self) -> DataFrame:
        churn = self.change_frequency.select(F.col("file").alias("path"), "changes_30d")
        mean = F.avg(F.coalesce("changes_30d", F.lit(0).cast("long")))
        g = self.files.join(churn, "path", "left").groupBy("module")
        out = g.agg(F.count("*").alias("file_count"), F.count_if("is_test").alias("test_count"), mean.alias("avg_changes"))
        return out.withColumn("stability", F.when(F.col("avg_changes") <= 1, "high").when(F.col("avg_changes") <= 5, "medium").otherwise("low"))

    def language_stats(self) -> DataFrame:
        return self.files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("total_loc"))

    def complexity_stats(self, long_file: int = 40) -> DataFrame:
        return self.files.groupBy("module").agg(F.count_if(F.col("loc") > long_file).alias("long_files"), F.avg("loc").alias("avg_loc"), F.max("loc").alias("max_loc"))

    # imports
    def edges(self) -> DataFrame:
        return self.dependencies.select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"))

    def interface_consumers(self, edges: DataFrame) -> DataFrame:
        """id, name, file, consumer_count of the interfaces; a file's consumers are counted once, from its distinct ``edges``."""
        consumers = edges.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("consumer_count"))
        own = self.symbols.where("exported").select("id", "name", "file", "kind").distinct()
        return own.join(consumers, "file", "left").select("id", "name", "file", F.coalesce("consumer_count", F.lit(0).cast("long")).alias("consumer_count"))

    def fan_in(self) -> DataFrame:
        return self.dependencies.groupBy("target_file").agg(F.countDistinct("source_file").alias("fan_in"))

    def two_hop(self) -> DataFrame:
        """target, source: files that import an importer of the target."""
        d = self.dependencies.select("source_file", "target_file").distinct()
        up = d.select(F.col("source_file").alias("source"), F.col("target_file").alias("source_file"))
        return d.join(up, "source_file").select(F.col("target_file").alias("target"), "source").distinct()

    def two_hop_sources(self, most: int = 2_000_000) -> DataFrame:
        """target, sources: how many files ``two_hop`` has for each target.

        Files are numbered, and pairs are dealt out by target over as many tasks as keep each to about ``most`` of them.
        """
        d = staged(self.dependencies.select("source_file", "target_file").where("source_file is not null and target_file is not null").distinct(), "links")
        names = staged(d.select(F.explode(F.array("source_file", "target_file")).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
        edges = d.join(names.toDF("source_file", "src"), "source_file").join(names.toDF("target_file", "dst"), "target_file")
        edges = staged(edges.select("src", "dst"), "edges")
        into, out = edges.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("i")), edges.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("o"))
        pairs = into.join(out, "mid").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0]
        tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // most))
        both = edges.toDF("mid", "target").hint("merge").join(edges.toDF("source", "mid"), "mid").select("target", "source")
        counted = both.repartition(tasks, "target").groupBy("target").agg(F.countDistinct("source").alias("sources"))
        return counted.join(names.toDF("name", "target"), "target").select(F.col("name").alias("target"), "sources")

    def consumers(self, path: str) -> DataFrame:
        own = self.files.select(F.col("path").alias("source_file"), "module", "loc")
        return self.dependencies.where(F.col("target_file") == path).join(own, "source_file").select("source_file", "import_name", "import_type", "module", "loc")

    def impact(self, roots: DataFrame, depth: int = 2, mode: str = "set") -> DataFrame:
        """Who is affected by the roots (column ``root``): reverse reach with smallest depth, or rows with their multiplicity."""
        if mode == "rows":
            return graph.impact_rows(self.edges(), roots, depth)
        flipped = self.edges().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return graph.reachable(flipped, roots, depth).where("depth > 0")

    def boundaries(self, roots: DataFrame, depth: int = 2) -> DataFrame:
        """root, boundary: module crossings 'consumer -> root' of the impact."""
        module = self.files.select(F.col("path").alias("node"), F.col("module").alias("consumer"))
        own = self.files.select(F.col("path").alias("root"), F.col("module").alias("owner"))
        hit = self.impact(roots, depth).join(module, "node").join(own, "root").where("consumer <> owner")
        return hit.select("root", F.concat_ws(" -> ", "consumer", "owner").alias("boundary")).distinct()

    def orphan_imports(self) -> DataFrame:
        gone = self.files.select(F.col("path").alias("target_file"))
        return self.dependencies.join(gone, "target_file", "left_anti").where(~F.col("target_file").contains("node_modules"))

    # calls and inheritance
    def callers_of(self, name: str, file: str | None = None) -> DataFrame:
        calls = self.call_graph.where(F.col("callee_name") == name)
        if file is not None:
            calls = calls.where(F.col("callee_file") == file)
        who = self.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller"), "file")
        return calls.join(who, "caller_symbol_id").join(self.files.select(F.col("path").alias("file"), "module"), "file")

    def callees_of(self, name: str, file: str | None = None) -> DataFrame:
        who = self.symbols.where(F.col("name") == name)
        if file is not None:
            who = who.where(F.col("file") == file)
        return self.call_graph.join(who.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller"), "file"), "caller_symbol_id")

    def hierarchy_of(self, name: str) -> DataFrame:
        """role (parent or child), name, file, relation: one step each way."""
        s = self.symbols.select(F.col("id").alias("child_id"), F.col("name").alias("child"), "file")
        h = self.class_hierarchy.join(s, "child_id")
        up = h.where(F.col("child") == name).select(F.lit("parent").alias("role"), F.col("parent_name").alias("name"), F.col("parent_file").alias("file"), "relation")
        return up.unionByName(h.where(F.col("parent_name") == name).select(F.lit("child").alias("role"), F.col("child").alias("name"), "file", "relation"))

    def detect_dead_code(self) -> DataFrame:
        """Unexported functions and classes that call nothing, are never called and never imported by name."""
        own = self.symbols.where("not exported and kind in ('function', 'class', 'method')")
        callers = self.call_graph.select(F.col("caller_symbol_id").alias("id")).distinct()
        callees = self.call_graph.select(F.col("callee_name").alias("name")).distinct()
        names = self.dependencies.select(F.col("import_name").alias("name")).distinct()
        out = own.join(callers, "id", "left_anti").join(callees, "name", "left_anti").join(names, "name", "left_anti")
        return out.select("id", "name", "kind", "file", F.lit("unreferenced").alias("reason"), F.lit(0.6).alias("confidence"))

    # risk and context
    def risk(self, paths: DataFrame) -> DataFrame:
        """One row on a set of files (column ``path``): consumers, two-hop consumers, exports, boundaries, stability, level, reasons."""
        marked = paths.select("path").distinct()
        d = self.dependencies.select("source_file", "target_file").distinct()
        own = d.join(marked.withColumnRenamed("path", "target_file"), "target_file", "left_semi")
        direct = own.groupBy("target_file").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("consumers"))
        hop = own.select(F.col("target_file").alias("root"), F.col("source_file").alias("target_file")).join(d, "target_file").select("root", "source_file").distinct()
        hop = hop.agg(F.count("*").alias("transitive"))
        exports = self.symbols.where("exported").join(marked.withColumnRenamed("path", "file"), "file", "left_semi").agg(F.count("*").alias("exported"))
        mods = self.files.join(marked, "path", "left_semi").select("module").distinct()
        rank = F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2))
        stable = self.modules.join(mods.withColumnRenamed("module", "name"), "name", "left_semi").agg(F.coalesce(F.max(rank[F.col("stability")]), F.lit(0)).alias("stability"))
        s, t = (self.files.select(F.col("path").alias(p), F.col("module").alias(m)) for p, m in (("source_file", "a"), ("target_file", "b")))
        cross = own.join(s, "source_file").join(t, "target_file").where("a <> b").select("a", "b").distinct().agg(F.count("*").alias("boundaries"))
        joined = direct.join(hop).join(exports).join(stable).join(cross)  # one row each
        return score_risk(joined)

    def context(self, paths: DataFrame) -> dict[str, DataFrame]:
        """What to know for a change of the given files, one DataFrame per section."""
        marked = paths.select("path").distinct()
        known = self.files.join(marked, "path")
        out = self.dependencies.join(marked.withColumnRenamed("path", "source_file"), "source_file")
        ins = self.dependencies.join(marked.withColumnRenamed("path", "target_file"), "target_file")
        tests = self.files.where("is_test").select(F.col("path").alias("source_file"))
        return {
            "files": known,
            "unknown": marked.join(self.files, "path", "left_anti"),
            "dependencies": out.select("source_file", "target_file", "import_name").distinct(),
            "consumers": ins.select("source_file").distinct(),
            "interfaces": self.interfaces.join(marked.withColumnRenamed("path", "file"), "file"),
            "tests": ins.join(tests, "source_file", "left_semi").select("source_file").distinct(),
            "capabilities": self.module_capabilities.join(known.select(F.col("module").alias("module_name")).distinct(), "module_name"),
            "risk": self.risk(paths),
        }

    def summary(self) -> DataFrame:
        counts = [(n, self._load(n)) for n in ("files", "symbols", "dependencies", "modules", "interfaces", "module_dependencies")]
        out = None
        for name, df in counts:
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
            out = one if out is None else out.unionByName(one)
        return out


def score_risk(row: DataFrame) -> DataFrame:
    """Add score, level and reasons to consumers, transitive, exported, boundaries and stability (0 to 2)."""
    c, t, b, e, s = (F.col(x) for x in ("consumers", "transitive", "boundaries", "exported", "stability"))
    score = (
        F.when(c > 10, 4).when(c > 5, 3).when(c > 2, 2).when(c > 0, 1).otherwise(0)
        + F.when(t > 20, 3).when(t > 5, 2).when(t > 0, 1).otherwise(0)
        + s
        + F.when(b > 2, 2).when(b > 0, 1).otherwise(0)
        + F.when(e > 5, 1).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(c > 0, F.concat(c.cast("string"), F.lit(" direct consumers"))), F.when(t > 0, F.concat(t.cast("string"), F.lit(" transitive consumers"))),
            F.when(s > 0, F.lit("stable module")), F.when(b > 0, F.concat(b.cast("string"), F.lit(" module boundaries"))), F.when(e > 5, F.concat(e.cast("string"), F.lit(" exports"))),
        )
    )
    return row.withColumn("score", score.cast("long")).withColumn("level", graph.risk_level(F.col("score"))).withColumn("reasons", F.array_join(reasons, "; "))


def tests_near(files: DataFrame, paths: DataFrame, parts: int = 32) -> DataFrame:
    """path, test: tests below the folder of each path (by ancestor folders, an equi-join).

    A folder's paths are dealt over ``parts``, each of which meets all of its tests: pairs grow with the product of both,
    and a few large folders would put them on a few tasks. The number of tasks is given, as adaptive execution would
    join them by what they read, not by what they write.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    split = F.split("test", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(split) - 1), lambda i: F.array_join(F.slice(split, 1, i), "/"))
    near = paths.select("path").distinct().select("path", F.lower(folder).alias("folder"), F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("_part"))
    tests = files.where("is_test").select(F.col("path").alias("test")).select("test", F.explode(above).alias("folder")).withColumn("folder", F.lower("folder"))
    tests = tests.join(near.select("folder").distinct(), "folder", "left_semi").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near, tests = near.repartition(tasks, "folder", "_part"), tests.repartition(tasks, "folder", "_part")
    return near.hint("merge").join(tests, ["folder", "_part"]).select("path", "test")


def affected_files(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """path: the changed files, what they import and who imports them."""
    c = changed.select("path").distinct()
    ups = deps.join(c.withColumnRenamed("path", "target_file"), "target_file", "left_semi").select(F.col("source_file").alias("path"))
    downs = deps.join(c.withColumnRenamed("path", "source_file"), "source_file", "left_semi").select(F.col("target_file").alias("path"))
    return c.union(ups).union(downs).distinct()


def consumer_counts(interfaces: DataFrame, deps: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """id, consumer_count: distinct importing files of the interface's file; of the given files (column path) only, if any."""
    own = interfaces if only is None else interfaces.join(only.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    n = deps.groupBy(F.col("target_file").alias("file")).agg(F.countDistinct("source_file").alias("n"))
    return own.select("id", "file").join(n, "file", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("consumer_count"))


def cycle_gate(found: DataFrame, baseline: DataFrame, changed: list) -> DataFrame:
    """component, members of cycles (see ``graph.cycles``) that the baseline lacks and that touch a changed node."""
    fresh = found.join(baseline.select("members"), "members", "left_anti")
    return fresh.where(F.arrays_overlap("members", F.array(*[F.lit(x) for x in changed]))) if changed else fresh.limit(0)


def cycles_by_modules(cycles: DataFrame, files: DataFrame) -> DataFrame:
    """modules (sorted, joined), cycles, members: cycles (component, members) grouped by the set of modules that they touch."""
    flat = cycles.select("component", F.explode("members").alias("path"))
    touched = flat.join(files.select("path", "module"), "path", "left").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("module")), " <-> ").alias("modules"), F.count("*").alias("n"))
    return touched.groupBy("modules").agg(F.count("*").alias("cycles"), F.sum("n").alias("members"))


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with callee_file and resolved: the symbol of largest id of each name wins."""
    last = symbols.groupBy(F.col("name").alias("callee")).agg(F.max_by("file", "id").alias("callee_file"))
    out = calls.join(last, "callee", "left")
    return out.withColumn("resolved", F.col("callee_file").isNotNull()).withColumn("call_type", F.when(F.col("resolved"), "direct").otherwise("unresolved"))


def resolve_parents(hierarchy: DataFrame, symbols: DataFrame) -> DataFrame:
    """hierarchy with parent_file: the class of smallest id of the parent's name."""
    first = symbols.where("kind = 'class'").groupBy(F.col("name").alias("parent")).agg(F.min_by("file", "id").alias("parent_file"))
    return hierarchy.join(first, "parent", "left")


def visibility(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, visibility: public for index files and files directly under their module's root, else internal."""
    j = files.select("path", "module").join(modules.select(F.col("name").alias("module"), "root_path"), "module")
    direct = F.regexp_replace("path", "/[^/]*$", "") == F.col("root_path")
    barrel = F.col("path").rlike(r"(^|/)(index\.[a-z]+|__init__\.py|mod\.rs)$")
    return j.select("path", F.when(direct | barrel, "public").otherwise("internal").alias("visibility"))
