"""The system graph: services, their interfaces and the dependencies between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


class SystemGraph:
    """``load(name)`` gives services, service_interfaces and service_dependencies."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self.services = load("services")
        self.interfaces = load("service_interfaces")
        self.dependencies = load("service_dependencies")

    def edges(self) -> DataFrame:
        return self.dependencies.select(F.col("consumer_id").alias("src"), F.col("provider_id").alias("dst"))

    def metrics(self) -> DataFrame:
        """service_id, fan_in, fan_out, interface_count, coupling_score (by the largest product), risk_level."""
        zero = F.lit(0).cast("long")
        ins = self.dependencies.groupBy(F.col("provider_id").alias("id")).agg(F.countDistinct("consumer_id").alias("fan_in"))
        outs = self.dependencies.groupBy(F.col("consumer_id").alias("id")).agg(F.countDistinct("provider_id").alias("fan_out"))
        faces = self.interfaces.groupBy(F.col("service_id").alias("id")).agg(F.count("*").alias("interface_count"))
        out = self.services.select("id").join(ins, "id", "left").join(outs, "id", "left").join(faces, "id", "left").fillna(0)
        most = out.agg(F.max(F.col("fan_in") * F.col("fan_out")).alias("_most"))
        raw = F.col("fan_in") * F.col("fan_out")
        out = out.join(F.broadcast(most)).withColumn("coupling_score", F.when(F.col("_most") > 0, raw / F.col("_most")).otherwise(F.lit(0.0)))
        i, o, c = F.col("fan_in"), F.col("fan_out"), F.col("coupling_score")
        level = F.when(i >= 10, "critical").when((i >= 5) & (o >= 3), "high").when((i >= 3) | (c > 0.5), "medium").otherwise("low")
        return out.select(F.col("id").alias("service_id"), i, o, F.coalesce("interface_count", zero).alias("interface_count"), c, level.alias("risk_level"))

    def hotspots(self, top: int = 10) -> DataFrame:
        return self.metrics().orderBy(F.desc("fan_in"), F.desc("coupling_score"), "service_id").limit(top)

    def overview(self) -> DataFrame:
        """what, n: global counts, interface types and risk levels."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("services", self.services), ("interfaces", self.interfaces), ("dependencies", self.dependencies))]
        parts.append(self.services.agg(F.countDistinct("team").alias("n")).select(F.lit("teams").alias("what"), "n"))
        parts.append(self.interfaces.groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("type:"), "type").alias("what"), "n"))
        parts.append(self.metrics().groupBy("risk_level").agg(F.count("*").alias("n")).select(F.concat(F.lit("risk:"), "risk_level").alias("what"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def registry(self, kind: str | None = None, search: str | None = None) -> DataFrame:
        out = self.interfaces.join(self.services.select(F.col("id").alias("service_id"), "team", "repo"), "service_id")
        if kind is not None:
            out = out.where(F.col("type") == kind)
        if search is not None:
            out = out.where(F.col("name").ilike(f"%{search}%") | F.col("repo").ilike(f"%{search}%") | F.col("service_id").ilike(f"%{search}%"))
        return out

    def imports(self, service: str | None = None) -> DataFrame:
        """Dependencies of a service (or all) with the interface and provider they use, where known."""
        d = self.dependencies if service is None else self.dependencies.where(F.col("consumer_id") == service)
        faces = self.interfaces.select(F.col("id").alias("interface_id"), F.col("name").alias("interface_name"), F.col("type").alias("interface_type"))
        who = self.services.select(F.col("id").alias("provider_id"), F.col("team").alias("provider_team"))
        return d.join(faces, "interface_id", "left").join(who, "provider_id", "left")

    def weighted_edges(self) -> DataFrame:
        return self.dependencies.groupBy("consumer_id", "provider_id", "type").agg(F.count("*").alias("weight"))

    def nodes(self) -> DataFrame:
        m = self.metrics().withColumnRenamed("service_id", "id")
        return self.services.select("id", "repo", "team").join(m, "id", "left")

    def impact(self, roots: DataFrame, depth: int = 2, interface: str | None = None) -> DataFrame:
        """root, node, depth: who consumes a root directly (through a matching interface, if given) or in turn."""
        flipped = self.edges().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if interface is None:
            return graph.reachable(flipped, roots, depth).where("depth > 0")
        faces = self.interfaces.where(F.col("name").ilike(f"%{interface}%")).select(F.col("id").alias("interface_id"))
        first = self.dependencies.join(faces, "interface_id", "left_semi").join(roots, F.col("provider_id") == F.col("root")).select("root", F.col("consumer_id").alias("node")).distinct()
        direct = first.select("root", "node", F.lit(1).alias("depth"))
        onward = graph.reachable(flipped, first.select(F.col("node").alias("root")).distinct(), depth - 1).withColumnRenamed("root", "via")
        later = first.withColumnRenamed("node", "via").join(onward, "via").select("root", "node", (F.col("depth") + 1).alias("depth"))
        every = direct.unionByName(later).where("node <> root")
        return every.groupBy("root", "node").agg(F.min("depth").alias("depth"))

    def team_impact(self, roots: DataFrame, depth: int = 2) -> DataFrame:
        hit = self.impact(roots, depth).join(self.services.select(F.col("id").alias("node"), "team"), "node")
        team = F.coalesce("team", F.lit("unassigned"))
        out = hit.groupBy("root", team.alias("team")).agg(F.count("*").alias("services"), F.array_join(F.sort_array(F.collect_set("node")), ",").alias("ids"))
        teams = out.groupBy("root").agg((F.count("*") > 1).alias("needs_coordination"))
        return out.join(teams, "root")

    def teams(self) -> DataFrame:
        return self.services.where("team is not null").groupBy("team").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("services"), F.count("*").alias("n"))

    def neighbours(self, service: str) -> DataFrame:
        ups = self.dependencies.where(F.col("consumer_id") == service).select(F.col("provider_id").alias("id"))
        return ups.union(self.dependencies.where(F.col("provider_id") == service).select("consumer_id")).distinct()

    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges())

    def path(self, pairs: DataFrame) -> DataFrame:
        return graph.shortest_paths(self.edges(), pairs)

    def validate(self, stale_before: str | None = None) -> DataFrame:
        """check, subject: unused services, dependencies on deprecated interfaces, direct database access, unresolved interfaces."""
        used = self.dependencies.select(F.col("provider_id").alias("id")).union(self.dependencies.select("consumer_id")).distinct()
        unused = self.services.join(used, "id", "left_anti").select(F.lit("unused_service").alias("check"), F.col("id").alias("subject"))
        both = F.concat_ws("->", "consumer_id", "provider_id")
        deprecated = self.dependencies.where("deprecated").select(F.lit("deprecated_dependency").alias("check"), both.alias("subject")).distinct()
        tables = self.interfaces.where("type = 'database'").select(F.col("id").alias("interface_id"))
        direct = self.dependencies.join(tables, "interface_id", "left_semi").select(F.lit("direct_database_access").alias("check"), both.alias("subject")).distinct()
        lost = self.dependencies.where("interface_id is not null").join(self.interfaces.select(F.col("id").alias("interface_id")), "interface_id", "left_anti")
        lost = lost.select(F.lit("unresolved_interface").alias("check"), both.alias("subject")).distinct()
        return unused.unionByName(deprecated).unionByName(direct).unionByName(lost)

    def resolve(self, wanted: DataFrame) -> DataFrame:
        """name, service: fuzzy match of ``name`` by id, with or without the suffix -service, then ignoring case; first rule wins."""
        ids = self.services.select(F.col("id").alias("service"))
        rules = [(0, F.col("name")), (1, F.concat("name", F.lit("-service"))), (2, F.regexp_replace("name", "-service$", ""))]
        tries = [wanted.select("name", e.alias("service"), F.lit(p).alias("rank")).join(ids, "service") for p, e in rules]
        low = wanted.select("name", F.lower("name").alias("low"), F.lit(3).alias("rank")).join(ids.withColumn("low", F.lower("service")), "low").select("service", "name", "rank")
        found = low.select("service", "name", "rank")
        for t in tries:
            found = found.unionByName(t.select("service", "name", "rank"))
        best = found.groupBy("name").agg(F.min_by("service", F.struct("rank", "service")).alias("service"))
        return wanted.join(best, "name", "left")


def find_service(services: DataFrame, path: str) -> DataFrame:
    """The service of a repository path: exact path, else the folder's name as id, else within the repository's name."""
    base = path.rstrip("/").rpartition("/")[2]
    rank = F.when(F.col("repo") == path, 0).when(F.col("id") == base, 1).when(F.col("repo").ilike(f"%{base}%"), 2)
    return services.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def resolve_topics(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (topic) with provider: the exporter (service_id, name, seq) of largest seq of each topic."""
    last = exports.groupBy(F.col("name").alias("topic")).agg(F.max_by("service_id", F.struct("seq", "service_id")).alias("provider"))
    return imports.join(last, "topic", "left")


def task_interfaces(interfaces: DataFrame, service: str, changed: list[str]) -> DataFrame:
    """Exports of a service whose endpoints (array of structs with source) overlap a changed path; all, if none does."""
    own = interfaces.where(F.col("service_id") == service)

    def overlaps(path: str):
        return F.exists("endpoints", lambda e: e["source"].contains(path) | F.lit(path).contains(e["source"]))

    hit = F.lit(False)
    for c in changed:
        hit = hit | overlaps(c)
    marked = own.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    some = marked.agg(F.max("_hit").alias("_some"))
    return marked.join(F.broadcast(some)).where("_hit or not _some").drop("_hit", "_some")


def manifest_diff(old: DataFrame, new: DataFrame, by: str = "service") -> DataFrame:
    """by, added, removed: numbers of exports (type, name) that came and went."""
    keys = [by, "type", "name"]
    a = new.select(*keys).distinct().join(old, keys, "left_anti").groupBy(by).agg(F.count("*").alias("added"))
    r = old.select(*keys).distinct().join(new, keys, "left_anti").groupBy(by).agg(F.count("*").alias("removed"))
    return a.join(r, by, "full").fillna(0, ["added", "removed"])


def ripple(breaking: DataFrame, dependencies: DataFrame, services: DataFrame) -> DataFrame:
    """provider_id, consumers, teams, risk of providers with breaking changes."""
    c = dependencies.join(breaking.select("provider_id").distinct(), "provider_id", "left_semi").select("provider_id", "consumer_id").distinct()
    out = c.join(services.select(F.col("id").alias("consumer_id"), "team"), "consumer_id", "left").groupBy("provider_id")
    out = out.agg(F.count("*").alias("consumers"), F.countDistinct("team").alias("teams"))
    n = F.col("consumers")
    return out.withColumn("risk", F.when(n >= 5, "critical").when(n >= 3, "high").when(n >= 1, "medium").otherwise("low"))
