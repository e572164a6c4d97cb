"""Graph questions over two tables: nodes (vid, id, ...) and edges (src, dst, rel), vids being long and in insertion order.

Edges are a DataFrame or, written once for many searches, `searches.Edges`. Traversals advance a frontier by one join a level, for all queries
(qid) at once; `deep_reachable` and `deep_path` go by parts instead. Of equally short paths the one with the smallest row of vids counts, which
is the first one that a search in vid order finds. Directions: "dependencies" follows edges, "dependents" goes against them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import searches
from .parts import PART_BITS, Parts
from .searches import Edges, Seen, towards, turned
from .tables import Bucketed, buckets, counted_buckets, unsent, written

C = F.col
OPPOSITE = {"dependencies": "dependents", "dependents": "dependencies"}


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of loaded files as the questions here want them: nodes (graph, vid, id, name, version, ecosystem, meta) and edges
    (graph, src, dst, rel) between vids.

    One node per graph and id: the first of its rows gives its place, later metadata goes over earlier; an end of an edge that has no
    node becomes one. Of edges with the same ends the last counts. Places: column seq where there is one, else the order of ids. vids
    grow with graph and place; they are unique, not dense.
    """
    lost = F.lit(None).cast("long")
    rows = nodes.select("graph", "id", (C("seq") if "seq" in nodes.columns else F.lit(0)).cast("long").alias("seq"), F.struct("name", "version", "ecosystem").alias("given"), "meta")
    entries = rows.where("meta IS NOT NULL").select("graph", "id", "seq", F.explode("meta").alias("k", "v")).where("v IS NOT NULL")
    last = entries.groupBy("graph", "id", "k").agg(F.max_by("v", "seq").alias("v"))
    meta = last.groupBy("graph", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("id"))
    name = F.substring_index("id", "==", 1)
    bare = F.struct(name.alias("name"), F.when(F.contains("id", F.lit("==")), F.substr("id", F.length(name) + 3)).otherwise("").alias("version"), F.lit("generic").alias("ecosystem"))
    every = rows.select("graph", "id", "seq", "given").unionByName(ends.select("graph", "id", lost.alias("seq"), F.lit(None).cast(rows.schema["given"].dataType).alias("given")))
    one = every.groupBy("graph", "id").agg(F.min("seq").alias("seq"), F.min_by("given", F.coalesce("seq", F.lit(2**62))).alias("given"))
    one = one.join(meta, ["graph", "id"], "left").withColumn("given", F.coalesce("given", bare))
    placed = one.orderBy("graph", F.asc_nulls_last("seq"), "id").withColumn("vid", F.monotonically_increasing_id())
    out = placed.select("graph", "vid", "id", "given.name", "given.version", "given.ecosystem", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))
    out = written(out, "nodes")
    at = lambda c: out.select("graph", C("vid").alias(f"{c}_vid"), C("id").alias(c))
    seq = C("seq") if "seq" in edges.columns else C("rel")
    merged = edges.withColumn("seq", seq).groupBy("graph", "src", "dst").agg(F.max_by("rel", "seq").alias("rel"))
    named = merged.join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"])
    return out, written(named.select("graph", C("src_vid").alias("src"), C("dst_vid").alias("dst"), "rel"), "edges")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id of nodes (id, seq, meta): the first seq, and the metadata of all rows, later ones over earlier ones."""
    entries = nodes.select("id", "seq", F.explode_outer("meta").alias("k", "v"))
    last = entries.where("k IS NOT NULL AND v IS NOT NULL").groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    meta = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    return nodes.groupBy("id").agg(F.min("seq").alias("seq")).join(meta, "id", "left").withColumn("meta", F.coalesce("meta", F.expr("map()").cast("map<string,string>")))


#: Fixed value: the edges that a task merges; their hash table takes some 130 bytes each.
MERGED_ROWS = 2_000_000


def merged_edges(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per (src, dst) of edges (src, dst, rel, seq): the last relationship counts. rows: about how many edges there are, if that is known; then they go
    to as many tasks as they need before they are merged, and none merges a file's rows where it reads them."""
    if rows is not None:
        edges = edges.repartition(max(buckets(edges.sparkSession), -(-rows // MERGED_ROWS)), "src", "dst")
    return edges.groupBy("src", "dst").agg(F.max_by("rel", "seq").alias("rel"))


def neighbours(nodes: DataFrame, edges: DataFrame, id_: str, direction: str) -> DataFrame:
    """position, package: the direct neighbours in vid order; none for an unknown id."""
    start = nodes.where(F.col("id") == id_).select(F.col("vid").alias("src"))
    found = towards(edges, direction).join(start, "src").select(F.col("dst").alias("vid")).distinct()
    return found.join(unsent(nodes), "vid").select("vid", F.col("id").alias("package"))


def most_depended_upon(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """package, dependents: by number of dependents, then id."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("dependents"))
    named = counts.join(unsent(nodes), F.col("dst") == F.col("vid")).select(F.col("id").alias("package"), "dependents")
    return named.orderBy(F.desc("dependents"), "package").limit(limit)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """package, targets (ids in vid order, joined by a comma; empty without edges)."""
    named = edges.join(unsent(nodes.select(F.col("vid").alias("dst"), F.col("id").alias("target"))), "dst")
    lists = named.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "target"))).alias("to"))
    text = F.array_join(F.transform("to", lambda x: x["target"]), ",")
    return nodes.join(lists, F.col("vid") == F.col("src"), "left").select(F.col("id").alias("package"), F.coalesce(text, F.lit("")).alias("targets"))


def levels(edges: DataFrame | Edges, starts: DataFrame, direction: str, depth: int | None = None, paths: bool = False) -> DataFrame:
    """starts: qid, vid. Gives qid, vid, distance (0 at the starts) and, if paths, the path as an array of vids from the start."""
    return _paths(edges, starts, direction, depth) if paths else searches.distances(edges, starts, direction, depth)


def _paths(edges: DataFrame | Edges, starts: DataFrame, direction: str, depth: int | None, targets: DataFrame | None = None) -> DataFrame:
    """The levels with paths; targets (vid): of one query, which ends with the level that holds its target."""
    edges = Edges.of(edges)
    out = edges.towards(direction, depth)
    seen = Seen("vid", ["qids"], edges.n, lambda df: df.groupBy("vid").agg(F.flatten(F.collect_list("qids")).alias("qids")))
    wanted = [r.vid for r in targets.limit(2).collect()] if targets is not None else []  # one node
    found, distance, tables = {"n": 1, "hits": 0}, 0, []
    level = starts.select("vid", F.array(F.struct("qid", F.array("vid").alias("path"))).alias("ways")).groupBy("vid").agg(F.flatten(F.collect_set("ways")).alias("ways"))
    while True:
        level, found = counted_buckets(level, "vid", "level", edges.n, hits=F.count_if(C("vid").isin(wanted)))
        seen.add(Bucketed(*[df.select("vid", F.transform("ways", lambda w: w["qid"]).alias("qids")) for df in level]))
        tables.append(level.plain.select(F.explode("ways").alias("w"), "vid", F.lit(distance).cast("long").alias("distance")).select("w.qid", "vid", "distance", "w.path"))
        if not found["n"] or found["hits"] or distance == depth:
            return reduce(DataFrame.unionByName, tables)
        distance += 1
        step = searches.stepped(level.by_key, out, found["n"]).select("dst", F.explode("ways").alias("w"))
        step = searches.placed(step, edges.n, "dst")
        step = step.groupBy("dst", "w.qid").agg(F.min(F.concat("w.path", F.array("dst"))).alias("path"))
        step = step.groupBy(C("dst").alias("vid")).agg(F.collect_list(F.struct("qid", "path")).alias("ways"))
        step, before = seen.beside(step)
        none = F.array().cast(f"array<{dict(starts.dtypes)['qid']}>")
        known = reduce(F.array_union, [F.coalesce(qids, none) for (qids,) in before], none)
        fresh = F.filter("ways", lambda w: ~F.array_contains(known, w["qid"]))
        level = step.select("vid", fresh.alias("ways")).where(F.size("ways") > 0)


def starts_at(nodes: DataFrame, *ids: str) -> DataFrame:
    return nodes.where(F.col("id").isin(*ids)).select(F.col("vid").alias("qid"), "vid")


def reachable(nodes: DataFrame, edges: DataFrame | Edges, id_: str, direction: str, depth: int | None = None, start_on_cycle: bool = False) -> DataFrame:
    """package, distance: all that is reached, without the start; start_on_cycle: with it if an edge leads back to it."""
    found = levels(edges, starts_at(nodes, id_), direction, depth)
    out = found.where("distance > 0")
    if start_on_cycle:
        back = unsent(found).join(towards(edges, direction), F.col("vid") == F.col("src")).where("dst = qid").groupBy("qid").agg((F.min("distance") + 1).alias("distance"))
        out = out.unionByName(back.select("qid", F.col("qid").alias("vid"), "distance"))
    return out.join(unsent(nodes), "vid").select(F.col("id").alias("package"), "distance")


def deep_reachable(nodes: DataFrame, edges: DataFrame | Parts, id_: str, direction: str, part_bits: int = PART_BITS) -> DataFrame:
    """The rows of `reachable`, by parts: for graphs that are much deeper than wide, with vids that lie near those of neighbours."""
    parts = edges if isinstance(edges, Parts) else Parts(edges, direction, part_bits)
    return parts.distances(starts_at(nodes, id_)).where("distance > 0").join(unsent(nodes), "vid").select(C("id").alias("package"), "distance")


def deep_path(nodes: DataFrame, edges: DataFrame | Parts, source: str, target: str, direction: str = "dependencies", part_bits: int = PART_BITS) -> DataFrame:
    """The row of `shortest_path`, by parts: distances to the target first, then the way along which they fall. edges as Parts: those of the
    opposite direction."""
    parts = edges if isinstance(edges, Parts) else Parts(edges, OPPOSITE[direction], part_bits)
    start = starts_at(nodes, source).limit(1).collect()
    towards_target = written(parts.distances(starts_at(nodes, target)), "towards")
    there = bool(start) and towards_target.where(C("vid") == start[0].vid).count() > 0
    way = parts.path(towards_target.select("vid", "distance"), start[0].vid) if there else []
    rows = nodes.sparkSession.createDataFrame([(0, v, len(way) - 1, i) for i, v in enumerate(way)], "qid long, at long, distance long, pos int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), ">")
    return rows.join(unsent(nodes.select(C("vid").alias("at"), "id")), "at").groupBy("distance").agg(text.alias("path")).select("path", "distance")


def named_paths(found: DataFrame, nodes: DataFrame, separator: str = ">") -> DataFrame:
    """The rows of `levels` with paths: qid, vid, distance and path as text."""
    steps = found.select("qid", "vid", "distance", F.posexplode("path").alias("pos", "at")).join(unsent(nodes.select(F.col("vid").alias("at"), "id")), "at")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), separator)
    return steps.groupBy("qid", "vid", "distance").agg(text.alias("path"))


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, direction: str = "dependencies") -> DataFrame:
    """path, distance: one row, or none without a path; the node alone if both are the same. The search ends at the target."""
    wanted = nodes.where(C("id") == target).select("vid")
    found = _paths(edges, starts_at(nodes, source), direction, None, wanted)
    return named_paths(found.join(wanted, "vid"), nodes).select("path", "distance")


def impact(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """package, distance, chain: everything that depends on the node, nearest first, each with its chain down to the node."""
    found = levels(edges, starts_at(nodes, id_), "dependents", paths=True).where("distance > 0").withColumn("path", F.reverse("path"))
    return named_paths(found, nodes).join(unsent(nodes), "vid").select(F.col("id").alias("package"), "distance", F.col("path").alias("chain"))


def rendered_chains(chains: DataFrame, max_paths: int = 20) -> DataFrame:
    """Of the rows of `impact` those that a report shows: the nearest, then by package."""
    return chains.orderBy("distance", "package").limit(max(0, max_paths))


def impact_summary(nodes: DataFrame, edges: DataFrame, id_: str, max_paths: int = 20) -> DataFrame:
    direct = lambda d: neighbours(nodes, edges, id_, d).agg(F.count("*").alias(f"direct_{d}"))
    affected = reachable(nodes, edges, id_, "dependents").agg(
        F.count("*").alias("affected"), F.coalesce(F.max("distance"), F.lit(0)).alias("max_distance"),
        F.least(F.count("*"), F.lit(max_paths)).alias("rendered"), F.greatest(F.count("*") - max_paths, F.lit(0)).alias("truncated"),
    )
    return affected.withColumn("direct_dependencies", direct("dependencies").scalar()).withColumn("direct_dependents", direct("dependents").scalar())


def affected(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """package: all that depends on one of the packages (id), directly or not, each once; a package given is among them only if another of
    them is reached from it.

    One search for all of them: a node is passed on with the first two different packages that it was reached from, which is enough to
    tell whether a package given was reached from another."""
    starts = ids.select("id").distinct().join(unsent(nodes), "id").select("vid")
    found = searches.Origins.search(edges, starts, "dependents")
    return found.where("vid <> of").select("vid").distinct().join(unsent(nodes), "vid").select(C("id").alias("package"))


def neighbourhood_edges(edges: DataFrame, found: DataFrame, direction: str, depth: int) -> DataFrame:
    """src, dst of the edges out of the nodes that were expanded, also to nodes seen before."""
    expanded = found.where(F.col("distance") < depth).select(F.col("vid").alias("src")).distinct()
    out = towards(edges, direction).join(expanded, "src")
    return out if direction == "dependencies" else out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def batch(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """queries: qid, direction, node, target, kind (nodes or path). Gives qid and result_count: nodes reached, or nodes of the path. All
    queries of a direction advance together, if they are more than go together those of each kind; those for a path end at their target."""
    out, edges = [], Edges.of(edges)
    together = searches.BITS * searches.COLUMNS
    few = queries.limit(together + 1).count() <= together
    for direction in ("dependencies", "dependents"):
        asked = queries.where(C("direction") == direction)
        starts = lambda rows: rows.join(unsent(nodes), C("node") == C("id")).select("qid", "vid")
        plain, routes = asked.where("kind <> 'path'"), asked.where("kind = 'path'")
        ends = routes.join(unsent(nodes), C("target") == C("id")).select("qid", "vid")
        if few:
            found = searches.answers(edges, starts(plain).unionByName(starts(routes).join(ends, "qid", "left_semi")), ends, direction)
            n = F.when(C("kind") == "path", C("distance") + 1).otherwise(C("reached"))
            out.append(asked.join(found, "qid", "left").select("qid", F.coalesce(n, F.lit(0)).alias("result_count")))
            continue
        reached = searches.reach_counts(edges, starts(plain), direction).select("qid", C("reached").alias("n"))
        length = searches.target_distances(edges, starts(routes).join(ends, "qid", "left_semi"), ends, direction).select("qid", (C("distance") + 1).alias("n"))
        out.append(asked.select("qid").join(reached.unionByName(length), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("result_count")))
    return out[0].unionByName(out[1])


def synthetic(spark, n: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The chain graph: i to i + 1 .. i + fanout."""
    nodes = spark.range(n).select(F.col("id").alias("vid"), F.concat(F.lit("pkg-"), "id", F.lit("==1")).alias("id"))
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(fanout))).alias("by"))
    return nodes, edges.select("src", (F.col("src") + F.col("by")).alias("dst"), F.lit(1).alias("rel")).where(F.col("dst") < n)


def cross_ecosystem_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are of different kinds; nodes: vid, id, kind."""
    ends = edges.join(nodes.select(F.col("vid").alias("src"), F.col("kind").alias("source_kind")), "src")
    return ends.join(nodes.select(F.col("vid").alias("dst"), F.col("kind").alias("target_kind")), "dst").where("source_kind <> target_kind")
