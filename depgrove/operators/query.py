"""Queries as users write them: their grammar, one function for all operations, and their reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G
from .joins import select_node, select_package
from .tables import unsent

C = F.col
OPERATIONS = ("dependencies", "dependents", "reachable", "path", "most-depended-upon")
SPEC = "use dependencies:NODE, dependents:NODE, dependency-path:SOURCE->TARGET or dependent-path:SOURCE->TARGET"


def specs(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """qid (the place), direction, node, target and kind of queries as text."""
    rows = []
    for text in texts:
        verb, colon, rest = text.partition(":")
        if not colon or not rest:
            raise ValueError(f"{text!r}: {SPEC}")
        if verb in ("dependencies", "dependents"):
            rows.append((len(rows), verb, rest, None, "nodes"))
        elif verb in ("dependency-path", "dependent-path"):
            source, arrow, target = rest.partition("->")
            if not arrow or not source or not target:
                raise ValueError(f"{text!r}: {SPEC}")
            rows.append((len(rows), "dependencies" if verb == "dependency-path" else "dependents", source, target, "path"))
        else:
            raise ValueError(f"{text!r}: {SPEC}")
    if not rows:
        raise ValueError("no queries")
    return spark.createDataFrame(rows, "qid long, direction string, node string, target string, kind string")


def checked(queries: DataFrame) -> DataFrame:
    """The queries of a batch (qid, direction, node, target, kind); reading a row that is none is an error."""
    empty = lambda c: F.coalesce(C(c), F.lit("")) == ""
    fault = (
        F.when(~F.coalesce(C("kind").isin("nodes", "path"), F.lit(False)), "kind must be nodes or path")
        .when(~F.coalesce(C("direction").isin("dependencies", "dependents"), F.lit(False)), "direction must be dependencies or dependents")
        .when(empty("node"), "node must not be empty")
        .when((C("kind") == "path") & empty("target"), "the target of a path must not be empty")
    )
    return queries.withColumn("node", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(C("node")))


def batch_report(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """The queries with their result_count."""
    queries = checked(queries)
    return queries.join(G.batch(nodes, edges, queries), "qid")


def run(nodes: DataFrame, edges: DataFrame, operation: str, node: str | None = None, target: str | None = None, direction: str = "dependencies", limit: int = 10) -> DataFrame:
    """position (from 0) and package of the result; for a ranking also dependents. Nodes are given by id, purl or name. nodes: vid, id, meta."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; known: {', '.join(OPERATIONS)}")
    if operation == "most-depended-upon":
        found = G.most_depended_upon(nodes, edges, limit)
        return _placed(found, F.desc("dependents"), "package")
    if node is None:
        raise ValueError(f"{operation} needs a node")
    node = select_node(nodes, node)
    if operation in ("dependencies", "dependents"):
        return _placed(G.neighbours(nodes, edges, node, operation), "vid").drop("vid")
    if operation == "reachable":
        found = G.levels(edges, G.starts_at(nodes, node), direction).where("distance > 0").join(unsent(nodes), "vid")
        return found.select("distance", C("id").alias("package"))
    if target is None:
        raise ValueError("path needs a target")
    found = G.shortest_path(nodes, edges, node, select_node(nodes, target, "target"), direction)
    return found.select(F.posexplode(F.split("path", ">")).alias("position", "package"))


def _placed(rows: DataFrame, *order) -> DataFrame:
    """A small result with its places: neighbours of one node, or a ranking."""
    from pyspark.sql import Window

    return rows.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def report(result: DataFrame, operation: str) -> DataFrame:
    """result_count, result_kind (nodes, ranking or path) and, of a path, path_found."""
    kind = {"most-depended-upon": "ranking", "path": "path"}.get(operation, "nodes")
    n = F.count("*")
    return result.agg(n.alias("result_count"), F.lit(kind).alias("result_kind"), F.when(F.lit(kind == "path"), n > 0).alias("path_found"))


def path_report(nodes: DataFrame, edges: DataFrame, root: str, package: str) -> DataFrame:
    """How a root comes to need a package: package, path (ids with > between, empty if there is none), path_length, direct_dependents,
    reachable_dependents and cross_ecosystem_edges of the path. nodes: vid, id, ecosystem, meta."""
    package = select_package(nodes, package)
    path = G.shortest_path(nodes, edges, root, package).select(F.split("path", ">").alias("path"))
    pairs = path.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))).alias("x")) if root != package else None
    crossing = F.lit(0).cast("long")
    if pairs is not None:
        of = lambda c: nodes.select(C("id").alias(c), C("ecosystem").alias(f"{c}_ecosystem"))
        ends = pairs.select("x.a", "x.b").join(of("a"), "a").join(of("b"), "b")
        crossing = ends.agg(F.count_if((C("a_ecosystem") != "") & (C("b_ecosystem") != "") & (C("a_ecosystem") != C("b_ecosystem")))).scalar()
    shown = path.agg(F.coalesce(F.first("path"), F.array().cast("array<string>")).alias("path"))
    return shown.select(
        F.lit(package).alias("package"), F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("path_length"),
        G.neighbours(nodes, edges, package, "dependents").agg(F.count("*")).scalar().alias("direct_dependents"),
        G.reachable(nodes, edges, package, "dependents").agg(F.count("*")).scalar().alias("reachable_dependents"), crossing.alias("cross_ecosystem_edges"),
    )
