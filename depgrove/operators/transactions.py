"""What a transaction of a solver does to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .searches import reach_counts

C = F.col
#: Ranks of how an action was found in the graph.
STATUS = ("exact", "candidate", "unmatched")


def dependents_of(nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """node, direct and affected: of each node that was matched, its dependents and all that depends on it, itself if it is on a cycle.
    nodes: vid, id; matches: the rows of joins.transaction_matches."""
    starts = matches.where("node IS NOT NULL").select(C("node").alias("id")).distinct().join(nodes, "id").select("id", C("vid").alias("qid"), "vid")
    found = reach_counts(edges, starts.select("qid", "vid"), "dependents", cycles=True)
    return starts.join(found, "qid").select(C("id").alias("node"), "direct", (C("reached") + C("back")).alias("affected"))


def impact(actions: DataFrame, matches: DataFrame, counts: DataFrame) -> DataFrame:
    """idx, action, status, roles and nodes that were found (in order, with commas), and their direct and affected dependents, of each action.
    counts: node, direct, affected."""
    known = matches.join(counts, "node", "left")
    hit = C("how") != "none"
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(hit, C(c)))), ",").alias(f"{c}s")
    total = lambda c: F.coalesce(F.sum(F.when(hit, C(c))), F.lit(0)).cast("long").alias(c)
    status = F.when(F.bool_or(C("how") == "exact"), "exact").when(F.bool_or(C("how") == "name-arch"), "candidate").otherwise("unmatched").alias("status")
    found = known.groupBy("graph", "idx").agg(status, listed("role"), listed("node"), total("direct"), total("affected"))
    rows = actions.select("graph", "idx", "action").join(found, ["graph", "idx"], "left")
    return rows.select("idx", "action", F.coalesce("status", F.lit("unmatched")).alias("status"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("nodes", F.lit("")).alias("nodes"), F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("affected", F.lit(0)).alias("affected"))


def ordered(rows: DataFrame) -> DataFrame:
    """In the order of a report: what affects most first, then how well it was found, then the transaction's own order."""
    return rows.orderBy(F.desc("affected"), F.array_position(F.array(*map(F.lit, STATUS)), C("status")), "idx")


def summary(rows: DataFrame) -> DataFrame:
    """Of the rows of `impact`."""
    of = lambda c, v, name: F.count_if(C(c) == v).alias(name)
    return rows.agg(
        F.count("*").alias("actions"), of("action", "install", "installs"), of("action", "erase", "erases"), of("action", "upgrade", "upgrades"), F.count_if(C("status") != "unmatched").alias("matched"),
        F.count_if(C("affected") > 0).alias("impacted"), of("status", "exact", "exact"), of("status", "candidate", "candidates"), of("status", "unmatched", "unmatched"),
        F.coalesce(F.sum("affected"), F.lit(0)).alias("affected"), F.coalesce(F.max("affected"), F.lit(0)).alias("most_affected"),
    )


def arches(actions: DataFrame) -> DataFrame:
    """Actions by the architecture of their package, of a change that of the new one."""
    arch = F.coalesce(F.nullif(F.coalesce("package.arch", "new.arch", "old.arch"), F.lit("")), F.lit("unknown"))
    return actions.groupBy(arch.alias("arch")).agg(F.count("*").alias("actions"))
