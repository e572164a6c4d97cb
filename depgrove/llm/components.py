"""Connected components of links, by alternating large and small stars over the link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(rows: DataFrame) -> DataFrame:
    """For each a, the smallest of itself and the b's."""
    return rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Gives node and root: every node with a link, and the smallest node of its component. An error is raised if
    so many rounds are not enough (each about halves the distances, so no graph that fits a disk needs them).

    A large star moves a node's larger neighbours to its smallest one, a small star its smaller ones; each round about halves the
    distance to the root. Minima are pre-aggregated before the shuffle, and tables written between rounds cut the lineage.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = _least(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: still changing after {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
