"""The shape that every loader gives: nodes (graph, id, name, version, ecosystem, meta) and edges (graph, src, dst, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP = "map<string,string>"
NODE = f"graph string, id string, name string, version string, ecosystem string, meta {MAP}"
EDGE = "graph string, src string, dst string, rel int"


def files(spark: SparkSession, path: str) -> DataFrame:
    """graph (the file) and text, a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """graph, line (from 0) and text, a row per line of each file."""
    rows = files(spark, path).select("graph", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    return rows.where(F.length(F.trim("text")) > 0)


def node(graph: Column, name: Column, version: Column, ecosystem: Column, id_: Column | None = None, /, **meta: Column) -> list[Column]:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    full = F.create_map(*pairs) if pairs else F.create_map().cast(MAP)
    id_ = F.concat(name, F.lit("=="), version) if id_ is None else id_
    return [graph.alias("graph"), id_.alias("id"), name.alias("name"), version.alias("version"), ecosystem.alias("ecosystem"), F.map_filter(full, lambda k, v: v.isNotNull()).alias("meta")]


def one_per_id(rows: DataFrame) -> DataFrame:
    """A node for each graph and id of rows with a place (seq): the first row's place, name, version and ecosystem, and the metadata of all, that of
    later rows over that of earlier ones; rows of one place stand in the order of what they say."""
    said = F.array_sort(F.collect_list(F.struct("seq", F.array_sort(F.map_entries("meta")).alias("entries"))))
    later = lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k)), m)
    merged = F.aggregate(said, F.create_map().cast(MAP), lambda acc, x: later(acc, F.map_from_entries(x["entries"])))
    first = F.min(F.struct("seq", "name", "version", "ecosystem")).alias("first")
    found = rows.withColumn("seq", F.col("seq").cast("long")).groupBy("graph", "id").agg(first, merged.alias("meta"))
    return found.select("graph", "id", "first.name", "first.version", "first.ecosystem", "meta", "first.seq")
