"""Registered queries for graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import searches
from ..operators.tables import unsent
from .derive import table, with_

ROOT, PART, HUB = "customer:7", "part:11", "nation:3"


def _d(spark, sf):
    return table(spark, sf, "nodes"), table(spark, sf, "edges")


def _p(spark, sf):
    return table(spark, sf, "pnodes"), table(spark, sf, "pedges")


def _bfs(edges: str, nodes: str, start: str, forward: bool = True) -> str:
    """All nodes reached from a start, with the distance and the smallest path."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""r(n, d, p) USING KEY (n) AS (
      SELECT vid, 0::BIGINT, [vid] FROM {nodes} WHERE id = '{start}'
      UNION
      SELECT dst, min(d) + 1, min(list_append(p, dst)) FROM (
        SELECT e.{b} AS dst, r.d, r.p FROM r JOIN {edges} e ON e.{a} = r.n WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.n = e.{b})) GROUP BY dst)"""


def _batch(spark, sf):
    nodes, edges = _p(spark, sf)
    asked = spark.createDataFrame(
        [(1, "dependencies", "p0", None, "nodes"), (2, "dependents", "p5", None, "nodes"), (3, "dependencies", "p0", "p17", "path"), (4, "dependents", "p9", "p3", "path"), (5, "dependencies", "none", None, "nodes")],
        "qid long, direction string, node string, target string, kind string",
    )
    return G.batch(nodes, edges, asked)


def _khop(spark, sf):
    nodes, edges = _d(spark, sf)
    return G.reachable(nodes, edges, PART, "dependents", depth=2)


def _khop_edges(spark, sf):
    nodes, edges = _d(spark, sf)
    found = G.levels(edges, G.starts_at(nodes, ROOT), "dependencies", 2)
    return G.neighbourhood_edges(edges, found, "dependencies", 2)


def _paths(spark, sf):
    nodes, edges = _p(spark, sf)
    found = G.levels(edges, G.starts_at(nodes, "p0"), "dependencies", paths=True)
    return G.named_paths(found, nodes).join(unsent(nodes), "vid").select(F.col("id").alias("package"), "distance", "path")


def _chain(spark, sf):
    """The benchmark's graph over the suppliers: each needs the next three. The vids are the places of the keys."""
    nodes = table(spark, sf, "supplier").select((F.col("s_suppkey") - 0).alias("vid"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    by = nodes.select(F.col("vid").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("by"))
    return nodes, by.join(nodes.select(F.col("vid").alias("dst")), F.col("src") + F.col("by") == F.col("dst")).select("src", "dst", F.lit(1).alias("rel"))


def _many(spark, sf):
    """How much each customer and each part needs, for all of them at once."""
    nodes, edges = table(spark, sf, "nodes"), table(spark, sf, "edges", distinct=False)
    asked = nodes.where(F.col("kind").isin("customer", "part"))
    found = searches.reach_counts(edges, asked.select(F.col("vid").alias("qid"), "vid"), "dependencies", cycles=True)
    return found.join(asked.hint("merge"), F.col("qid") == F.col("vid")).select(F.col("id").alias("package"), "direct", "reached", "back")


QUERIES = {
    "graph_nodes": lambda s, d: table(s, d, "nodes").groupBy("kind").agg(F.count("*").alias("n"), F.min("vid").alias("first_vid"), F.max("vid").alias("last_vid")),
    "graph_edges": lambda s, d: _merged(s, d).groupBy("rel").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum")),
    "dependencies": lambda s, d: G.neighbours(*_d(s, d), ROOT, "dependencies"),
    "dependents": lambda s, d: G.neighbours(*_d(s, d), PART, "dependents"),
    "most_depended_upon": lambda s, d: G.most_depended_upon(*_d(s, d), 10),
    "adjacency": lambda s, d: G.adjacency(*_p(s, d)),
    "edge_types": lambda s, d: table(s, d, "edges").groupBy("rel").agg(F.count("*").alias("edges")),
    "reachable_fwd": lambda s, d: G.reachable(*_d(s, d), ROOT, "dependencies"),
    "reachable_rev": lambda s, d: G.reachable(*_d(s, d), HUB, "dependents"),
    "reachable_cyclic": lambda s, d: G.reachable(*_p(s, d), "p0", "dependencies"),
    "rev_reach_incl_start": lambda s, d: G.reachable(*_p(s, d), "p4", "dependents", start_on_cycle=True),
    "shortest_path": lambda s, d: G.shortest_path(*_d(s, d), ROOT, "region:2"),
    "all_paths_from": _paths,
    "impact_affected": lambda s, d: G.impact(*_d(s, d), PART).select("package", "distance"),
    "impact_chains": lambda s, d: G.impact(*_d(s, d), PART),
    "impact_summary": lambda s, d: G.impact_summary(*_d(s, d), PART),
    "cross_kind_edges": lambda s, d: G.cross_ecosystem_edges(table(s, d, "edges"), table(s, d, "nodes")).groupBy("source_kind", "target_kind").agg(F.count("*").alias("edges")),
    "batch_queries": _batch,
    "khop_nodes": _khop,
    "khop_edges": _khop_edges,
    "graph_union": lambda s, d: _union(s, d),
    "chain_edges": lambda s, d: _chain(s, d)[1],
    "deep_reach": lambda s, d: G.deep_reachable(*_chain(s, d), "s0", "dependencies", part_bits=6),
    "deep_path": lambda s, d: _deep_path(s, d),
    "many_reach_counts": _many,
}


def _deep_path(spark, sf):
    nodes, edges = _chain(spark, sf)
    return G.deep_path(nodes, edges, "s1", nodes.orderBy(F.desc("vid")).first().id, part_bits=6)


def _merged(spark, sf):
    """The edges, merged once: each line is two of them, which are not made distinct before."""
    rows = sum(n * table(spark, sf, t).count() for t, n in (("lineitem", 2), ("orders", 1), ("customer", 1), ("supplier", 1)))
    return G.merged_edges(table(spark, sf, "edges", distinct=False).withColumn("seq", F.col("rel")), rows)


def _union(spark, sf):
    """Two graphs in one: ids kept, edges merged, the later graph's relationship over the earlier one's."""
    first = table(spark, sf, "pedges").withColumn("seq", F.lit(1))
    second = first.where("src % 3 = 0").withColumn("rel", F.lit(2)).withColumn("seq", F.lit(2))
    return G.merged_edges(first.unionByName(second)).groupBy("rel").agg(F.count("*").alias("edges"))


D, P = with_("nodes", "edges"), with_("pnodes", "pedges")
CHAIN = "SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1 AS rel FROM supplier a JOIN supplier b ON b.s_suppkey - a.s_suppkey BETWEEN 1 AND 3"

SQL = {
    "graph_nodes": D + "SELECT kind, count(*) AS n, min(vid) AS first_vid, max(vid) AS last_vid FROM nodes GROUP BY kind",
    "graph_edges": D + "SELECT rel, count(*) AS n, sum(dst)::BIGINT AS dst_sum FROM (SELECT src, dst, max(rel) AS rel FROM edges GROUP BY src, dst) GROUP BY rel",
    "dependencies": D + f"SELECT DISTINCT t.vid, t.id AS package FROM edges e JOIN nodes s ON e.src = s.vid JOIN nodes t ON e.dst = t.vid WHERE s.id = '{ROOT}'",
    "dependents": D + f"SELECT DISTINCT s.vid, s.id AS package FROM edges e JOIN nodes s ON e.src = s.vid JOIN nodes t ON e.dst = t.vid WHERE t.id = '{PART}'",
    "most_depended_upon": D + "SELECT id AS package, count(*) AS dependents FROM edges JOIN nodes ON dst = vid GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10",
    "adjacency": P + "SELECT n.id AS package, coalesce(string_agg(t.id, ',' ORDER BY t.vid), '') AS targets FROM pnodes n LEFT JOIN pedges e ON e.src = n.vid LEFT JOIN pnodes t ON t.vid = e.dst GROUP BY n.id",
    "edge_types": D + "SELECT rel, count(*) AS edges FROM edges GROUP BY rel",
    "reachable_fwd": D + "," + _bfs("edges", "nodes", ROOT) + " SELECT id AS package, d AS distance FROM r JOIN nodes ON n = vid WHERE d > 0",
    "reachable_rev": D + "," + _bfs("edges", "nodes", HUB, False) + " SELECT id AS package, d AS distance FROM r JOIN nodes ON n = vid WHERE d > 0",
    "reachable_cyclic": P + "," + _bfs("pedges", "pnodes", "p0") + " SELECT id AS package, d AS distance FROM r JOIN pnodes ON n = vid WHERE d > 0",
    "rev_reach_incl_start": P + "," + _bfs("pedges", "pnodes", "p4", False) + """ SELECT id AS package, d AS distance FROM r JOIN pnodes ON n = vid WHERE d > 0
      UNION ALL SELECT 'p4', min(d) + 1 FROM r JOIN pedges e ON e.dst = r.n WHERE e.src = 4 HAVING count(*) > 0""",
    "shortest_path": D + "," + _bfs("edges", "nodes", ROOT) + """ SELECT (SELECT string_agg(id, '>' ORDER BY k) FROM (SELECT unnest(p) AS v, generate_subscripts(p, 1) AS k) JOIN nodes ON vid = v) AS path, d AS distance
      FROM r JOIN nodes t ON t.vid = r.n WHERE t.id = 'region:2'""",
    "all_paths_from": P + "," + _bfs("pedges", "pnodes", "p0") + " SELECT id AS package, d AS distance, array_to_string(list_transform(p, lambda x: 'p' || x), '>') AS path FROM r JOIN pnodes ON n = vid",
    "impact_affected": D + "," + _bfs("edges", "nodes", PART, False) + " SELECT id AS package, d AS distance FROM r JOIN nodes ON n = vid WHERE d > 0",
    "impact_chains": D + "," + _bfs("edges", "nodes", PART, False) + """ , s AS (SELECT n, d, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM r WHERE d > 0)
      SELECT max(t.id) AS package, max(d) AS distance, string_agg(m.id, '>' ORDER BY k DESC) AS chain FROM s JOIN nodes m ON m.vid = s.v JOIN nodes t ON t.vid = s.n GROUP BY s.n""",
    "impact_summary": D + "," + _bfs("edges", "nodes", PART, False) + f""" SELECT count(*) AS affected, coalesce(max(d), 0) AS max_distance, least(count(*), 20) AS rendered, greatest(count(*) - 20, 0) AS truncated,
      (SELECT count(DISTINCT dst) FROM edges JOIN nodes ON src = vid WHERE id = '{PART}') AS direct_dependencies,
      (SELECT count(DISTINCT src) FROM edges JOIN nodes ON dst = vid WHERE id = '{PART}') AS direct_dependents FROM r WHERE d > 0""",
    "cross_kind_edges": D + "SELECT a.kind AS source_kind, b.kind AS target_kind, count(*) AS edges FROM edges JOIN nodes a ON src = a.vid JOIN nodes b ON dst = b.vid WHERE a.kind <> b.kind GROUP BY 1, 2",
    "batch_queries": P + "," + ", ".join(
        _bfs("pedges", "pnodes", s, f).replace("r(n", f"{x}(n").replace("FROM r ", f"FROM {x} AS r ").replace("recurring.r", f"recurring.{x}")
        for x, s, f in (("a", "p0", True), ("b", "p5", False), ("c", "p9", False))
    ) + """ SELECT 1::BIGINT AS qid, count(*) AS result_count FROM a WHERE d > 0 UNION ALL SELECT 2, count(*) FROM b WHERE d > 0
      UNION ALL SELECT 3, coalesce(max(d) + 1, 0) FROM a WHERE n = 17 UNION ALL SELECT 4, coalesce(max(d) + 1, 0) FROM c WHERE n = 3 UNION ALL SELECT 5, 0""",
    "khop_nodes": D + "," + _bfs("edges", "nodes", PART, False) + " SELECT id AS package, d AS distance FROM r JOIN nodes ON n = vid WHERE d BETWEEN 1 AND 2",
    "khop_edges": D + "," + _bfs("edges", "nodes", ROOT) + " SELECT DISTINCT src, dst FROM edges JOIN r ON n = src WHERE d < 2",
    "graph_union": P + "SELECT CASE WHEN src % 3 = 0 THEN 2 ELSE 1 END AS rel, count(*) AS edges FROM pedges GROUP BY 1",
    "chain_edges": CHAIN,
    "deep_reach": f"WITH RECURSIVE e AS ({CHAIN}), nodes AS (SELECT s_suppkey AS vid, concat('s', s_suppkey) AS id FROM supplier)," + _bfs("e", "nodes", "s0") + " SELECT id AS package, d AS distance FROM r JOIN nodes ON n = vid WHERE d > 0",
    "deep_path": f"WITH RECURSIVE e AS ({CHAIN}), nodes AS (SELECT s_suppkey AS vid, concat('s', s_suppkey) AS id FROM supplier)," + _bfs("e", "nodes", "s1")
    + " SELECT array_to_string(list_transform(p, lambda x: 's' || x), '>') AS path, d AS distance FROM r WHERE n = (SELECT max(vid) FROM nodes)",
    "many_reach_counts": D + """, w(a, n) USING KEY (a, n) AS (SELECT vid, vid FROM nodes WHERE kind IN ('customer', 'part') UNION SELECT w.a, e.dst FROM w JOIN edges e ON e.src = w.n WHERE NOT EXISTS (SELECT 1 FROM recurring.w x WHERE x.a = w.a AND x.n = e.dst)),
      r AS (SELECT a, count(*) - 1 AS reached FROM w GROUP BY a), o AS (SELECT src, count(*) AS direct FROM edges GROUP BY src), b AS (SELECT DISTINCT a FROM w JOIN edges ON src = n AND dst = a)
      SELECT id AS package, coalesce(direct, 0) AS direct, reached, CASE WHEN b.a IS NULL THEN 0 ELSE 1 END::BIGINT AS back FROM r JOIN nodes ON vid = r.a LEFT JOIN o ON o.src = r.a LEFT JOIN b ON b.a = r.a""",
}
