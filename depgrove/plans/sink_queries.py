"""Registered queries for what graphs are written as, and for the resolver."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts, resolver
from ..operators.tables import shared_folder
from ..sources import sinks
from .derive import table, with_

C = F.col


def _registry(spark, sf):
    """Each package of a name needs the next name with the same first word, by ranges that newer versions narrow."""
    from pyspark.sql import Window

    p = table(spark, sf, "packages").select("name", "version", "size")
    following = p.select("name").distinct().select("name", F.lead("name").over(Window.partitionBy(F.substring_index("name", "-", 1)).orderBy("name")).alias("next"))
    rule = F.when(C("size") % 3 == 0, "<3.0.0").when(C("size") % 3 == 1, "^1.0.0 || ^2.0.0").otherwise("*")
    return p.join(following, "name").select("name", "version", F.map_filter(F.create_map(F.coalesce("next", F.lit("")), rule), lambda k, v: k != "").alias("dependencies"))


def _roots(spark, sf):
    return table(spark, sf, "packages").select(C("name").alias("root")).distinct()


def _sbom(spark, sf):
    p = table(spark, sf, "packages")
    meta = F.create_map(F.lit("license"), F.nullif("license", F.lit("")), F.lit("ecosystem"), "ecosystem", F.lit("resolved"), F.when(C("vid") % 2 == 0, F.concat(F.lit("https://h/"), "vid")), F.lit("component_type"), F.when(C("vid") % 3 == 0, "file"), F.lit("brand"), "brand")
    return sinks.sbom_components(p.select("id", F.map_filter(meta, lambda k, v: v.isNotNull()).alias("meta")))


def _snapshot(spark, sf):
    meta = F.map_filter(F.create_map(F.lit("purl"), F.when(C("vid") % 4 == 0, F.concat(F.lit("pkg:x/"), "id")), F.lit("license"), F.when(C("vid") % 8 == 0, "MIT")), lambda k, v: v.isNotNull())
    return table(spark, sf, "pnodes").withColumn("meta", meta), table(spark, sf, "pedges")


def _batch_faults(spark, sf):
    """A folder with a file for each brand of parts, and a manifest that lacks some, names others that are not there, and has old digests."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", C("p_brand").alias("brand"), F.concat_ws(",", "p_partkey", "p_name").alias("value"))
    path = f"{shared_folder(spark)}/files-batch-{uuid.uuid4().hex}"
    p.repartition("brand").sortWithinPartitions("brand", "p_partkey").select("brand", "value").write.partitionBy("brand").text(path)
    found = sinks.digests(spark, path).where("NOT contains(file, '_SUCCESS') AND NOT endswith(file, '.crc')")
    n = F.regexp_extract(F.regexp_replace("file", "%23", "#"), r"brand=Brand#(\d+)/", 1).cast("int")
    known = found.withColumn("n", n).where("n % 7 <> 1").select(F.when(C("n") % 7 == 2, F.concat("file", F.lit(".old"))).otherwise(C("file")).alias("file"), F.when(C("n") % 7 == 3, C("bytes") + 1).otherwise(C("bytes")).alias("bytes"), F.when(C("n") % 7 == 4, F.sha2("sha256", 256)).otherwise(C("sha256")).alias("sha256"))
    faults = sinks.verified(known, found)
    return faults.select(F.regexp_extract(F.regexp_replace("file", "%23", "#"), r"brand=(Brand#\d+)/", 1).alias("brand"), "fault")


def _digested(spark, sf):
    """Files of one part's text each, with their digests."""
    p = table(spark, sf, "nation").select("n_nationkey", "n_name")
    path = f"{shared_folder(spark)}/files-digests-{uuid.uuid4().hex}"
    p.repartition("n_nationkey").select("n_nationkey", C("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    found = sinks.digests(spark, path).where("contains(file, 'n_nationkey=') AND NOT endswith(file, '.crc')")
    return found.select(F.regexp_extract("file", r"n_nationkey=(\d+)/", 1).cast("long").alias("key"), "bytes", "sha256")


def _document(rows, *order):
    """The document's lines as they are written, with their places: read from the part files in order of their names."""
    path = f"{shared_folder(rows.sparkSession)}/document-{uuid.uuid4().hex}"
    sinks.write_document(rows, path, *order)
    lines = rows.sparkSession.read.text(path).select(C("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    # lines before a file: a row for each file
    before = lines.groupBy("file").agg(F.count("*").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - C("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("start", "i"))
    return lines.withColumn("at", place).join(before, "file").select("line", (C("before") + C("at")).cast("long").alias("place"))


#: What a report of `_reports` must look like.
CONTRACT = {
    "type": "object", "required": ["schema", "summary", "items"], "additionalProperties": False,
    "properties": {"schema": {"const": "report.v1"}, "summary": {"$ref": "#/$defs/summary"}, "items": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/item"}}},
    "$defs": {
        "summary": {"type": "object", "required": ["findings"], "properties": {"findings": {"type": "integer", "minimum": 0}, "failed": {"type": ["boolean", "null"]}}},
        "item": {"type": "object", "properties": {"id": {"type": "string", "pattern": "^p[0-9]+$"}, "score": {"anyOf": [{"type": "number", "maximum": 20}, {"type": "null"}]}}},
    },
}


def _reports(spark, sf):
    """A report for each part, some of which break the contract in one way or another."""
    k = C("p_partkey")
    summary = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('"summary": {"findings": '), F.when(k % 7 == 1, '"3"').when(k % 7 == 2, "-1").otherwise("2"), F.lit(', "failed": null}, ')))
    item = F.concat(F.lit('{"id": "'), F.when(k % 7 == 3, "q").otherwise("p"), k.cast("string"), F.lit('", "score": '), C("p_size").cast("string"), F.lit("}"))
    more = F.when(k % 7 == 4, ', "more": 1').otherwise("")
    text = F.concat(F.lit('{"schema": "report.v1", '), summary, F.lit('"items": [{"id": "p0", "score": null}, '), item, F.lit("]"), more, F.when(k % 11 == 0, "").otherwise("}"))
    return contracts.checked(table(spark, sf, "part").select("p_partkey", text.alias("json")), CONTRACT)


QUERIES = {
    "report_contract_faults": _reports,
    "batch_faults": _batch_faults,
    "file_digests": _digested,
    "cypher_document": lambda s, d: _document(sinks.cypher_document(table(s, d, "pnodes"), table(s, d, "pedges")), "part", "a", "b"),
    "snapshot_document": lambda s, d: _document(sinks.snapshot_document(*_snapshot(s, d), "p0", "generic", "graph.snapshot"), "part", "i", "j", "id"),
    "snapshot_rows": lambda s, d: sinks.snapshot_rows(table(s, d, "pnodes"), table(s, d, "pedges")),
    "cypher_statements": lambda s, d: sinks.cypher(table(s, d, "pnodes"), table(s, d, "pedges")).select("statement"),
    "sbom_components": _sbom,
    "sbom_dependencies": lambda s, d: sinks.sbom_dependencies(table(s, d, "pnodes"), table(s, d, "pedges")),
    "snapshot_nodes": lambda s, d: sinks.snapshot_nodes(*_snapshot(s, d)),
    "snapshot_edges": lambda s, d: sinks.snapshot_edges(*_snapshot(s, d)).select("edge"),
    "graph_summary_line": lambda s, d: sinks.summary_line(table(s, d, "nodes"), table(s, d, "edges"), "customer:0"),
    "resolver_clauses": lambda s, d: resolver.clause_counts(_registry(s, d)),
    "resolve_batch": lambda s, d: resolver.resolve(_registry(s, d), _roots(s, d)),
}

P = with_("pnodes", "pedges").rstrip() + "\n"

#: The registry of `_registry`, where a package needs one other at most.
REGISTRY = with_("packages").rstrip() + """, v AS (SELECT name, version, size FROM packages), names AS (SELECT name, lead(name) OVER (PARTITION BY split_part(name, '-', 1) ORDER BY name) AS next FROM (SELECT DISTINCT name FROM v))"""
HOLDS = "CASE a.size % 3 WHEN 0 THEN split_part(c, '.', 1)::INT < 3 WHEN 1 THEN split_part(c, '.', 1)::INT IN (1, 2) ELSE true END"

SQL = {
    "report_contract_faults": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_size FROM part WHERE p_partkey % 11 <> 0) SELECT p_partkey, '$' AS path, 'no JSON' AS reason FROM part WHERE p_partkey % 11 = 0
      UNION ALL SELECT p_partkey, '$.summary', 'required' FROM p WHERE k = 0 UNION ALL SELECT p_partkey, '$.summary.findings', 'not of type integer' FROM p WHERE k = 1 UNION ALL SELECT p_partkey, '$.summary.findings', 'minimum' FROM p WHERE k = 2
      UNION ALL SELECT p_partkey, '$.items[1].id', 'pattern' FROM p WHERE k = 3 UNION ALL SELECT p_partkey, '$.more', 'not allowed' FROM p WHERE k = 4 UNION ALL SELECT p_partkey, '$.items[1].score', 'anyOf' FROM p WHERE p_size > 20""",
    "batch_faults": """WITH b AS (SELECT DISTINCT p_brand AS brand, replace(p_brand, 'Brand#', '')::INT AS n FROM part) SELECT brand, CASE n % 7 WHEN 1 THEN 'extra' WHEN 2 THEN 'extra' WHEN 3 THEN 'size' ELSE 'content' END AS fault FROM b WHERE n % 7 IN (1, 2, 3, 4)
      UNION ALL SELECT brand, 'missing' FROM b WHERE n % 7 = 2""",
    "file_digests": "SELECT n_nationkey::BIGINT AS key, length(n_name) + 1 AS bytes, sha256(concat(n_name, chr(10))) AS sha256 FROM nation",
    "cypher_document": P + """, s AS (SELECT 0 AS part, '' AS a, '' AS b, 'CREATE CONSTRAINT package_id_unique IF NOT EXISTS FOR (p:Package) REQUIRE p.id IS UNIQUE;' AS line UNION ALL SELECT 1, id, '', concat('MERGE (:Package {id: "', id, '"});') FROM pnodes
      UNION ALL SELECT 2, concat('p', src), concat('p', dst), concat('MATCH (s:Package {id: "p', src, '"}) MATCH (t:Package {id: "p', dst, '"}) MERGE (s)-[:DEPENDS_ON {type: ', rel, '}]->(t);') FROM pedges) SELECT line, row_number() OVER (ORDER BY part, a, b) AS place FROM s""",
    "snapshot_rows": P + """SELECT n.id, coalesce((SELECT to_json(list(t.id ORDER BY t.vid)) FROM pedges e JOIN pnodes t ON t.vid = e.dst WHERE e.src = n.vid)::VARCHAR, '[]') AS dependencies,
      coalesce((SELECT to_json(list(t.id ORDER BY t.vid)) FROM pedges e JOIN pnodes t ON t.vid = e.src WHERE e.dst = n.vid)::VARCHAR, '[]') AS dependents FROM pnodes n""",
    "cypher_statements": P + """SELECT 'CREATE CONSTRAINT package_id_unique IF NOT EXISTS FOR (p:Package) REQUIRE p.id IS UNIQUE;' AS statement UNION ALL SELECT concat('MERGE (:Package {id: "', id, '"});') FROM pnodes
      UNION ALL SELECT concat('MATCH (s:Package {id: "p', src, '"}) MATCH (t:Package {id: "p', dst, '"}) MERGE (s)-[:DEPENDS_ON {type: ', rel, '}]->(t);') FROM pedges""",
    "sbom_components": with_("packages") + """SELECT id AS ref, concat('{"type":"', CASE WHEN vid % 3 = 0 THEN 'file' ELSE 'library' END, '","bom-ref":"', id, '","name":"', name, '","version":"', version, '","purl":"pkg:', ecosystem, '/', name, '@', version, '"',
      CASE WHEN coalesce(license, '') = '' THEN '' ELSE concat(',"licenses":[{"license":{"name":"', license, '"}}]') END, CASE WHEN vid % 2 = 0 THEN concat(',"externalReferences":[{"type":"distribution","url":"https://h/', vid, '"}]') ELSE '' END,
      ',"properties":[{"name":"depgrove:brand","value":"', brand, '"},{"name":"depgrove:ecosystem","value":"', ecosystem, '"}]}') AS component FROM packages""",
    "sbom_dependencies": P + """SELECT n.id AS ref, concat('{"ref":"', n.id, '","dependsOn":', coalesce((SELECT to_json(list(t.id ORDER BY t.vid)) FROM pedges e JOIN pnodes t ON t.vid = e.dst WHERE e.src = n.vid)::VARCHAR, '[]'), '}') AS dependency FROM pnodes n""",
    "snapshot_nodes": P.rstrip() + """, x AS (SELECT n.id, n.vid, coalesce((SELECT to_json(list(t.id ORDER BY t.vid)) FROM pedges e JOIN pnodes t ON t.vid = e.dst WHERE e.src = n.vid)::VARCHAR, '[]') AS a, coalesce((SELECT to_json(list(t.id ORDER BY t.vid)) FROM pedges e JOIN pnodes t ON t.vid = e.src WHERE e.dst = n.vid)::VARCHAR, '[]') AS b FROM pnodes n)
      SELECT id, concat('{"id":"', id, '","name":"', id, '"', CASE WHEN vid % 4 = 0 THEN concat(',"purl":"pkg:x/', id, '","package":{"ecosystem":"generic","name":"', id, '","version":"","purl":"pkg:x/', id, '"', CASE WHEN vid % 8 = 0 THEN ',"license":"MIT"' ELSE '' END, '}') ELSE '' END,
        ',"dependencies":', a, ',"dependents":', b, ',"metadata":{', CASE WHEN vid % 4 = 0 THEN concat('"purl":"pkg:x/', id, '"') ELSE '' END, CASE WHEN vid % 8 = 0 THEN ',"license":"MIT"' ELSE '' END, '}}') AS node FROM x""",
    "snapshot_edges": P + """SELECT concat('{"source":"p', src, '","target":"p', dst, '","relationshipType":', rel, '}') AS edge FROM pedges""",
    "resolve_batch": REGISTRY + """, solid(name, versions) AS (
        SELECT name, list(version) FROM names JOIN v USING (name) WHERE next IS NULL GROUP BY name
        UNION ALL SELECT n.name, (SELECT list(a.version) FROM v a WHERE a.name = n.name AND list_bool_or([""" + HOLDS + """ FOR c IN s.versions])) FROM solid s JOIN names n ON n.next = s.name),
      walk(root, name, version) AS (
        SELECT name, name, list_first(list_reverse_sort([[split_part(x, '.', 1)::INT, split_part(x, '.', 2)::INT, split_part(x, '.', 3)::INT] FOR x IN versions])) FROM solid
        UNION ALL SELECT w.root, s.name, list_first(list_reverse_sort([[split_part(c, '.', 1)::INT, split_part(c, '.', 2)::INT, split_part(c, '.', 3)::INT] FOR c IN s.versions IF """ + HOLDS + """]))
        FROM walk w JOIN names n ON n.name = w.name JOIN solid s ON s.name = n.next JOIN v a ON a.name = w.name AND a.version = array_to_string(w.version, '.') WHERE w.version IS NOT NULL)
      SELECT root, CASE WHEN version IS NOT NULL THEN name END AS name, array_to_string(version, '.') AS version FROM walk WHERE version IS NOT NULL OR root = name""",
    "graph_summary_line": with_("nodes", "edges") + "SELECT concat('root=customer:0 nodes=', (SELECT count(*) FROM nodes), ' edges=', (SELECT count(*) FROM edges)) AS line",
    "resolver_clauses": with_("packages") + "SELECT (SELECT sum(n * (n - 1) / 2)::BIGINT FROM (SELECT count(*) AS n FROM packages GROUP BY name)) AS at_most_one, (SELECT count(*) FROM packages p WHERE name <> (SELECT max(name) FROM packages q WHERE split_part(q.name, '-', 1) = split_part(p.name, '-', 1))) AS requirements",
}

SQL["snapshot_document"] = f"""SELECT line, row_number() OVER (ORDER BY part, i, j, id) AS place FROM (
  SELECT 0 AS part, 0 AS i, 0 AS j, '' AS id, '{{"ecosystem":"generic","edges":[' AS line UNION ALL SELECT 2, 0, 0, '', '],"nodes":['
  UNION ALL SELECT 1, src, dst, '', concat('{{"source":"p', src, '","target":"p', dst, '","relationshipType":', rel, '}}', CASE WHEN row_number() OVER (ORDER BY src DESC, dst DESC) = 1 THEN '' ELSE ',' END) FROM ({P} SELECT * FROM pedges)
  UNION ALL SELECT 3, 0, 0, id, concat(node, CASE WHEN row_number() OVER (ORDER BY id DESC) = 1 THEN '' ELSE ',' END) FROM ({SQL["snapshot_nodes"]})
  UNION ALL SELECT 4, 0, 0, '', concat('],"rankings":{{"mostDependedUpon":[', (SELECT string_agg(concat('{{"dependents":', n, ',"package":"', package, '"}}'), ',' ORDER BY n DESC, package) FROM ({P} SELECT concat('p', dst) AS package, count(*) AS n FROM pedges GROUP BY 1 ORDER BY n DESC, package LIMIT 10)),
    ']}},"root":"p0","schema":"graph.snapshot","stats":{{"edges":', (SELECT count(*) FROM ({P} SELECT * FROM pedges)), ',"nodes":', (SELECT count(*) FROM part), '}}}}'))"""
