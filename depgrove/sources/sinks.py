"""What graphs are written as: snapshot rows, Cypher statements, an SBOM's components, Parquet copies with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import purl, split_id
from ..operators.searches import Edges
from ..operators.tables import bucketed, placed_buckets

C = F.col


def snapshot_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dependencies, dependents: a row per node, its neighbours in vid order as JSON."""
    def side(a: str, b: str, name: str) -> DataFrame:
        named = edges.join(nodes.select(C("vid").alias(b), C("id").alias("other")), b)
        lists = F.transform(F.array_sort(F.collect_list(F.struct(b, "other"))), lambda x: x["other"])
        return named.groupBy(C(a).alias("vid")).agg(F.to_json(lists).alias(name))

    rows = nodes.join(side("src", "dst", "dependencies"), "vid", "left").join(side("dst", "src", "dependents"), "vid", "left")
    return rows.select("id", F.coalesce("dependencies", F.lit("[]")).alias("dependencies"), F.coalesce("dependents", F.lit("[]")).alias("dependents"))


def _quoted(c):
    return F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, statement: a constraint, a MERGE per node by id, a MERGE per edge by ends."""
    first = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("CREATE CONSTRAINT package_id_unique IF NOT EXISTS FOR (p:Package) REQUIRE p.id IS UNIQUE;").alias("statement"))
    merge = nodes.select(F.lit(1).alias("part"), C("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("MERGE (:Package {id: "), _quoted(C("id")), F.lit("});")).alias("statement"))
    ends = edges.join(nodes.select(C("vid").alias("src"), C("id").alias("s")), "src").join(nodes.select(C("vid").alias("dst"), C("id").alias("t")), "dst")
    text = F.concat(F.lit("MATCH (s:Package {id: "), _quoted(C("s")), F.lit("}) MATCH (t:Package {id: "), _quoted(C("t")), F.lit("}) MERGE (s)-[:DEPENDS_ON {type: "), C("rel").cast("string"), F.lit("}]->(t);"))
    return first.unionByName(merge).unionByName(ends.select(F.lit(2).alias("part"), C("s").alias("a"), C("t").alias("b"), text.alias("statement")))


def snapshot_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and node: a snapshot's entry of each node as JSON, with its neighbours and metadata; one with a purl also as a package.
    nodes: vid, id, meta."""
    of = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    name, version = split_id(C("id"))
    exact = F.when(F.contains("id", F.lit("==")), version)
    sides = snapshot_rows(nodes, edges)
    ids = lambda c: F.from_json(c, "array<string>")
    package = F.struct(
        F.coalesce(of("ecosystem"), F.lit("generic")).alias("ecosystem"), F.coalesce(of("name"), name).alias("name"), F.coalesce(of("version"), exact, F.lit("")).alias("version"), of("purl").alias("purl"),
        of("source_url").alias("sourceUrl"), of("license").alias("license"), of("checksum").alias("checksum"), of("signature").alias("signature"), of("provenance").alias("provenance"),
    )
    entry = F.struct("id", name.alias("name"), exact.alias("version"), of("purl").alias("purl"), F.when(of("purl").isNotNull(), package).alias("package"), ids("dependencies").alias("dependencies"), ids("dependents").alias("dependents"), C("meta").alias("metadata"))
    return nodes.join(sides, "id").select("id", F.to_json(entry).alias("node"))


def snapshot_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target and edge: a snapshot's entry of each edge as JSON. edges: src, dst, rel and, if there are, scope and constraint."""
    ends = edges.join(nodes.select(C("vid").alias("src"), C("id").alias("source")), "src").join(nodes.select(C("vid").alias("dst"), C("id").alias("target")), "dst")
    more = [C(c) for c in ("scope", "constraint") if c in edges.columns]
    return ends.select("src", "dst", "source", "target", F.to_json(F.struct("source", "target", C("rel").alias("relationshipType"), *more)).alias("edge"))


def sbom_components(packages: DataFrame) -> DataFrame:
    """ref and component: an SBOM's component as JSON: type, name, bom-ref, of an id with a version also that and the purl, licence and
    address; metadata that has no place of its own becomes properties. packages: id, meta."""
    of = lambda k: F.try_element_at("meta", F.lit(k))
    name, version = split_id(C("id"))
    exact = F.contains("id", F.lit("=="))
    url = F.when(exact, F.coalesce(F.nullif(of("purl"), F.lit("")), purl(F.coalesce(of("ecosystem"), F.lit("generic")), name, version, C("meta"))))
    own = F.map_filter("meta", lambda k, v: ~k.isin("component_type", "license", "purl", "resolved"))
    props = F.transform(F.array_sort(F.map_entries(own)), lambda e: F.struct(F.concat(F.lit("depgrove:"), e["key"]).alias("name"), e["value"].alias("value")))
    part = F.struct(
        F.coalesce(of("component_type"), F.lit("library")).alias("type"), C("id").alias("bom-ref"), name.alias("name"), F.when(exact, version).alias("version"), url.alias("purl"),
        F.when(of("license").isNotNull(), F.array(F.struct(F.struct(of("license").alias("name")).alias("license")))).alias("licenses"),
        F.when(of("resolved").isNotNull(), F.array(F.struct(F.lit("distribution").alias("type"), of("resolved").alias("url")))).alias("externalReferences"), F.when(F.size(own) > 0, props).alias("properties"),
    )
    return packages.select(C("id").alias("ref"), F.to_json(part).alias("component"))


def sbom_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ref and dependency: an SBOM's entry of what each node depends on, in vid order, as JSON."""
    return snapshot_rows(nodes, edges).select(C("id").alias("ref"), F.to_json(F.struct(C("id").alias("ref"), F.from_json("dependencies", "array<string>").alias("dependsOn"))).alias("dependency"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, n: int = 32) -> DataFrame:
    """Writes nodes by vid, edges by source and edges by target, each in n buckets sorted by that key, and gives the manifest: table, key,
    buckets, rows, digest. The digest is over the rows' hashes in any order, so that equal graphs have equal digests."""
    manifest = None
    for name, (rows, key) in {"nodes": (nodes, "vid"), "edges_by_source": (edges, "src"), "edges_by_target": (edges, "dst")}.items():
        found = bucketed(rows.repartition(n, key), key, name, n, path=f"{path}/{name}").plain
        row = _digest(found, name).select("table", F.lit(key).alias("key"), F.lit(n).alias("buckets"), "rows", "digest")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def _digest(rows: DataFrame, name: str) -> DataFrame:
    total = F.sum(F.xxhash64(*sorted(c for c, t in rows.dtypes if not t.startswith("map"))).cast("decimal(38,0)"))
    return rows.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.sha2(total.cast("string"), 256).alias("digest"))


def read_graph(spark, path: str) -> tuple[DataFrame, Edges]:
    """Nodes, and edges as searches want them: bucketed by either end, so that no search shuffles them; fails if a table does not have the
    manifest's rows and digest."""
    found = {}
    for want in spark.read.json(f"{path}/manifest").collect():  # three rows
        name = want["table"]
        plain = spark.read.parquet(f"{path}/{name}")
        have = _digest(plain, name).first()
        if (have["rows"], have["digest"]) != (want["rows"], want["digest"]):
            raise ValueError(f"{name} is not what the manifest says")
        found[name] = placed_buckets(spark, plain.schema, f"{path}/{name}", want["key"], want["buckets"])
        n = want["buckets"]
    return found["nodes"], Edges.written(found["edges_by_source"], found["edges_by_target"], n)


def summary_line(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("n"))
    return n.select(F.format_string(f"root={root} nodes=%d edges=%d", C("n"), e.scalar()).alias("line"))


def write_document(lines: DataFrame, path: str, *order: str) -> None:
    """Writes the column `text` of rows as lines in the order of the given columns: the part files, put together by name, are the document. Rows
    are sorted by ranges, so no task holds them all; equal rows keep no order of their own."""
    lines.orderBy(*order).select("text").write.mode("overwrite").text(path)


def cypher_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The statements as lines for write_document: the constraint, nodes by id, edges by their ends."""
    return cypher(nodes, edges).select("part", "a", "b", C("statement").alias("text"))


def snapshot_document(nodes: DataFrame, edges: DataFrame, root: str, ecosystem: str, schema: str) -> DataFrame:
    """A snapshot as lines for write_document, by part, i, j and id: one JSON object with its keys in order, an entry of its lists a line: edges in
    vid order, nodes by id, the ten packages that most others depend on. nodes: vid, id, meta. A list's last entry, which has no comma, is
    found by the largest place."""
    from ..operators.graph import most_depended_upon

    spark = nodes.sparkSession
    plain = lambda text: F.regexp_extract(F.to_json(F.array(F.lit(text))), r"(?s)^\[(.*)\]$", 1)
    row = lambda df, part, i, j, id_, text: df.select(F.lit(part).alias("part"), i.cast("long").alias("i"), j.cast("long").alias("j"), id_.alias("id"), text.alias("text"))
    fixed = lambda part, text: row(spark.range(1), part, F.lit(0), F.lit(0), F.lit(""), text)
    comma = lambda last: F.when(last, "").otherwise(",")
    n, e = snapshot_nodes(nodes, edges), snapshot_edges(nodes, edges)
    last_edge, last_node = edges.agg(F.max(F.struct("src", "dst"))).scalar(), nodes.agg(F.max("id")).scalar()
    top = most_depended_upon(nodes, edges, 10).agg(F.array_sort(F.collect_list(F.struct((-C("dependents")).alias("k"), "package", "dependents"))).alias("x"))
    ranking = top.select(F.to_json(F.transform("x", lambda r: F.struct(r["dependents"].alias("dependents"), r["package"].alias("package"))))).scalar()
    count = lambda df: df.agg(F.count("*").cast("string")).scalar()
    tail = F.concat(F.lit('],"rankings":{"mostDependedUpon":'), ranking, F.lit('},"root":'), plain(root), F.lit(',"schema":'), plain(schema), F.lit(',"stats":{"edges":'), count(edges), F.lit(',"nodes":'), count(nodes), F.lit("}}"))
    parts = [
        fixed(0, F.concat(F.lit('{"ecosystem":'), plain(ecosystem), F.lit(',"edges":['))),
        row(e, 1, C("src"), C("dst"), F.lit(""), F.concat("edge", comma(F.struct("src", "dst") == last_edge))),
        fixed(2, F.lit('],"nodes":[')),
        row(n, 3, F.lit(0), F.lit(0), C("id"), F.concat("node", comma(C("id") == last_node))),
        fixed(4, tail),
    ]
    return reduce(DataFrame.unionByName, parts)


def digests(spark, path: str) -> DataFrame:
    """file (below the folder), bytes and sha256 of each file of a folder and its folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z0-9]+:/*", "/")
    file = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), F.concat(F.lit("^"), F.lit("\\Q"), root, F.lit("\\E/")), "")
    return found.select(file.alias("file"), C("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """file and fault (missing, extra, size or content) of each file of a batch that is not as its manifest says. manifest, found: file, bytes,
    sha256."""
    m, f = manifest.alias("m"), found.alias("f")
    both = m.join(f, C("m.file") == C("f.file"), "full_outer")
    fault = F.when(C("f.file").isNull(), "missing").when(C("m.file").isNull(), "extra").when(C("m.bytes") != C("f.bytes"), "size").when(C("m.sha256") != C("f.sha256"), "content")
    return both.select(F.coalesce("m.file", "f.file").alias("file"), fault.alias("fault")).where("fault IS NOT NULL")
