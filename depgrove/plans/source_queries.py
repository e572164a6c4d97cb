"""Registered queries over files: the driver's tables written in the formats of the loaders, then loaded."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from ..operators import query as Q
from ..operators.tables import shared_folder
from ..sources import load, load_graph, load_rows
from .derive import table, with_
from .graph_queries import _bfs
from .join_queries import VKEY

C = F.col


def _put(rows, name: str) -> str:
    """Writes a column of text as files and gives their folder."""
    path = f"{shared_folder(rows.sparkSession)}/files-{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def _dashed(c: str = "p_name"):
    return F.replace(c, F.lit(" "), F.lit("_"))


def _requirements(spark, sf):
    p, key = table(spark, sf, "part"), C("p_partkey")
    name = F.concat(_dashed(), F.lit("."), key.cast("string"))
    line = F.when(key % 5 == 0, F.concat(name, F.lit("[x, y] ~= "), C("p_size").cast("string"), F.lit('; os == "a"'))).when(key % 5 == 1, F.concat(name, F.lit("=="), C("p_size").cast("string"), F.lit(" --hash=sha256:"), key.cast("string")))
    line = line.when(key % 5 == 2, F.concat(name, F.lit(" @ https://h/"), key.cast("string"), F.lit(".whl"))).when(key % 5 == 3, F.concat(F.lit("# "), name)).otherwise(F.concat(name, F.lit(" >1,<"), C("p_size").cast("string")))
    nodes, edges = load(spark, "requirements", _put(p.select(line.alias("value")), "requirements"))
    wanted = nodes.where(F.coalesce(F.try_element_at("meta", F.lit("node_type")), F.lit("")) != "root")
    return wanted.join(edges.select("graph", C("dst").alias("id")), ["graph", "id"]).select("id", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("constraint", "url", "marker", "hash", "extras")])


REQUIREMENTS = """WITH p AS (SELECT p_partkey AS k, p_size AS s, concat(replace(replace(lower(p_name), ' ', '-'), '_', '-'), '-', p_partkey) AS name FROM part WHERE p_partkey % 5 <> 3)
 SELECT concat(name, '==', CASE k % 5 WHEN 0 THEN concat('~= ', s) WHEN 1 THEN s::VARCHAR WHEN 2 THEN concat('https://h/', k, '.whl') ELSE concat('>1,<', s) END) AS id, CASE k % 5 WHEN 0 THEN concat('~= ', s) WHEN 1 THEN concat('==', s) WHEN 2 THEN '' ELSE concat('>1,<', s) END AS "constraint",
   CASE WHEN k % 5 = 2 THEN concat('https://h/', k, '.whl') END AS url, CASE WHEN k % 5 = 0 THEN 'os == "a"' END AS marker, CASE WHEN k % 5 = 1 THEN concat('sha256:', k) END AS hash, CASE WHEN k % 5 = 0 THEN 'x, y' ELSE '' END AS extras FROM p"""


def _transactions(spark, sf):
    p, key = table(spark, sf, "part"), C("p_partkey")
    package = lambda v: F.concat(_dashed(), F.lit("-2:"), v.cast("string"), F.lit("-"), key.cast("string"), F.lit(".noarch"))
    line = F.when(key % 4 == 0, F.concat(F.lit("Install: "), package(C("p_size")), F.lit(".rpm"))).when(key % 4 == 1, F.concat(F.lit("upgrade "), package(C("p_size")), F.lit(" -> "), package(C("p_size") + 1))).when(key % 4 == 2, F.concat(F.lit("# install "), package(C("p_size")))).otherwise(F.concat(F.lit("note "), package(C("p_size"))))
    rows = load_rows(spark, "transaction", _put(p.select(line.alias("value")), "transaction"))
    return rows.select("action", C("package.node").alias("package"), C("old.node").alias("old"), C("new.node").alias("new"))


TRANSACTIONS = """WITH p AS (SELECT p_partkey AS k, p_size AS s, replace(p_name, ' ', '_') AS name FROM part) SELECT CASE k % 4 WHEN 0 THEN 'install' ELSE 'upgrade' END AS action, CASE WHEN k % 4 = 0 THEN concat(name, '==', s, '-', k, '.noarch') END AS package,
  CASE WHEN k % 4 = 1 THEN concat(name, '==', s, '-', k, '.noarch') END AS old, CASE WHEN k % 4 = 1 THEN concat(name, '==', s + 1, '-', k, '.noarch') END AS new FROM p WHERE k % 4 < 2"""


def _installed(spark, sf):
    p, key = table(spark, sf, "part"), C("p_partkey")
    fields = [F.concat(F.lit("n"), key.cast("string")), F.when(key % 3 == 0, "(none)").otherwise("1"), F.concat(C("p_size").cast("string"), F.lit("-1")), F.lit("x86_64"), C("p_brand"), F.lit("MIT"), F.lit("s.src.rpm"), F.lit("7")]
    line = F.when(key % 7 == 0, F.concat_ws("\t", fields[0], fields[2], fields[3])).otherwise(F.concat_ws("\t", *fields))
    rows = load_rows(spark, "installed-rpms", _put(p.select(line.alias("value")), "installed"))
    return rows.select("id", "name", "epoch", "arch", "vendor", "license")


INSTALLED = """SELECT concat('n', p_partkey, '==', p_size, '-1') AS id, concat('n', p_partkey) AS name, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 3 > 0 THEN '1' END AS epoch, 'x86_64' AS arch, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS vendor,
  CASE WHEN p_partkey % 7 > 0 THEN 'MIT' END AS license FROM part"""


def _dot(spark, sf):
    """The graph of parts over many files, as one: nodes with vids and edges between them."""
    line = F.concat(F.lit('"p'), C("src").cast("string"), F.lit('" -> "p'), C("dst").cast("string"), F.lit('"'))
    files = _put(table(spark, sf, "pedges").repartition(8, "src").select(line.alias("value")), "dot")
    return G.canonical(*[df.withColumn("graph", F.lit("parts")) for df in load(spark, "dot", files)])


def _dot_reachable(spark, sf):
    found = Q.run(*_dot(spark, sf), "reachable", "p0")
    return found.select(F.split_part("package", F.lit("=="), F.lit(1)).alias("package"), "distance")


def _feed(spark, sf):
    """The advisories as public feeds, a file each, matched with the packages."""
    a = table(spark, sf, "advisories")
    event = lambda k: F.struct(F.when(F.lit(k == "introduced"), C("introduced")).alias("introduced"), F.when(F.lit(k == "fixed"), C("fixed")).alias("fixed"))
    package = F.struct(F.lit("NPM").alias("ecosystem"), C("package").alias("name"))
    record = F.to_json(F.struct(C("advisory").alias("id"), F.struct(C("severity").alias("severity")).alias("database_specific"), F.array(F.struct(package.alias("package"), F.array(F.struct(F.array(event("introduced"), event("fixed")).alias("events"))).alias("ranges"))).alias("affected")))
    docs = a.select("advisory", F.concat(F.lit('{"vulns": ['), record, F.lit("]}")).alias("value"))
    path = f"{shared_folder(spark)}/files-feed-{uuid.uuid4().hex}"
    docs.repartition("advisory").write.partitionBy("advisory").text(path)
    feed = load_rows(spark, "osv-feed", path, ecosystem="npm")
    packages = J.advisory_packages(table(spark, sf, "packages").select("id", "ecosystem", F.create_map().cast("map<string,string>").alias("meta")))
    hits = J.advisory_matches(feed, packages)
    return hits.join(feed.select("advisory", C("id").alias("record")), "advisory").select("record", "id", "severity")


def _maven(spark, sf):
    """The lines of all orders as trees, the orders of each 512 keys in a tree and 16 trees, as those of a build of several modules, in a file."""
    depth = F.least(C("l_partkey") % 3, C("l_linenumber") - 1).cast("int")
    mark = F.when(depth == 0, "").otherwise(F.concat(F.repeat(F.lit("|  "), depth - 1), F.lit("+- ")))
    line = F.concat(F.lit("[INFO] "), mark, F.lit("g:o"), C("l_orderkey").cast("string"), F.lit("l"), C("l_linenumber").cast("string"), F.lit(":jar:"), C("l_partkey").cast("string"), F.lit(":compile"), F.when(C("l_partkey") % 5 == 0, " (optional)").otherwise(""))
    tree = F.shiftright(C("l_orderkey").cast("long"), 9)
    rows = table(spark, sf, "lineitem").select(F.shiftright(tree, 4).alias("folder"), "l_orderkey", "l_linenumber", "l_partkey").repartition("folder")
    rows = rows.groupBy("folder", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    before = F.lag(tree).over(Window.partitionBy("folder").orderBy("l_orderkey", "l_linenumber"))
    head = F.when(before == tree, "").otherwise(F.concat(F.lit("[INFO] --- maven-dependency-plugin:3.6.0:tree (default-cli) @ t"), tree.cast("string"), F.lit(" ---\n")))
    path = f"{shared_folder(spark)}/files-maven-{uuid.uuid4().hex}"
    rows.select("folder", F.concat(head, line).alias("value")).write.partitionBy("folder").text(path)
    return load(spark, "maven-tree", path)[1].select("src", "dst", "rel")


MAVEN = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), d AS (SELECT *, least(p % 3, n - 1) AS depth, concat('g:o', o, 'l', n, '==', p) AS id FROM l),
 w AS (SELECT *, last_value(CASE WHEN depth = 0 THEN id END IGNORE NULLS) OVER f AS top, last_value(CASE WHEN depth = 1 THEN id END IGNORE NULLS) OVER f AS middle FROM d WINDOW f AS (PARTITION BY o // 512 ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT CASE depth WHEN 1 THEN top ELSE middle END AS src, id AS dst, CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END AS rel FROM w WHERE depth > 0 AND CASE depth WHEN 1 THEN top ELSE middle END IS NOT NULL"""


def _graph(spark, sf):
    """The parts as a graph with metadata: every third part has a purl, every fifth another name."""
    nodes = table(spark, sf, "pnodes")
    meta = F.create_map(F.lit("purl"), F.when(C("vid") % 3 == 0, F.concat(F.lit("pkg:x/"), "id")), F.lit("name"), F.when(C("vid") % 5 == 0, F.concat(F.lit("other-"), "id")))
    return nodes.withColumn("ecosystem", F.when(C("vid") % 2 == 0, "npm").otherwise("rpm")).withColumn("meta", F.map_filter(meta, lambda k, v: v.isNotNull())), table(spark, sf, "pedges")


def _operations(spark, sf):
    nodes, edges = _graph(spark, sf)
    asked = (("dependencies", "pkg:x/p3", None), ("dependents", "p7", None), ("reachable", "p1", None), ("path", "p0", "pkg:x/p18"), ("most-depended-upon", None, None))
    out = None
    for operation, node, target in asked:
        row = Q.report(Q.run(nodes, edges, operation, node, target), operation).select(F.lit(operation).alias("operation"), "result_count", "result_kind", "path_found")
        out = row if out is None else out.unionByName(row)
    return out


def _selectors(spark, sf):
    """All names, ids, purls that versions share, and names that are none, as selectors of each kind."""
    p = table(spark, sf, "packages")
    purl = F.when(C("vid") % 3 == 0, F.concat(F.lit("pkg:x/"), "name"))
    nodes = p.select("id", "name", F.map_filter(F.create_map(F.lit("purl"), purl, F.lit("name"), F.when(C("vid") % 5 == 0, F.concat(F.lit("other-"), "id"))), lambda k, v: v.isNotNull()).alias("meta"))
    texts = F.explode(F.array(C("name"), C("id"), F.concat(F.lit("pkg:x/"), "name"), F.concat(F.lit("other-"), "id"), F.concat(F.lit("none-"), "name"))).alias("selector")
    asked = p.select(texts).distinct().select(F.explode(F.array(*map(F.lit, ("query", "report", "diff")))).alias("kind"), "selector")
    return J.resolved(nodes, asked).select("kind", "selector", "node", "status", "matches", F.array_join("candidates", ",").alias("candidates"))


SELECTORS = with_("packages").rstrip() + """, n AS (SELECT id, name, CASE WHEN vid % 3 = 0 THEN concat('pkg:x/', name) END AS purl, CASE WHEN vid % 5 = 0 THEN concat('other-', id) END AS other FROM packages),
 t AS (SELECT DISTINCT unnest([name, id, concat('pkg:x/', name), concat('other-', id), concat('none-', name)]) AS selector FROM packages), k AS (SELECT kind, selector FROM t, (VALUES ('query'), ('report'), ('diff')) v(kind)),
 h AS (SELECT kind, selector, list(DISTINCT id) FILTER (p = 0) AS a, list(DISTINCT id) FILTER (p = 1) AS b, list(DISTINCT id) FILTER (p = 2) AS c FROM k LEFT JOIN (
   SELECT id, id AS key, 0 AS p, '' AS tag FROM n UNION ALL SELECT id, purl, 1, 'no diff' FROM n UNION ALL SELECT id, name, 2, '' FROM n UNION ALL SELECT id, other, 2, 'report' FROM n) m ON m.key = selector AND (tag = '' OR (tag = 'no diff' AND kind <> 'diff') OR tag = kind) GROUP BY 1, 2),
 u AS (SELECT *, CASE WHEN a IS NOT NULL THEN a WHEN len(b) = 1 THEN b WHEN len(b) > 1 AND kind = 'report' AND len(c) = 1 THEN c WHEN b IS NOT NULL THEN b ELSE c END AS ids FROM h)
 SELECT kind, selector, CASE WHEN len(ids) = 1 THEN ids[1] WHEN ids IS NULL AND kind <> 'diff' THEN selector END AS node, CASE WHEN ids IS NULL THEN CASE WHEN kind = 'diff' THEN 'unknown' ELSE 'text' END WHEN len(ids) = 1 THEN 'found' ELSE 'ambiguous' END AS status,
   coalesce(len(ids), 0) AS matches, coalesce(array_to_string(list_sort(ids)[1:CASE WHEN kind = 'diff' THEN 5 ELSE 20 END], ','), '') AS candidates FROM u"""


def _lock_files(spark, sf, form: str) -> str:
    """The parts as lock files of one form, in eight files: each part needs the one after it in its file."""
    key, after = C("p_partkey"), C("p_partkey") + 8
    p = table(spark, sf, "part")
    rows = p.join(p.select((key - 8).alias("p_partkey"), C("p_size").alias("next_size")), "p_partkey", "left")
    name, version = F.concat(F.lit("P_"), key.cast("string")), F.concat("p_size", F.lit(".0"))
    need = lambda text: F.when(C("next_size").isNotNull(), text).otherwise("")
    wanted, other = F.concat("next_size", F.lit(".0")), F.concat(F.lit("p-"), after.cast("string"))
    head = {"pnpm-lock": "packages:", "pyproject": "[tool.poetry.dependencies]"}.get(form)
    text = {
        "cargo-lock": F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\nversion = "'), version, F.lit('"\n'), need(F.concat(F.lit('dependencies = ["'), other, F.when(key % 2 == 0, F.concat(F.lit(" "), wanted)).otherwise(""), F.lit('"]\n')))),
        "poetry-lock": F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\nversion = "'), version, F.lit('"\noptional = '), F.when(key % 3 == 0, "true").otherwise("false"), F.lit("\n"), need(F.concat(F.lit("[package.dependencies]\n"), other, F.lit(' = ">='), wanted, F.lit('"\n')))),
        "yarn-lock": F.concat(F.lit('"'), name, F.lit('@^1", "'), name, F.lit('@~1":\n  version "'), version, F.lit('"\n'), need(F.concat(F.lit("  dependencies:\n    P_"), after.cast("string"), F.lit(' "^1"\n')))),
        "pnpm-lock": F.concat(F.lit("  "), name, F.lit("@"), version, F.lit(":\n    resolution: {integrity: sha}\n"), need(F.concat(F.lit("    dependencies:\n      P_"), after.cast("string"), F.lit(": "), wanted))),
        "pyproject": F.concat(name, F.lit(' = "^'), version, F.lit('"')),
    }[form]
    lines = rows.select((key % 8).alias("folder"), key.alias("at"), text.alias("value"))
    if head:
        lines = lines.unionByName(lines.select("folder", F.lit(-1).alias("at"), F.lit(head).alias("value")).distinct())
    path = f"{shared_folder(spark)}/files-{form}-{uuid.uuid4().hex}"
    lines.repartition(8, "folder").sortWithinPartitions("folder", "at").select("folder", "value").write.partitionBy("folder").text(path)
    return path


def _locked(form: str):
    def query(spark, sf):
        return load(spark, form, _lock_files(spark, sf, form))[1].select("src", "dst", "scope", "constraint", "resolved")

    return query


def _lock_sql(root: str, scope: str, constraint: str, root_scope: str = "'runtime'") -> str:
    return f"""WITH p AS (SELECT p_partkey AS k, concat('P_', p_partkey, '==', p_size, '.0') AS id, concat(p_size, '.0') AS v FROM part)
 SELECT a.id AS src, b.id AS dst, {scope} AS scope, {constraint} AS "constraint", b.v AS resolved FROM p a JOIN p b ON b.k = a.k + 8
 UNION ALL SELECT '{root}', b.id, {root_scope}, NULL, b.v FROM p b WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.k = b.k - 8)"""


def _specs(spark, sf):
    nodes, edges = _graph(spark, sf)
    asked = Q.specs(spark, ["dependencies:p0", "dependents:p5", "dependency-path:p0->p17", "dependent-path:p9->p3", "dependencies:none"])
    return Q.batch_report(nodes, edges, asked).select("qid", "direction", "node", "kind", "result_count")


P = with_("pnodes", "pedges")
_r = lambda x, s, f: _bfs("pedges", "pnodes", s, f).replace("r(n", f"{x}(n").replace("FROM r ", f"FROM {x} AS r ").replace("recurring.r", f"recurring.{x}")

QUERIES = {
    "loaded_requirements": _requirements,
    "loaded_transactions": _transactions,
    "loaded_installed": _installed,
    "loaded_dot_reachable": _dot_reachable,
    "loaded_feed_matches": _feed,
    "loaded_maven_edges": _maven,
    **{f"loaded_{form.replace('-', '_')}": _locked(form) for form in ("cargo-lock", "poetry-lock", "yarn-lock", "pnpm-lock", "pyproject")},
    "query_reports": _operations,
    "selected_nodes": _selectors,
    "batch_report": _specs,
    "dependency_path_report": lambda s, d: Q.path_report(*_graph(s, d), "p0", "pkg:x/p18"),
    "rendered_chains": lambda s, d: G.rendered_chains(G.impact(table(s, d, "pnodes"), table(s, d, "pedges"), "p11"), 12),
}

SQL = {
    "loaded_requirements": REQUIREMENTS,
    "loaded_transactions": TRANSACTIONS,
    "loaded_installed": INSTALLED,
    "loaded_dot_reachable": P + "," + _bfs("pedges", "pnodes", "p0") + " SELECT id AS package, d AS distance FROM r JOIN pnodes ON n = vid WHERE d > 0",
    "loaded_feed_matches": with_("packages", "advisories") + f"SELECT advisory AS record, id, severity FROM advisories a JOIN packages p ON a.package = p.name AND p.ecosystem = 'npm' WHERE {VKEY.format('p.version')} >= {VKEY.format('a.introduced')} AND {VKEY.format('p.version')} < {VKEY.format('a.fixed')}",
    "loaded_maven_edges": MAVEN,
    "query_reports": P + "," + _r("a", "p1", True) + "," + _r("b", "p0", True) + """ SELECT 'dependencies' AS operation, (SELECT count(*) FROM pedges WHERE src = 3) AS result_count, 'nodes' AS result_kind, NULL::BOOLEAN AS path_found
      UNION ALL SELECT 'dependents', (SELECT count(*) FROM pedges WHERE dst = 7), 'nodes', NULL UNION ALL SELECT 'reachable', (SELECT count(*) FROM a WHERE d > 0), 'nodes', NULL
      UNION ALL SELECT 'path', coalesce((SELECT d + 1 FROM b WHERE n = 18), 0), 'path', EXISTS (SELECT 1 FROM b WHERE n = 18) UNION ALL SELECT 'most-depended-upon', least(10, (SELECT count(DISTINCT dst) FROM pedges)), 'ranking', NULL""",
    "selected_nodes": SELECTORS,
    "loaded_cargo_lock": _lock_sql("cargo-lock==resolved", "'runtime'", "CASE WHEN a.k % 2 = 0 THEN b.v END"),
    "loaded_poetry_lock": _lock_sql("poetry-lock==resolved", "CASE WHEN a.k % 3 = 0 THEN 'optional' ELSE 'runtime' END", "concat('>=', b.v)", "CASE WHEN b.k % 3 = 0 THEN 'optional' ELSE 'runtime' END"),
    "loaded_yarn_lock": _lock_sql("yarn-lock==resolved", "'runtime'", "'^1'"),
    "loaded_pnpm_lock": _lock_sql("pnpm-lock==resolved", "'runtime'", "b.v"),
    "loaded_pyproject": "SELECT 'pyproject==0.0.0' AS src, concat('p-', p_partkey, '==^', p_size, '.0') AS dst, 'runtime' AS scope, concat('^', p_size, '.0') AS \"constraint\", NULL::VARCHAR AS resolved FROM part",
    "batch_report": P + "," + ", ".join(_r(x, s, f) for x, s, f in (("a", "p0", True), ("b", "p5", False), ("c", "p9", False))) + """ SELECT 0::BIGINT AS qid, 'dependencies' AS direction, 'p0' AS node, 'nodes' AS kind, count(*) AS result_count FROM a WHERE d > 0 UNION ALL SELECT 1, 'dependents', 'p5', 'nodes', count(*) FROM b WHERE d > 0
      UNION ALL SELECT 2, 'dependencies', 'p0', 'path', coalesce(max(d) + 1, 0) FROM a WHERE n = 17 UNION ALL SELECT 3, 'dependents', 'p9', 'path', coalesce(max(d) + 1, 0) FROM c WHERE n = 3 UNION ALL SELECT 4, 'dependencies', 'none', 'nodes', 0""",
    "dependency_path_report": P + "," + _r("a", "p0", True) + "," + _r("b", "p18", False) + """ SELECT 'p18' AS package, array_to_string(list_transform(p, lambda x: 'p' || x), '>') AS path, d + 1 AS path_length, (SELECT count(*) FROM pedges WHERE dst = 18) AS direct_dependents, (SELECT count(*) FROM b WHERE d > 0) AS reachable_dependents,
      len(list_filter(range(1, len(p)), lambda i: p[i] % 2 <> p[i + 1] % 2)) AS cross_ecosystem_edges FROM a WHERE n = 18""",
    "rendered_chains": P + "," + _bfs("pedges", "pnodes", "p11", False) + " SELECT id AS package, d AS distance, array_to_string(list_transform(list_reverse(p), lambda x: 'p' || x), '>') AS chain FROM r JOIN pnodes ON n = vid WHERE d > 0 ORDER BY d, id LIMIT 12",
}
