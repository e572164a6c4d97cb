"""Registered queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import joins as J
from .derive import table, with_

C = F.col

INSTALLED = """SELECT DISTINCT path FROM (SELECT concat('node_modules/', split_part(p_name, ' ', 1)) AS path FROM {part} WHERE p_partkey % 2 = 0
  UNION ALL SELECT concat('node_modules/', split_part(p_name, ' ', 1), '/node_modules/', split_part(p_name, ' ', 2)) FROM {part} WHERE p_partkey % 3 = 0
  UNION ALL SELECT concat('node_modules/', split_part(p_name, ' ', 2)) FROM {part} WHERE p_partkey % 200 = 1) AS t"""
WANTED = """SELECT DISTINCT path, dep FROM (SELECT concat('node_modules/', split_part(p_name, ' ', 1), '/node_modules/', split_part(p_name, ' ', 2)) AS path, split_part(p_name, ' ', 2) AS dep FROM {part}
  UNION ALL SELECT concat('node_modules/', split_part(p_name, ' ', 2), '/node_modules/', split_part(p_name, ' ', 1)), split_part(p_name, ' ', 2) FROM {part}
  UNION ALL SELECT concat('node_modules/', split_part(p_name, ' ', 1)), 'absent' FROM {part} UNION ALL SELECT '', split_part(p_name, ' ', 2) FROM {part}) AS t"""


def _node_modules(spark, sf):
    part = table(spark, sf, "part")
    return J.nearest_installed(spark.sql(WANTED, part=part), spark.sql(INSTALLED, part=part))


def _asked(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(C("p_partkey") % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-x"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return p.select(name.alias("name"), F.concat((C("p_size") % 5).cast("string"), F.lit("."), (C("p_partkey") % 10).cast("string"), F.lit("."), "p_size").alias("version")).distinct()


def _lookup(spark, sf):
    single = table(spark, sf, "packages").where("vid % 50 = 0").withColumn("name", F.concat("name", F.lit("-x")))
    return J.exact_or_unique(_asked(spark, sf), table(spark, sf, "packages").where("vid % 2 = 0").select("id", "name", "version").unionByName(single.select("id", "name", "version")))


def _advisories(spark, sf):
    """For each brand advisories by name with a range, by name with versions or with none, by purl, and by id."""
    a, none = table(spark, sf, "advisories"), F.lit(None).cast("string")
    bound = F.array(F.struct(C("introduced").alias("introduced"), C("fixed").alias("fixed"), none.alias("last_affected"), none.alias("limit")))
    free, empty = F.array().cast(bound_type := "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"), F.array().cast("array<string>")
    row = lambda kind, **c: a.select(F.concat("advisory", F.lit(kind)).alias("advisory"), "severity", *[c.get(k, d).alias(k) for k, d in (("ecosystem", C("ecosystem")), ("purls", empty), ("package_id", none), ("package", none), ("versions", empty), ("ranges", free))])
    name = C("package")
    parts = [
        row("", package=name, ranges=bound.cast(bound_type)), row("-v", package=name, versions=F.array(C("introduced"), F.lit("1.1.1"), F.lit("2.2.2"))), row("-all", package=name, ecosystem=none),
        row("-purl", purls=N.purl_forms(F.concat(F.lit("pkg:npm/"), name, F.lit("@1.1.1?arch=any")))), row("-id", package_id=F.concat(name, F.lit("==2.2.2"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def matches(spark, sf):
    meta = F.create_map(F.lit("purl"), F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version"))
    return J.advisory_matches(_advisories(spark, sf), J.advisory_packages(table(spark, sf, "packages").select("id", "ecosystem", meta.alias("meta"))))


def _halves(spark, sf):
    a = table(spark, sf, "artifacts").select("task", "build", "part", "name", "arch", "version", "release", "filename", F.concat("name", F.lit(".src.rpm")).alias("source_rpm"), (C("part") % 3).cast("string").alias("epoch"))
    a = a.withColumn("node", F.concat("name", F.lit("=="), "version", F.lit("-"), "release", F.lit("."), "arch", F.lit("#"), C("build").cast("string"))).withColumn("summary", F.concat(F.lit("s"), (C("build") % 2).cast("string")))
    a = a.withColumn("cas_hash", F.md5("node")).withColumn("href", F.concat(F.lit("/a/"), "filename")).withColumn("build_arch", F.when(C("arch") == "src", "x86_64").otherwise(C("arch")))
    return a.where("task % 2 = 0"), a.where("task % 2 = 1")


def _installed(spark, sf):
    return table(spark, sf, "artifacts").where("part % 4 <> 0").select("name", "version", F.when(C("part") % 3 == 0, "9.el8").otherwise(C("release")).alias("release"), "arch").distinct()


def _provenance(spark, sf):
    return J.provenance(_installed(spark, sf), table(spark, sf, "artifacts").where("arch <> 'src' AND filename NOT LIKE '%-debuginfo-%'"))


def _actions(spark, sf):
    part = table(spark, sf, "part").select(C("p_partkey").alias("idx"), F.concat("p_name", F.lit("=="), (C("p_size") % 9).cast("string")).alias("id"), C("p_name").alias("name"), F.when(C("p_partkey") % 2 == 0, "x86_64").otherwise("src").alias("arch"))
    return J.action_match(part, part.where("idx % 17 = 0"))


def _changes(spark, sf):
    l, r = table(spark, sf, "lefts"), table(spark, sf, "rights")
    return J.paired(l.join(r, "id", "left_anti"), r.join(l, "id", "left_anti"))


def _selectors(spark, sf):
    packages = table(spark, sf, "packages").withColumn("purl", F.concat(F.lit("pkg:"), "name"))
    out = None
    for text in ("red-widget", "nothing", "pkg:red-widget", "red-widget==1.1.1"):
        row = J.selector(packages, text)
        out = row if out is None else out.unionByName(row)
    return out


def _tree(spark, sf):
    lines = table(spark, sf, "lineitem").select(C("l_orderkey").alias("tree"), C("l_linenumber").cast("long").alias("line"), (F.least(C("l_partkey") % 3 + 1, C("l_linenumber"))).cast("long").alias("depth"), F.concat((C("l_linenumber")).cast("string"), F.lit(":"), "l_partkey").alias("id"))
    return J.tree_parents(lines.groupBy("tree", "line").agg(F.max_by("depth", "id").alias("depth"), F.max("id").alias("id"))).select("tree", "line", "parent")


QUERIES = {
    "requires_providers": lambda s, d: J.provided(table(s, d, "requires"), table(s, d, "provides")),
    "unresolved_requirements": lambda s, d: J.unresolved(table(s, d, "requires"), table(s, d, "provides")),
    "node_modules_resolution": _node_modules,
    "exact_or_unique_lookup": _lookup,
    "orphan_roots": lambda s, d: J.orphans(table(s, d, "nodes"), table(s, d, "edges")).select("id"),
    "first_requirements": lambda s, d: J.first_requirements(table(s, d, "lineitem").groupBy(C("l_orderkey").alias("pkg")).agg(F.array_sort(F.collect_set("l_partkey")).alias("requires")), 2),
    "advisory_matches": lambda s, d: matches(s, d).select("advisory", "id"),
    "snapshot_node_diff": lambda s, d: J.keyed_diff(table(s, d, "lefts"), table(s, d, "rights"), ["id"], ["license", "ecosystem"], "id"),
    "snapshot_edge_diff": lambda s, d: J.edge_diff(table(s, d, "pedges").where("src % 7 <> 0").select("src", "dst", "rel"), table(s, d, "pedges").where("src % 5 <> 0").select("src", "dst", "rel")),
    "repo_diff": lambda s, d: J.keyed_diff(*_halves(s, d), ["name", "arch"], ["epoch", "version", "release", "source_rpm", "summary", "node"], "node"),
    "build_diff": lambda s, d: J.keyed_diff(*[x.withColumn("kind", F.when(C("arch") == "src", "srpm").otherwise("rpm")) for x in _halves(s, d)], ["kind", "name", "arch", "build_arch"], ["filename", "version", "release", "cas_hash", "href"], "node"),
    "provenance_match": lambda s, d: _provenance(s, d).where("build IS NOT NULL"),
    "provenance_unmatched": lambda s, d: _provenance(s, d).where("build IS NULL").select("name", "version", "release", "arch"),
    "action_match": _actions,
    "paired_changes": _changes,
    "selector_resolution": _selectors,
    "tree_parents": _tree,
}

PART = {"part": "part"}
LOOK = """asked AS (SELECT DISTINCT concat(replace(p_name, ' ', '-'), CASE WHEN p_partkey % 3 = 0 THEN '-x' ELSE '' END) AS name, concat(p_size % 5, '.', p_partkey % 10, '.', p_size) AS version FROM part),
 pk AS (SELECT id, name, version FROM packages WHERE vid % 2 = 0 UNION ALL SELECT id, concat(name, '-x'), version FROM packages WHERE vid % 50 = 0)"""
VKEY = "list_transform(regexp_extract_all({0}, '\\d+|[A-Za-z]+'), lambda t: {{'i': regexp_matches(t, '^[0-9]')::INT, 'n': coalesce(TRY_CAST(t AS BIGINT), 0)}})"
MATCHES = f"""ms AS (SELECT advisory, id, severity FROM advisories a JOIN packages p ON a.package = p.name AND a.ecosystem = p.ecosystem
  WHERE {VKEY.format('p.version')} >= {VKEY.format('a.introduced')} AND {VKEY.format('p.version')} < {VKEY.format('a.fixed')}
  UNION ALL SELECT concat(advisory, '-v'), id, severity FROM advisories a JOIN packages p ON a.package = p.name AND a.ecosystem = p.ecosystem WHERE p.version IN (a.introduced, '1.1.1', '2.2.2')
  UNION ALL SELECT concat(advisory, '-all'), id, severity FROM advisories a JOIN packages p ON a.package = p.name
  UNION ALL SELECT concat(advisory, '-purl'), id, severity FROM advisories a JOIN packages p ON a.package = p.name AND p.version = '1.1.1' AND a.ecosystem = p.ecosystem
  UNION ALL SELECT concat(advisory, '-id'), id, severity FROM advisories a JOIN packages p ON a.package = p.name AND p.version = '2.2.2' AND a.ecosystem = p.ecosystem), matches AS (SELECT * FROM ms)"""
NODE = "concat(name, '==', version, '-', release, '.', arch, '#', build)"
ROWS = f"x AS (SELECT *, {NODE} AS node, concat(name, '.src.rpm') AS source_rpm, (part % 3)::VARCHAR AS epoch, concat('s', build % 2) AS summary, md5({NODE}) AS cas_hash, concat('/a/', filename) AS href, CASE WHEN arch = 'src' THEN 'x86_64' ELSE arch END AS build_arch, CASE WHEN arch = 'src' THEN 'srpm' ELSE 'rpm' END AS kind FROM artifacts)"


def _diffed(key: tuple[str, ...], fields: tuple[str, ...]) -> str:
    """A full outer join of the halves by key, with the names of the fields that differ; of rows with one key the last by node counts."""
    k, on = ", ".join(key), " AND ".join(f"l.{c} = r.{c}" for c in key)
    side = lambda n: f"(SELECT * FROM x WHERE task % 2 = {n} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY node DESC) = 1)"
    named = ", ".join(f"coalesce(l.{c}, r.{c}) AS {c}" for c in key)
    differ = " OR ".join(f"l.{f} <> r.{f}" for f in fields)
    words = ", ".join(f"CASE WHEN l.{f} <> r.{f} THEN '{f}' END" for f in fields)
    return with_("artifacts").rstrip() + f""", {ROWS} SELECT {named}, CASE WHEN l.name IS NULL THEN 'added' WHEN r.name IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN l.name IS NULL OR r.name IS NULL THEN '' ELSE concat_ws(',', {words}) END AS fields FROM {side(0)} l FULL JOIN {side(1)} r ON {on} WHERE l.name IS NULL OR r.name IS NULL OR {differ}"""


REPO_DIFF = _diffed(("name", "arch"), ("epoch", "version", "release", "source_rpm", "summary", "node"))
BUILD_DIFF = _diffed(("kind", "name", "arch", "build_arch"), ("filename", "version", "release", "cas_hash", "href"))
INST = "inst AS (SELECT DISTINCT name, version, CASE WHEN part % 3 = 0 THEN '9.el8' ELSE release END AS release, arch FROM artifacts WHERE part % 4 <> 0), built AS (SELECT name, version, release, arch, min(build) AS build FROM artifacts WHERE arch <> 'src' AND filename NOT LIKE '%-debuginfo-%' GROUP BY ALL)"

SQL = {
    "requires_providers": with_("requires", "provides") + "SELECT DISTINCT r.pkg, r.cap, p.pkg AS provider FROM requires r JOIN provides p ON r.cap = p.cap AND r.pkg <> p.pkg",
    "unresolved_requirements": with_("requires", "provides") + "SELECT r.pkg, r.cap FROM requires r WHERE NOT EXISTS (SELECT 1 FROM provides p WHERE p.cap = r.cap AND p.pkg <> r.pkg)",
    "node_modules_resolution": f"WITH i AS ({INSTALLED.format(**PART)}), w AS ({WANTED.format(**PART)})" + """, c AS (
      SELECT path, dep, CASE WHEN path = '' THEN NULL ELSE concat(path, '/node_modules/', dep) END AS c0,
             CASE WHEN path LIKE '%/node_modules/%' THEN concat(regexp_extract(path, '^(.*)/node_modules/[^/]*$', 1), '/node_modules/', dep) END AS c1, concat('node_modules/', dep) AS c2 FROM w)
      SELECT path, dep, coalesce(a.path_, b.path_, e.path_) AS target FROM c LEFT JOIN (SELECT path AS path_ FROM i) a ON a.path_ = c0 LEFT JOIN (SELECT path AS path_ FROM i) b ON b.path_ = c1 LEFT JOIN (SELECT path AS path_ FROM i) e ON e.path_ = c2""",
    "exact_or_unique_lookup": with_("packages").rstrip() + ", " + LOOK + " SELECT a.name, a.version, coalesce(e.id, (SELECT min(id) FROM pk WHERE pk.name = a.name HAVING count(*) = 1)) AS found FROM asked a LEFT JOIN pk e ON e.name = a.name AND e.version = a.version",
    "orphan_roots": with_("nodes", "edges") + "SELECT id FROM nodes WHERE vid NOT IN (SELECT dst FROM edges)",
    "first_requirements": "SELECT * FROM (SELECT l_orderkey AS pkg, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1)::INT AS pos, l_partkey AS cap FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE pos < 2",
    "advisory_matches": with_("packages", "advisories").rstrip() + ", " + MATCHES + " SELECT advisory, id FROM matches",
    "snapshot_node_diff": with_("lefts", "rights") + """SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN l.id IS NULL OR r.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.license IS DISTINCT FROM r.license THEN 'license' END, CASE WHEN l.ecosystem IS DISTINCT FROM r.ecosystem THEN 'ecosystem' END) END AS fields
      FROM lefts l FULL JOIN rights r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.license IS DISTINCT FROM r.license OR l.ecosystem IS DISTINCT FROM r.ecosystem""",
    "snapshot_edge_diff": with_("pnodes", "pedges") + "SELECT src, dst, rel, 'added' AS change FROM pedges WHERE src % 5 <> 0 AND src % 7 = 0 UNION ALL SELECT src, dst, rel, 'removed' FROM pedges WHERE src % 7 <> 0 AND src % 5 = 0",
    "repo_diff": REPO_DIFF,
    "build_diff": BUILD_DIFF,
    "provenance_match": with_("artifacts").rstrip() + ", " + INST + " SELECT inst.*, build FROM inst JOIN built USING (name, version, release, arch)",
    "provenance_unmatched": with_("artifacts").rstrip() + ", " + INST + " SELECT inst.* FROM inst ANTI JOIN built USING (name, version, release, arch)",
    "action_match": """WITH a AS (SELECT p_partkey AS idx, concat(p_name, '==', p_size % 9) AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x86_64' ELSE 'src' END AS arch FROM part), g AS (SELECT * FROM a WHERE idx % 17 = 0),
      f AS (SELECT name, arch, min(id) AS first FROM g GROUP BY name, arch)
      SELECT a.idx, coalesce(e.id, f.first) AS node, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN f.first IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM a LEFT JOIN (SELECT DISTINCT id FROM g) e ON e.id = a.id LEFT JOIN f ON f.name = a.name AND f.arch = a.arch""",
    "paired_changes": with_("lefts", "rights").rstrip() + """, o AS (SELECT name, id AS old, row_number() OVER (PARTITION BY name ORDER BY id)::INT AS position FROM lefts WHERE id NOT IN (SELECT id FROM rights)),
      n AS (SELECT name, id AS new, row_number() OVER (PARTITION BY name ORDER BY id)::INT AS position FROM rights WHERE id NOT IN (SELECT id FROM lefts)) SELECT name, position, old, new FROM o JOIN n USING (name, position)""",
    "selector_resolution": with_("packages").rstrip() + """, q AS (SELECT * FROM (VALUES ('red-widget'), ('nothing'), ('pkg:red-widget'), ('red-widget==1.1.1')) t(selector)),
      h AS (SELECT selector, count(*) FILTER (id = selector) AS i, count(*) FILTER (concat('pkg:', name) = selector) AS p, count(*) FILTER (name = selector) AS n, min(id) FILTER (concat('pkg:', name) = selector) AS bp, min(id) FILTER (name = selector) AS bn FROM q, packages GROUP BY selector)
      SELECT selector, CASE WHEN i > 0 OR p + n = 0 THEN selector WHEN p = 1 THEN bp WHEN p = 0 AND n = 1 THEN bn END AS chosen, greatest(i, CASE WHEN p > 0 THEN p ELSE n END) AS candidates FROM h""",
    "tree_parents": """WITH l AS (SELECT l_orderkey AS tree, l_linenumber::BIGINT AS line, max_by(least(l_partkey % 3 + 1, l_linenumber)::BIGINT, concat(l_linenumber, ':', l_partkey)) AS depth, max(concat(l_linenumber, ':', l_partkey)) AS id FROM lineitem GROUP BY 1, 2)
      SELECT a.tree, a.line, (SELECT max_by(b.id, b.line) FROM l b WHERE b.tree = a.tree AND b.line < a.line AND b.depth = a.depth - 1) AS parent FROM l a""",
}
