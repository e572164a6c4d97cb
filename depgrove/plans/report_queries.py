"""Registered queries for reports, diffs and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import diff as D
from ..operators import graph as G
from ..operators import joins as J
from ..operators import reports as R
from ..operators import transactions as T
from .derive import table, with_
from .join_queries import BUILD_DIFF, MATCHES, REPO_DIFF, matches

C = F.col
DENIED = ("GPL-3.0-only", "Apache-2.0")


def _licenses(spark, sf):
    return R.license_rows(table(spark, sf, "packages"), DENIED)


def _logs(spark, sf):
    lines = table(spark, sf, "logs")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("user_id", "day").agg(text.alias("text"))


def _tasks(spark, sf):
    return table(spark, sf, "artifacts")


def _reports(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("kind-"), (C("p_size") % 7).cast("string")).alias("kind"), (C("p_size") % 3).cast("long").alias("findings"), F.when(C("p_size") % 7 < 3, (C("p_partkey") % 50 == 0).cast("long")).otherwise(0).alias("failures"), C("p_size").alias("largest"))


def _bundles(spark, sf):
    p = table(spark, sf, "part")
    return p.select(C("p_type").alias("kind"), C("p_partkey").alias("ord"), C("p_size").cast("long").alias("reports"), F.when(C("p_partkey") % 3 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("codes"))


def _changes(spark, sf):
    return D.classified(table(spark, sf, "lefts"), table(spark, sf, "rights"))


def _tree(spark, sf):
    nodes, e = table(spark, sf, "pnodes"), table(spark, sf, "pedges")
    found = D.neighbourhood_diff(nodes, e.where("src % 7 <> 6"), e.where("src % 5 <> 4"), "p0")
    return found.groupBy("change").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("left_distance"), F.lit(0)).alias("left_total"), F.coalesce(F.sum("right_distance"), F.lit(0)).alias("right_total"))


def _regressions(spark, sf):
    a = _tasks(spark, sf)
    side = lambda k: a.where(C("task") % 2 == k).groupBy("name").agg(F.count("*").alias("tasks"), F.max("seconds").alias("longest"))
    return D.regressions(side(1), side(0), "name", {"tasks": 1, "longest": -1})


def _advisory_summary(spark, sf):
    found = matches(spark, sf)
    packages = table(spark, sf, "packages").select("vid", "id")
    reached = G.affected(packages_of_parts(spark, sf), table(spark, sf, "pedges"), found.join(packages, "id").select(F.concat(F.lit("p"), "vid").alias("id")))
    counts = found.agg(F.count("*").alias("findings"), F.countDistinct("id").alias("packages"), F.countDistinct("advisory").alias("advisories"))
    return counts.withColumn("affected_dependents", reached.agg(F.count("*").alias("n")).scalar())


def packages_of_parts(spark, sf):
    return table(spark, sf, "pnodes")


def _few_affected(spark, sf):
    """All that depends on a few packages that depend on each other in part."""
    ids = spark.createDataFrame([(f"p{k}",) for k in (3, 22, 40)], "id string")
    return G.affected(table(spark, sf, "pnodes"), table(spark, sf, "pedges"), ids)


def _builds(spark, sf):
    """Orders as builds: their lines are tasks; a build is signed or tested by its key."""
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("build"), (C("o_orderkey") % 2 == 0).alias("released"), (C("o_orderkey") % 3).cast("long").alias("sign_tasks"), (C("o_orderkey") % 4).cast("long").alias("test_tasks"))
    lists = F.when(C("task") % 2 == 0, F.array(F.lit("src"), F.lit("s390x"))).otherwise(F.array(F.lit("aarch64"), F.lit("noarch"), F.lit("a-z"))).cast("array<string>")
    status = F.when(C("status") == "A", "DONE").when(C("status") == "N", "3").otherwise("9")
    return R.completeness(o, _tasks(spark, sf).select("build", "arch", status.alias("status"), lists.alias("arch_list")))


def _stamped(spark, sf):
    """started and finished of the lines of each order, as text."""
    at = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    return _tasks(spark, sf).select("build", "task", at(C("part") * 60).alias("started"), F.when(C("task") % 5 == 0, "open").otherwise(at(C("part") * 60 + C("seconds").cast("long"))).alias("finished"))


def _timing(spark, sf):
    t = _stamped(spark, sf)
    builds = table(spark, sf, "orders").select(C("o_orderkey").alias("build"), F.lit("2024-05-01T10:00:00").alias("created"), F.when(C("o_orderkey") % 7 > 0, "2024-05-01T10:01:00").alias("finished"))
    return R.timing_summary(builds, t, t.where("task % 2 = 0"), _tasks(spark, sf).where("part % 2 = 0").select("build"))


def _histograms(spark, sf):
    a = _tasks(spark, sf).select(F.lit(0).alias("build"), F.when(C("part") % 6 == 0, "").otherwise("rpm").alias("type"), F.when(C("part") % 6 == 0, "build.log").otherwise(C("filename")).alias("name"))
    return R.timing_histograms(a)


def _plan(spark, sf):
    p = table(spark, sf, "part").groupBy(C("p_brand").alias("group")).agg(F.count("*").alias("files"), (F.sum("p_size") % 3).alias("k"), (F.sum("p_partkey") % 4).alias("d"))
    priority = F.when(C("k") == 0, "low").when(C("k") == 1, "medium").otherwise("high")
    return R.replacement_plan(p.select("group", "files", priority.alias("priority"), F.element_at(F.array(*map(F.lit, ("hybrid", "review", "keep", "replace-where-practical"))), (C("d") + 1).cast("int")).alias("decision")))


PLAN = """WITH g AS (SELECT p_brand AS "group", count(*) AS files, sum(p_size) % 3 AS k, sum(p_partkey) % 4 AS d FROM part GROUP BY 1),
 p AS (SELECT "group", files, CASE k WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority, ['hybrid', 'review', 'keep', 'replace-where-practical'][(d + 1)::INT] AS decision, d <> 2 AND k > 0 AS candidate, k FROM g),
 plan AS (SELECT "group", files, priority, decision, candidate, CASE WHEN candidate THEN row_number() OVER (PARTITION BY candidate ORDER BY k DESC, files DESC, "group") END AS rank FROM p)"""


def _repo(spark, sf):
    """Parts as the packages of a repository; capabilities are brands that some parts need and none gives."""
    p = table(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("package").alias("node_type"), F.concat(F.lit("a"), (C("p_size") % 3).cast("string")).alias("arch"), F.when(C("p_size") % 5 > 0, C("p_brand")).otherwise("").alias("source_rpm"), F.lit(None).cast("string").alias("capability"))
    caps = p.select("p_type").distinct().select(F.concat(F.lit("rpm-capability:"), "p_type").alias("id"), F.lit("unresolved_requirement").alias("node_type"), F.lit(None).cast("string").alias("arch"), F.lit(None).cast("string").alias("source_rpm"), C("p_type").alias("capability"))
    edges = p.select(F.lit("root").alias("src"), F.concat(F.lit("p"), "p_partkey").alias("dst"))
    edges = edges.unionByName(p.where("p_size % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("rpm-capability:"), "p_type").alias("dst")))
    edges = edges.unionByName(table(spark, sf, "pedges").select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst")))
    return nodes.unionByName(caps), edges


def _triage(spark, sf):
    """Events as reports whose counters are filled by their keys."""
    e = table(spark, sf, "events").select(C("event_id").alias("ord"), (C("event_id") % 9).cast("int").alias("k"), (C("event_id") % 5).cast("long").alias("n"))
    kinds = F.array(*map(F.lit, ("advisory.report", "license.report", "graph.diff", "bundle.catalog", "npm.diagnostics", "graph.diff_tree", "performance.report", "real_data.coverage", "graph.snapshot")))
    names = F.array(*map(F.lit, ("findings", "deniedFindings", "policyFailures", "triageWarn", "npmUnresolvedDependencies", "policyFailures", "performanceMaxNodes", "failures", "nodes")))
    at = (C("k") + 1).cast("int")
    return e.select("ord", F.element_at(kinds, at).alias("kind"), F.create_map(F.element_at(names, at), F.when(C("k").isin(3, 4, 6, 8), C("n")).otherwise((C("n") == 4).cast("long"))).alias("counters"))


TRIAGE = """WITH e AS (SELECT event_id AS ord, event_id % 9 AS k, event_id % 5 AS n FROM events), r AS (SELECT ord, ['advisory.report', 'license.report', 'graph.diff', 'bundle.catalog', 'npm.diagnostics', 'graph.diff_tree', 'performance.report', 'real_data.coverage', 'graph.snapshot'][(k + 1)::INT] AS kind,
  ['findings', 'deniedFindings', 'policyFailures', 'triageWarn', 'npmUnresolvedDependencies', 'policyFailures', 'performanceMaxNodes', 'failures', 'nodes'][(k + 1)::INT] AS counter, CASE WHEN k IN (3, 4, 6, 8) THEN n ELSE (n = 4)::INT END AS value FROM e)"""


def _ranked_changes(spark, sf):
    from .join_queries import QUERIES as joins

    return D.ranked_changes(joins["repo_diff"](spark, sf), "name", "arch").select("change", "rank", "name", "arch", "fields")


def _ranked_artifacts(spark, sf):
    from .join_queries import QUERIES as joins

    return D.ranked_changes(joins["build_diff"](spark, sf), "name", "arch", "build_arch").select("change", "rank", "kind", "name", "arch", "build_arch", "fields")


def _distant(spark, sf):
    changes = _changes(spark, sf).withColumn("left_distance", F.when(F.length("name") % 3 == 0, F.length("name"))).withColumn("right_distance", F.when(F.length("name") % 4 == 0, F.length("name") - 2))
    return D.top_findings(changes).select("kind", "name", "old", "new")


def _catalog(spark, sf):
    p = table(spark, sf, "part")
    triage = F.element_at(F.array(*map(F.lit, ("pass", "warn", "not-present"))), (C("p_partkey") % 3 + 1).cast("int"))
    rows = p.select((C("p_size") % 50 > 0).alias("ok"), C("p_size").alias("reports"), F.lit(0).alias("failures"), triage.alias("triage"), F.when(C("p_size") == 1, 1).otherwise(0).alias("graphDiffPolicyFailures"))
    return R.catalog_status(rows, ("graphDiffPolicyFailures",))


def _timing_deltas(spark, sf):
    side = lambda k: _tasks(spark, sf).where(C("task") % 2 == k).agg(F.max("seconds").alias("critical"), F.sum("seconds").alias("total"), F.lit(3.0).alias("same"))
    return D.timing_deltas(side(0), side(1), ("critical", "total", "same"))


def _commits(spark, sf):
    side = lambda k: table(spark, sf, "part").where(C("p_partkey") % 2 == k).select(F.when(C("p_size") > 3 + k, C("p_brand")).otherwise("").alias("commit"))
    return D.commit_findings(side(0).where("commit <> 'Brand#1'"), side(1))


def _transactions(spark, sf):
    """Parts as the actions of one transaction over a graph of some of them."""
    p = table(spark, sf, "part").withColumn("arch", F.when(C("p_size") % 2 == 0, "x86_64").otherwise("noarch"))
    text = lambda v: F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), v.cast("string"), F.lit("-1."), "arch")
    none = N.transaction_package(F.lit(""))
    change = C("p_partkey") % 3 == 0
    actions = p.select(F.lit("t").alias("graph"), C("p_partkey").alias("idx"), F.when(change, "upgrade").when(C("p_partkey") % 3 == 1, "install").otherwise("erase").alias("action"), F.when(change, none).otherwise(N.transaction_package(text(C("p_size")))).alias("package"), F.when(change, N.transaction_package(text(C("p_size")))).otherwise(none).alias("old"), F.when(change, N.transaction_package(text(C("p_size") + 1))).otherwise(none).alias("new"))
    own = p.where("p_partkey % 11 = 0").groupBy(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("=="), C("p_size").cast("string"), F.lit("-1."), "arch").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), "arch").agg(F.count("*").alias("n"), F.max("p_size").alias("affected"))
    return actions, own


def _transaction_rows(spark, sf):
    actions, own = _transactions(spark, sf)
    found = J.transaction_matches(actions, own.select("id", "name", "arch"))
    counts = own.select(C("id").alias("node"), C("n").alias("direct"), C("affected").cast("long").alias("affected"))
    return T.impact(actions, found, counts)


def _licensable(spark, sf):
    """The parts as packages, roots, requirements that nothing meets, and capabilities."""
    k = C("p_partkey")
    kind = F.when(k % 5 == 0, "root").when(k % 5 == 1, "unresolved_requirement").when(k % 5 == 2, "package")
    meta = F.map_filter(F.create_map(F.lit("node_type"), kind), lambda _, v: v.isNotNull())
    return R.licensable(table(spark, sf, "part").select(F.concat(F.when(k % 7 == 0, "rpm-capability:").otherwise("p"), k.cast("string")).alias("id"), meta.alias("meta"))).select("id")


def _log_content(spark, sf):
    """Events whose text stands in one of several fields, some of which hold spaces only."""
    e, k = table(spark, sf, "events"), C("event_id")
    fields = [F.when(k % 4 == 0, " \t"), F.when(k % 4 == 1, C("props")), F.when(k % 3 == 0, C("event_type"))]
    return e.select("event_id", R.log_content(*fields).alias("content"))


QUERIES = {
    "licensable": _licensable,
    "log_content": _log_content,
    "advisory_affected": _few_affected,
    "completeness_summary": lambda s, d: R.completeness_summary(_builds(s, d)),
    "build_timing": _timing,
    "artifact_histograms": _histograms,
    "replacement_plan": lambda s, d: _plan(s, d),
    "plan_summary": lambda s, d: R.plan_summary(_plan(s, d)),
    "plan_gate": lambda s, d: D.plan_gate(_plan(s, d), "high"),
    "coverage_gate": lambda s, d: D.coverage_gate(table(s, d, "part").agg(F.bround(100.0 * F.count_if(C("p_size") % 3 == 0) / F.count("*"), 2).alias("percent")), _plan(s, d), 80.0, "medium"),
    "license_gate": lambda s, d: D.license_gate(_licenses(s, d)),
    "repository_summary": lambda s, d: R.repository_summary(*_repo(s, d), "root"),
    "unresolved_capabilities": lambda s, d: R.unresolved_rows(*_repo(s, d)),
    "triage_counters": lambda s, d: D.triage(_triage(s, d)),
    "triage_overall": lambda s, d: D.triage_status(D.triage(_triage(s, d))),
    "triage_checks": lambda s, d: D.triage_checks(_triage(s, d)),
    "triage_first_findings": lambda s, d: D.first_findings(_triage(s, d).select(C("kind").alias("category"), "ord")),
    "repo_top_findings": _ranked_changes,
    "build_top_findings": _ranked_artifacts,
    "diff_nearest_findings": _distant,
    "diff_kind_counts": lambda s, d: D.kind_counts(_changes(s, d)),
    "catalog_status": _catalog,
    "timing_deltas": _timing_deltas,
    "commit_findings": _commits,
    "feed_summary": lambda s, d: R.feed_summary(table(s, d, "advisories").select(C("advisory").alias("id"), "package", "severity")),
    "transaction_impact": _transaction_rows,
    "transaction_summary": lambda s, d: T.summary(_transaction_rows(s, d)),
    "transaction_arches": lambda s, d: T.arches(_transactions(s, d)[0]),
    "diff_tree_paths": lambda s, d: D.neighbourhood_diff(table(s, d, "pnodes"), table(s, d, "pedges").where("src % 7 <> 6"), table(s, d, "pedges").where("src % 5 <> 4"), "p0"),
    "diff_tree_edges": lambda s, d: D.churn(D.neighbourhood_edge_diff(table(s, d, "pnodes"), table(s, d, "pedges").where("src % 7 <> 6"), table(s, d, "pedges").where("src % 5 <> 4"), "p0")),
    "license_histogram": lambda s, d: R.license_histogram(_licenses(s, d)),
    "license_summary": lambda s, d: R.license_summary(_licenses(s, d)),
    "license_findings": lambda s, d: _licenses(s, d).where("denied").select("id", "text"),
    "repo_summary_arch": lambda s, d: _tasks(s, d).groupBy("arch").agg(F.count("*").alias("packages"), F.countDistinct("name").alias("names")),
    "top_source_rpms": lambda s, d: R.top_counts(_tasks(s, d).where("arch = 'src'"), "filename", 20),
    "artifact_inventory": lambda s, d: R.inventory(_tasks(s, d)),
    "inventory_by_arch": lambda s, d: R.inventory_by_arch(_tasks(s, d), N.INVENTORY_ORDER),
    "build_step_totals": lambda s, d: R.step_totals(_tasks(s, d).select(F.concat(F.lit("step-"), "task").alias("step"), "seconds")),
    "critical_wall": lambda s, d: _tasks(s, d).groupBy("build").agg(F.max("seconds").alias("critical"), F.sum("seconds").alias("total")),
    "release_completeness": _builds,
    "log_signals": lambda s, d: R.log_signals(_logs(s, d)).select("user_id", "day", "error", "failed", "fatal", "missing", "warning", "lines"),
    "log_sample": lambda s, d: _logs(s, d).select("user_id", "day", R.log_sample(C("text")).alias("sample")),
    "duplicate_names": lambda s, d: R.duplicate_names(table(s, d, "packages").select("name", "version", F.concat(F.lit("node_modules/"), "name", F.lit("/"), "vid").alias("path"))),
    "version_conflicts": lambda s, d: table(s, d, "artifacts").groupBy("build", "name").agg(F.countDistinct("version").alias("versions")).where("versions > 1"),
    "triage_rollup": lambda s, d: R.rollup(_reports(s, d), "kind"),
    "catalog_by_kind": lambda s, d: R.catalog(_bundles(s, d)),
    "coverage_percent": lambda s, d: R.coverage(table(s, d, "part").select(C("p_type").alias("kind"), (C("p_size") % 3 == 0).alias("public"))),
    "advisory_summary": _advisory_summary,
    "diff_classification": _changes,
    "diff_top_findings": lambda s, d: D.top_findings(_changes(s, d)).select("kind", "name", "old", "new"),
    "diff_tree_summary": _tree,
    "diff_policy": lambda s, d: D.verdict(_changes(s, d), ("downgrade", "removed")),
    "advisory_gate": lambda s, d: D.advisory_gate(matches(s, d), "high"),
    "regressions": _regressions,
    "cnf_clause_counts": lambda s, d: _clauses(s, d),
}


def _clauses(spark, sf):
    """Of a solver's encoding: at most one version of a package, and a clause for each requirement."""
    packages = table(spark, sf, "packages")
    pairs = packages.groupBy("name").agg(F.count("*").alias("n")).select("name", (C("n") * (C("n") - 1) / 2).cast("long").alias("pairs"))
    return pairs.agg(F.sum("pairs").alias("at_most_one"), F.count("*").alias("names"))


LOG = with_("logs").rstrip() + ", t AS (SELECT user_id, day, string_agg(line, chr(10) ORDER BY event_id) AS text, count(*)::INT AS lines, list(line ORDER BY event_id) AS all_lines FROM logs GROUP BY 1, 2)"
LIC = with_("packages").rstrip() + """, r AS (SELECT id, nullif(license, '') AS text, coalesce(license IN ('GPL-3.0-only', 'MIT OR Apache-2.0'), false) AS denied FROM packages)"""
DIFF_KEY = "list_transform(regexp_extract_all({0}, '\\d+|[A-Za-z]+'), lambda t: {{'i': regexp_matches(t, '^[A-Za-z]')::INT, 'n': coalesce(TRY_CAST(t AS BIGINT), 0)}})"
CHANGES = with_("lefts", "rights").rstrip() + f""", gone AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM lefts WHERE id NOT IN (SELECT id FROM rights)),
 come AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM rights WHERE id NOT IN (SELECT id FROM lefts)),
 changes AS (SELECT CASE WHEN g.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN {DIFF_KEY.format('g.version')} < {DIFF_KEY.format('c.version')} THEN 'upgrade' WHEN {DIFF_KEY.format('g.version')} > {DIFF_KEY.format('c.version')} THEN 'downgrade' ELSE 'replacement' END AS kind,
   coalesce(g.name, c.name) AS name, g.id AS old, c.id AS new FROM gone g FULL JOIN come c ON g.name = c.name AND g.k = c.k
  UNION ALL SELECT 'metadataChange', l.id, l.id, r.id FROM lefts l JOIN rights r ON l.id = r.id WHERE l.license IS DISTINCT FROM r.license OR l.ecosystem IS DISTINCT FROM r.ecosystem)"""
A = with_("artifacts")
RPT = "WITH r AS (SELECT concat('kind-', p_size % 7) AS kind, (p_size % 3)::BIGINT AS findings, CASE WHEN p_size % 7 < 3 THEN (p_partkey % 50 = 0)::BIGINT ELSE 0 END AS failures, p_size AS largest FROM part)"


def _near(name: str, where: str) -> str:
    return f"""{name}(n, d) USING KEY (n) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, min(r.d) + 1 FROM {name} AS r JOIN (SELECT * FROM pedges WHERE {where}) e ON e.src = r.n
      WHERE r.d < 3 AND NOT EXISTS (SELECT 1 FROM recurring.{name} x WHERE x.n = e.dst) GROUP BY e.dst)"""


def _near_paths(name: str, where: str) -> str:
    return f"""{name}(n, d, p) USING KEY (n) AS (SELECT 0::BIGINT, 0::BIGINT, [0::BIGINT] UNION SELECT dst, min(d) + 1, min(list_append(p, dst)) FROM (SELECT e.dst, r.d, r.p FROM {name} AS r JOIN (SELECT * FROM pedges WHERE {where}) e ON e.src = r.n
      WHERE r.d < 3 AND NOT EXISTS (SELECT 1 FROM recurring.{name} x WHERE x.n = e.dst)) GROUP BY dst)"""


COMPLETE = A.rstrip() + """, t AS (SELECT build, arch, status, CASE WHEN task % 2 = 0 THEN ['src', 's390x'] ELSE ['aarch64', 'noarch', 'a-z'] END AS list FROM artifacts),
 u AS (SELECT build, unnest(list) AS arch FROM t), w AS (SELECT DISTINCT build, arch, coalesce(list_position(['x86_64', 'aarch64', 'ppc64le', 's390x', 'i686', 'noarch', 'src'], arch), 8) AS k FROM u),
 e AS (SELECT build, string_agg(arch, ',' ORDER BY k, arch) AS expected, coalesce(string_agg(arch, ',' ORDER BY k, arch) FILTER (NOT seen), '') AS missing, count(*) FILTER (NOT seen) AS n_missing FROM (SELECT w.*, EXISTS (SELECT 1 FROM t WHERE t.build = w.build AND t.arch = w.arch) AS seen FROM w) GROUP BY build),
 f AS (SELECT build, count(*) AS build_tasks, count(*) FILTER (status NOT IN ('A', 'N')) AS failed FROM t GROUP BY build),
 items AS (SELECT o_orderkey AS build, o_orderkey % 2 = 0 AS released, coalesce(expected, '') AS expected, coalesce(missing, '') AS missing, coalesce(n_missing, 0) AS n_missing, coalesce(failed, 0) AS failed, coalesce(build_tasks, 0) AS build_tasks, o_orderkey % 3 = 0 AS unsigned, o_orderkey % 4 = 0 AS untested FROM orders LEFT JOIN e ON e.build = o_orderkey LEFT JOIN f ON f.build = o_orderkey)"""
TRANSACTION = """WITH p AS (SELECT p_partkey AS idx, replace(p_name, ' ', '-') AS name, p_size AS size, CASE WHEN p_size % 2 = 0 THEN 'x86_64' ELSE 'noarch' END AS arch FROM part),
 own AS (SELECT concat(name, '==', size, '-1.', arch) AS id, name, arch, count(*) AS n, max(size)::BIGINT AS affected FROM p WHERE idx % 11 = 0 GROUP BY 1, 2, 3), first AS (SELECT name, arch, min(id) AS id FROM own GROUP BY 1, 2),
 asked AS (SELECT idx, CASE idx % 3 WHEN 0 THEN 'old' ELSE 'package' END AS role, name, arch, concat(name, '==', size, '-1.', arch) AS node FROM p UNION ALL SELECT idx, 'new', name, arch, concat(name, '==', size + 1, '-1.', arch) FROM p WHERE idx % 3 = 0),
 m AS (SELECT a.idx, a.role, coalesce(e.id, f.id) AS node, CASE WHEN e.id IS NOT NULL THEN 2 WHEN f.id IS NOT NULL THEN 1 ELSE 0 END AS how FROM asked a LEFT JOIN own e ON e.id = a.node LEFT JOIN first f ON f.name = a.name AND f.arch = a.arch),
 impact AS (SELECT p.idx, CASE p.idx % 3 WHEN 0 THEN 'upgrade' WHEN 1 THEN 'install' ELSE 'erase' END AS action, CASE max(how) WHEN 2 THEN 'exact' WHEN 1 THEN 'candidate' ELSE 'unmatched' END AS status, coalesce(string_agg(role, ',' ORDER BY role) FILTER (how > 0), '') AS roles,
   coalesce(string_agg(node, ',' ORDER BY node) FILTER (how > 0), '') AS nodes, coalesce(sum(o.n), 0)::BIGINT AS direct, coalesce(sum(o.affected), 0)::BIGINT AS affected FROM p JOIN m USING (idx) LEFT JOIN own o ON o.id = m.node GROUP BY p.idx)"""

SQL = {
    "license_histogram": LIC + " SELECT text, count(*) AS packages FROM r WHERE text IS NOT NULL GROUP BY text",
    "licensable": "SELECT concat('p', p_partkey) AS id FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 7 <> 0",
    "log_content": "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN props WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS content FROM events",
    "license_summary": LIC + " SELECT count(*) AS packages, count(text) AS licensed, count(*) FILTER (text IS NULL) AS missing, count(DISTINCT text) AS distinct_licenses, count(*) FILTER (denied) AS denied FROM r",
    "license_findings": LIC + " SELECT id, text FROM r WHERE denied",
    "repo_summary_arch": A + "SELECT arch, count(*) AS packages, count(DISTINCT name) AS names FROM artifacts GROUP BY arch",
    "top_source_rpms": A + "SELECT filename, count(*) AS n FROM artifacts WHERE arch = 'src' GROUP BY filename ORDER BY n DESC, filename LIMIT 20",
    "artifact_inventory": A + "SELECT CASE WHEN arch = 'src' THEN 'srpm' WHEN filename LIKE '%-debuginfo-%' THEN 'debug' WHEN arch = 'noarch' THEN 'noarch' ELSE 'binary' END AS kind, count(*) AS artifacts, count(DISTINCT name) AS names FROM artifacts GROUP BY 1",
    "inventory_by_arch": A + "SELECT arch, count(*) AS artifacts, row_number() OVER (ORDER BY coalesce(list_position(['x86_64', 'aarch64', 'ppc64le', 's390x', 'i686', 'noarch', 'src'], arch), 8), arch) AS position FROM artifacts GROUP BY arch",
    "build_step_totals": A + "SELECT concat('step-', task) AS step, round_even(sum(seconds), 6) AS total, round_even(max(seconds), 6) AS longest, count(*) AS tasks FROM artifacts GROUP BY 1",
    "critical_wall": A + "SELECT build, max(seconds) AS critical, sum(seconds) AS total FROM artifacts GROUP BY build",
    "log_signals": LOG + " SELECT user_id, day, len(list_filter(all_lines, lambda x: starts_with(x, 'error')))::INT AS error, 0 AS failed, 0 AS fatal, len(list_filter(all_lines, lambda x: starts_with(x, 'file')))::INT AS missing, len(list_filter(all_lines, lambda x: starts_with(x, 'warning')))::INT AS warning, lines FROM t",
    "log_sample": LOG + " SELECT user_id, day, left(array_to_string(CASE WHEN len(list_filter(all_lines, lambda x: NOT starts_with(x, 'ok'))) > 0 THEN list_filter(all_lines, lambda x: NOT starts_with(x, 'ok')) ELSE all_lines END[1:3], ' | '), 500) AS sample FROM t",
    "duplicate_names": with_("packages").rstrip() + ", v AS (SELECT name, version, string_agg(DISTINCT concat('node_modules/', name, '/', vid), '|' ORDER BY concat('node_modules/', name, '/', vid)) AS paths FROM packages GROUP BY 1, 2) SELECT name, count(*) AS versions, string_agg(concat(version, '@', paths), ',' ORDER BY version) AS list FROM v GROUP BY name HAVING count(*) > 1",
    "version_conflicts": A + "SELECT build, name, count(DISTINCT version) AS versions FROM artifacts GROUP BY build, name HAVING count(DISTINCT version) > 1",
    "triage_rollup": RPT + " SELECT kind, count(*) AS reports, sum(findings)::BIGINT AS findings, sum(failures)::BIGINT AS failures, max(largest) AS largest FROM r GROUP BY kind",
    "catalog_by_kind": """WITH f AS (SELECT p_type, p_brand, min(p_partkey) AS first FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
      SELECT p.p_type AS kind, count(*) AS bundles, sum(p_size)::BIGINT AS reports, max(p_size)::BIGINT AS most, (SELECT string_agg(p_brand, ',' ORDER BY first) FROM f WHERE f.p_type = p.p_type) AS codes FROM part p GROUP BY p.p_type""",
    "coverage_percent": "SELECT p_type AS kind, count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS public, round_even(100.0 * count(*) FILTER (p_size % 3 = 0) / count(*), 2)::DOUBLE AS percent FROM part GROUP BY 1",
    "diff_classification": CHANGES + " SELECT * FROM changes",
    "diff_top_findings": CHANGES + " SELECT * FROM changes ORDER BY list_position(['downgrade', 'replacement', 'upgrade', 'removed', 'added', 'metadataChange'], kind), name, coalesce(old, new) LIMIT 10",
    "diff_tree_summary": with_("pnodes", "pedges").rstrip() + ", " + _near("a", "src % 7 <> 6") + ", " + _near("b", "src % 5 <> 4") + """ SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'both' END AS change, count(*) AS nodes, coalesce(sum(a.d), 0)::BIGINT AS left_total, coalesce(sum(b.d), 0)::BIGINT AS right_total
      FROM (SELECT * FROM a WHERE d > 0) a FULL JOIN (SELECT * FROM b WHERE d > 0) b ON a.n = b.n GROUP BY 1""",
    "diff_policy": CHANGES + ", h AS (SELECT DISTINCT kind FROM changes WHERE kind IN ('downgrade', 'removed')) SELECT coalesce(string_agg(kind, ',' ORDER BY kind), '') AS violations, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS exit_code FROM h",
    "advisory_gate": with_("packages", "advisories").rstrip() + ", " + MATCHES + " SELECT count(*) FILTER (severity IN ('high', '9.8')) AS violations, CASE WHEN count(*) FILTER (severity IN ('high', '9.8')) > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN count(*) FILTER (severity IN ('high', '9.8')) > 0 THEN 2 ELSE 0 END AS exit_code FROM matches",
    "regressions": A + ", s AS (SELECT name, task % 2 AS k, count(*)::DOUBLE AS tasks, max(seconds) AS longest FROM artifacts GROUP BY 1, 2), b AS (SELECT l.name, l.tasks AS lt, r.tasks AS rt, l.longest AS ll, r.longest AS rl FROM s l JOIN s r ON l.name = r.name AND l.k = 1 AND r.k = 0) SELECT name, 'tasks' AS metric, lt AS before, rt AS after FROM b WHERE rt < lt UNION ALL SELECT name, 'longest', ll, rl FROM b WHERE rl > ll",
    "cnf_clause_counts": with_("packages") + "SELECT sum(n * (n - 1) / 2)::BIGINT AS at_most_one, count(*) AS names FROM (SELECT count(*) AS n FROM packages GROUP BY name)",
    "advisory_summary": with_("packages", "advisories", "pedges").rstrip() + ", " + MATCHES + """, r(s, n) AS (SELECT DISTINCT vid, vid FROM packages JOIN matches USING (id) UNION SELECT r.s, e.src FROM r JOIN pedges e ON e.dst = r.n)
      SELECT (SELECT count(*) FROM matches) AS findings, (SELECT count(DISTINCT id) FROM matches) AS packages, (SELECT count(DISTINCT advisory) FROM matches) AS advisories, (SELECT count(DISTINCT n) FROM r WHERE s <> n) AS affected_dependents""",
    "advisory_affected": with_("pnodes", "pedges").rstrip() + """, r(s, n) AS (SELECT vid, vid FROM pnodes WHERE id IN ('p3', 'p22', 'p40') UNION SELECT r.s, e.src FROM r JOIN pedges e ON e.dst = r.n) SELECT DISTINCT id AS package FROM r JOIN pnodes ON n = vid WHERE s <> n""",
    "release_completeness": COMPLETE + " SELECT * FROM items",
    "completeness_summary": COMPLETE + """ SELECT count(*) AS builds, count(*) FILTER (released) AS released, count(*) FILTER (n_missing > 0) AS with_missing, coalesce(sum(n_missing), 0)::BIGINT AS missing, coalesce(sum(failed), 0)::BIGINT AS failed, count(*) FILTER (unsigned) AS unsigned, count(*) FILTER (untested) AS untested FROM items""",
    "build_timing": A + """, s AS (SELECT build, task, CASE WHEN task % 5 > 0 THEN floor(seconds)::DOUBLE END AS wall FROM artifacts), t AS (SELECT build, count(*) AS n, coalesce(sum(wall), 0.0) AS total, coalesce(max(wall), 0.0) AS longest FROM s GROUP BY 1),
      g AS (SELECT build, count(*) AS n, coalesce(sum(wall), 0.0) AS total FROM s WHERE task % 2 = 0 GROUP BY 1), f AS (SELECT build, count(*) AS n FROM artifacts WHERE part % 2 = 0 GROUP BY 1)
      SELECT o_orderkey AS build, CASE WHEN o_orderkey % 7 > 0 THEN 60.0::DOUBLE END AS seconds, coalesce(t.n, 0) AS build_tasks, coalesce(t.total, 0.0)::DOUBLE AS build_seconds, coalesce(t.longest, 0.0)::DOUBLE AS build_longest, coalesce(g.n, 0) AS sign_tasks, coalesce(g.total, 0.0)::DOUBLE AS sign_seconds, coalesce(f.n, 0) AS artifacts
      FROM orders LEFT JOIN t ON t.build = o_orderkey LEFT JOIN g ON g.build = o_orderkey LEFT JOIN f ON f.build = o_orderkey""",
    "artifact_histograms": A + """, x AS (SELECT CASE WHEN part % 6 = 0 THEN 'unknown' ELSE 'rpm' END AS type, CASE WHEN part % 6 = 0 THEN 'non-rpm' ELSE arch END AS arch FROM artifacts)
      SELECT 0 AS build, 'type' AS "by", type AS value, count(*) AS artifacts FROM x GROUP BY type UNION ALL SELECT 0, 'arch', arch, count(*) FROM x GROUP BY arch""",
    "replacement_plan": PLAN + " SELECT * FROM plan",
    "plan_summary": PLAN + """ SELECT count(*) AS groups, count(*) FILTER (candidate) AS candidates, coalesce(sum(files) FILTER (candidate), 0)::BIGINT AS candidate_files, count(*) FILTER (NOT candidate) AS deferred,
      count(*) FILTER (priority = 'low') AS low, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'high') AS high FROM plan""",
    "plan_gate": PLAN + """ SELECT "group", priority, decision, rank FROM plan WHERE candidate AND priority = 'high'""",
    "coverage_gate": PLAN + """, c AS (SELECT round_even(100.0 * count(*) FILTER (p_size % 3 = 0) / count(*), 2)::DOUBLE AS percent FROM part), h AS (SELECT count(*)::DOUBLE AS n FROM plan WHERE priority IN ('high', 'medium'))
      SELECT 'publicEvidenceCoverageBelowThreshold' AS code, percent AS actual, 80.0::DOUBLE AS expected FROM c WHERE percent < 80 UNION ALL SELECT 'replacementPriorityMatched', n, 0.0 FROM h WHERE n > 0""",
    "license_gate": LIC + " SELECT count(*) FILTER (denied) AS violations, CASE WHEN count(*) FILTER (denied) > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN count(*) FILTER (denied) > 0 THEN 2 ELSE 0 END AS exit_code FROM r",
    "repository_summary": with_("pedges") + """SELECT count(*) AS packages, count(DISTINCT p_brand) FILTER (p_size % 5 > 0) AS source_rpms, count(DISTINCT p_size % 3) AS arches, (SELECT count(*) FROM pedges) + count(*) FILTER (p_size % 2 = 0) AS requirements, count(*) FILTER (p_size % 2 = 0) AS unresolved FROM part""",
    "unresolved_capabilities": "SELECT concat('p', p_partkey) AS package, p_type AS capability FROM part WHERE p_size % 2 = 0 ORDER BY 1, concat('rpm-capability:', p_type) LIMIT 100",
    "triage_counters": TRIAGE + " SELECT counter, (CASE WHEN counter LIKE 'performanceMax%' THEN max(value) ELSE sum(value) END)::BIGINT AS value FROM r GROUP BY counter",
    "triage_overall": TRIAGE + " SELECT CASE WHEN sum(value) FILTER (counter = 'npmUnresolvedDependencies') > 0 THEN 'warn' ELSE 'pass' END AS status FROM r",
    "triage_checks": TRIAGE + """ SELECT ord, CASE kind WHEN 'advisory.report' THEN 'advisory' WHEN 'license.report' THEN 'license' WHEN 'graph.diff' THEN 'graph-diff-policy' WHEN 'graph.diff_tree' THEN 'diff-tree-policy' WHEN 'real_data.coverage' THEN 'real-data-coverage-policy' ELSE 'bundle-catalog' END AS "check",
      CASE WHEN kind = 'bundle.catalog' AND value > 0 THEN 'warn' WHEN kind IN ('advisory.report', 'license.report', 'graph.diff', 'graph.diff_tree') AND value > 0 THEN 'fail' ELSE 'pass' END AS status FROM r WHERE kind NOT IN ('npm.diagnostics', 'performance.report', 'graph.snapshot')""",
    "triage_first_findings": TRIAGE + " SELECT kind AS category, ord, row_number() OVER (PARTITION BY kind ORDER BY ord) AS place FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ord) <= 10",
    "repo_top_findings": "WITH d AS (" + REPO_DIFF.replace("WITH RECURSIVE", "WITH", 1) + ") SELECT change, row_number() OVER (PARTITION BY change ORDER BY CASE WHEN change = 'changed' THEN len(string_split(fields, ',')) ELSE 0 END DESC, name, arch) AS rank, name, arch, fields FROM d QUALIFY row_number() OVER (PARTITION BY change ORDER BY CASE WHEN change = 'changed' THEN len(string_split(fields, ',')) ELSE 0 END DESC, name, arch) <= 10",
    "build_top_findings": "WITH d AS (" + BUILD_DIFF.replace("WITH RECURSIVE", "WITH", 1) + ") SELECT change, row_number() OVER (PARTITION BY change ORDER BY CASE WHEN change = 'changed' THEN len(string_split(fields, ',')) ELSE 0 END DESC, name, arch, build_arch) AS rank, kind, name, arch, build_arch, fields FROM d QUALIFY row_number() OVER (PARTITION BY change ORDER BY CASE WHEN change = 'changed' THEN len(string_split(fields, ',')) ELSE 0 END DESC, name, arch, build_arch) <= 10",
    "diff_nearest_findings": CHANGES + """ SELECT * FROM changes ORDER BY list_position(['downgrade', 'replacement', 'upgrade', 'removed', 'added', 'metadataChange'], kind), CASE WHEN length(name) % 4 = 0 THEN length(name) - 2 WHEN length(name) % 3 = 0 THEN length(name) ELSE 1000000 END, name, coalesce(old, new) LIMIT 10""",
    "diff_kind_counts": CHANGES + " SELECT kind, count(*) AS changes FROM changes GROUP BY kind",
    "catalog_status": """SELECT count(*) AS bundles, count(*) FILTER (p_size % 50 > 0) AS ok_bundles, count(*) FILTER (p_size % 50 = 0) AS failed_bundles, sum(p_size)::BIGINT AS reports, 0::BIGINT AS failures, count(*) FILTER (p_size = 1) AS "graphDiffPolicyFailures", count(*) FILTER (p_partkey % 3 = 0) AS triage_pass, count(*) FILTER (p_partkey % 3 = 1) AS triage_warn,
      0::BIGINT AS triage_fail, count(*) FILTER (p_partkey % 3 = 2) AS without_triage, CASE WHEN count(*) FILTER (p_size % 50 = 0 OR p_size = 1) > 0 THEN 'fail' WHEN count(*) FILTER (p_partkey % 3 = 1) > 0 THEN 'warn' ELSE 'pass' END AS status FROM part""",
    "timing_deltas": A + """, s AS (SELECT task % 2 AS k, max(seconds) AS critical, sum(seconds) AS total FROM artifacts GROUP BY 1), m AS (SELECT 'critical' AS metric, l.critical AS before, r.critical AS after FROM s l, s r WHERE l.k = 0 AND r.k = 1 UNION ALL SELECT 'total', l.total, r.total FROM s l, s r WHERE l.k = 0 AND r.k = 1)
      SELECT metric, before, after, round_even(after - before, 6) AS delta FROM m WHERE after <> before""",
    "commit_findings": """WITH l AS (SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS before FROM part WHERE p_partkey % 2 = 0 AND p_size > 3 AND p_brand <> 'Brand#1'), r AS (SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS after FROM part WHERE p_partkey % 2 = 1 AND p_size > 4) SELECT * FROM l, r WHERE before <> after""",
    "feed_summary": with_("advisories") + "SELECT count(*) AS advisories, count(DISTINCT package) AS packages, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM advisories",
    "transaction_impact": TRANSACTION + " SELECT * FROM impact",
    "transaction_summary": TRANSACTION + """ SELECT count(*) AS actions, count(*) FILTER (action = 'install') AS installs, count(*) FILTER (action = 'erase') AS erases, count(*) FILTER (action = 'upgrade') AS upgrades, count(*) FILTER (status <> 'unmatched') AS matched, count(*) FILTER (affected > 0) AS impacted, count(*) FILTER (status = 'exact') AS exact,
      count(*) FILTER (status = 'candidate') AS candidates, count(*) FILTER (status = 'unmatched') AS unmatched, sum(affected)::BIGINT AS affected, max(affected) AS most_affected FROM impact""",
    "transaction_arches": "SELECT CASE WHEN p_size % 2 = 0 THEN 'x86_64' ELSE 'noarch' END AS arch, count(*) AS actions FROM part GROUP BY 1",
    "diff_tree_paths": with_("pnodes", "pedges").rstrip() + ", " + _near_paths("a", "src % 7 <> 6") + ", " + _near_paths("b", "src % 5 <> 4") + """ SELECT concat('p', coalesce(a.n, b.n)) AS package, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'both' END AS change, a.d AS left_distance, b.d AS right_distance,
      array_to_string(list_transform(a.p, lambda x: 'p' || x), '>') AS left_path, array_to_string(list_transform(b.p, lambda x: 'p' || x), '>') AS right_path FROM (SELECT * FROM a WHERE d > 0) a FULL JOIN (SELECT * FROM b WHERE d > 0) b ON a.n = b.n""",
    "diff_tree_edges": with_("pnodes", "pedges").rstrip() + ", " + _near("a", "src % 7 <> 6") + ", " + _near("b", "src % 5 <> 4") + """, x AS (SELECT src, dst FROM pedges JOIN a ON n = src AND d < 3 WHERE src % 7 <> 6), y AS (SELECT src, dst FROM pedges JOIN b ON n = src AND d < 3 WHERE src % 5 <> 4),
      z AS (SELECT (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS added, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS removed, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS both) SELECT *, added + removed AS churn, added - removed AS delta FROM z""",
}
