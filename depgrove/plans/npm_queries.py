"""Registered queries for npm findings, timing steps and group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import npm
from ..operators import reports as R
from .derive import table

C = F.col
PUBLIC = ("example.com", "www.example.net")


def _nodes(spark, sf):
    """The pages as npm packages that were fetched from their addresses, and some of another kind."""
    p, key = table(spark, sf, "pages"), C("page_id")
    on = lambda c: F.when(c, "True")
    meta = {
        "ecosystem": F.when(key % 17 == 0, "pypi").otherwise("npm"), "node_type": F.when(key % 29 == 0, "root").otherwise("package"), "name": F.concat(F.when(key % 4 == 0, "@s/").otherwise(""), F.element_at(F.array(*map(F.lit, ("lodas", "reactt", "pkg", "Vite", "nxt"))), (key % 5 + 1).cast("int"))),
        "resolved": C("url"), "remote_tarball_url": on(npm.domain(C("url")).isNotNull()), "remote_tarball_domain": npm.domain(C("url")), "integrity": F.when(key % 3 == 0, "sha"), "classification": F.when(key % 6 == 0, "direct").otherwise("transitive"),
        "dependency_scope": F.when(key % 7 == 0, "dev").when(key % 7 == 1, "optional").otherwise("runtime"), "optional": on(key % 14 == 3), "git_dependency": on(key % 11 == 0), "local_file_dependency": on(key % 13 == 0),
        "lifecycle_scripts": F.when(key % 19 == 0, "install,test"), "has_install_script": on(key % 23 == 0), "peer_dependencies": F.when(key % 10 == 0, "a,b"),
    }
    full = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))])
    return p.select(F.concat(F.lit("n"), key.cast("string"), F.lit("=="), key.cast("string")).alias("id"), F.map_filter(full, lambda k, v: v.isNotNull()).alias("meta"))


def _edges(spark, sf):
    key = C("page_id")
    id_ = lambda k: F.concat(F.lit("n"), k.cast("string"), F.lit("=="), k.cast("string"))
    return table(spark, sf, "pages").select(id_(key).alias("src"), id_(F.pmod(key * 3 + 1, F.lit(200))).alias("dst"), F.when(key % 8 == 0, "peer").otherwise("runtime").alias("scope"))


def _packages(spark, sf):
    return table(spark, sf, "pages").select(F.concat(F.lit("n"), C("page_id").cast("string")).alias("id"), F.when(C("page_id") % 4 == 0, "@s/x").otherwise("x").alias("name"), C("url").alias("resolved"), npm.domain(C("url")).alias("domain"))


def _peers(spark, sf):
    p = table(spark, sf, "part")
    edges = p.select(C("p_partkey").cast("string").alias("src"), C("p_brand").alias("dst_name"), F.when(C("p_size") % 2 == 0, "peer").otherwise("runtime").alias("scope"))
    return npm.peer_warnings(edges, p.where("p_partkey % 3 = 0").select(C("p_partkey").cast("string").alias("id"), F.concat("p_brand", F.lit(",other")).alias("peers")))


def _conflicts(spark, sf):
    return npm.conflicts(table(spark, sf, "part").select(C("p_brand").alias("dependency"), F.concat(F.lit("x=="), (C("p_size") % 4).cast("string")).alias("resolved")))


def _steps(spark, sf):
    e = table(spark, sf, "events")
    k = (F.get_json_object("props", "$.k").cast("int") % 60).cast("string")
    text = F.concat(F.lit('{"'), "event_type", F.lit('": {"inner": {"delta": "0:00:'), F.lpad(k, 2, "0"), F.lit('.5"}, "other": {"note": 1}}, "total": {"delta": "'), k, F.lit('"}}'))
    return npm.flat_steps(e.select(C("event_id").alias("key"), text.alias("json")))


def _halves(spark, sf):
    p = table(spark, sf, "part")
    side = lambda k: R.coverage(p.where(C("p_partkey") % 2 == k).select(C("p_brand").alias("kind"), (C("p_size") % 3 == 0).alias("public")))
    return J.keyed_diff(side(0), side(1), ["kind"], ["total", "public"], "kind")


QUERIES = {
    "resolved_domains": lambda s, d: npm.domains(_packages(s, d)),
    "confusion_indicators": lambda s, d: npm.confusable(_packages(s, d), PUBLIC),
    "vulnerable_surface": lambda s, d: npm.surface(_nodes(s, d), PUBLIC).select("finding", "id"),
    "npm_summary": lambda s, d: npm.summary(_nodes(s, d), _edges(s, d), PUBLIC),
    "resolution_conflicts": _conflicts,
    "peer_warnings": _peers,
    "json_values": lambda s, d: table(s, d, "events").select("event_id", npm.json_value(F.when(C("event_id") % 5 == 0, "[ ]").otherwise(F.concat(F.lit('{"z": [1, null, "a b"], "props": '), "props", F.lit(', "A": {}}')))).alias("value")),
    "timing_steps": lambda s, d: R.step_totals(_steps(s, d)),
    "coverage_diff": _halves,
    "plan_enrichment": lambda s, d: table(s, d, "nation").select(C("n_name").alias("name"), "n_nationkey").join(table(s, d, "supplier").groupBy(C("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files")), "n_nationkey", "left").select("name", F.coalesce("files", F.lit(0)).alias("files")),
}

DOMAIN = "nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '')"
PK = f"WITH p AS (SELECT concat('n', page_id) AS id, page_id % 4 = 0 AS scoped, {DOMAIN} AS domain FROM pages)"
NODES = f"""WITH a AS (SELECT page_id AS k, {DOMAIN} AS domain, CASE WHEN page_id % 7 = 0 THEN 'dev' WHEN page_id % 7 = 1 THEN 'optional' ELSE 'runtime' END AS scope, page_id % 17 <> 0 AS npm FROM pages), n AS (SELECT * FROM a WHERE npm AND k % 29 <> 0),
 e AS (SELECT page_id AS src, (page_id * 3 + 1) % 200 AS dst, page_id % 8 = 0 AS peer FROM pages), ne AS (SELECT * FROM e WHERE src IN (SELECT k FROM a WHERE npm) OR dst IN (SELECT k FROM a WHERE npm))"""
TESTS = {
    "packagesWithoutIntegrity": "k % 3 <> 0 AND k % 13 <> 0", "gitBasedDependencies": "k % 11 = 0", "localFileDependencies": "k % 13 = 0", "lifecycleScriptPackages": "k % 19 = 0", "installScriptPackages": "k % 23 = 0",
    "dependencyConfusionRiskIndicators": "k % 4 <> 0 AND domain IN ('example.com', 'www.example.net')", "typosquattingFriendlyNames": "k % 4 <> 0 AND k % 5 IN (0, 1, 4)",
}
COUNTS = TESTS | {
    "directDependencies": "k % 6 = 0", "transitiveDependencies": "k % 6 <> 0", "packagesWithRemoteTarballUrls": "domain IS NOT NULL", "devOnlyPackages": "scope = 'dev'", "optionalPackages": "scope = 'optional' OR k % 14 = 3",
}

SQL = {
    "resolved_domains": PK + " SELECT domain, count(*) AS packages FROM p WHERE domain IS NOT NULL GROUP BY domain",
    "confusion_indicators": PK + " SELECT id, domain FROM p WHERE NOT scoped AND domain IN ('example.com', 'www.example.net')",
    "vulnerable_surface": NODES + " " + " UNION ALL ".join(f"SELECT '{k}' AS finding, concat('n', k, '==', k) AS id FROM n WHERE {t}" for k, t in TESTS.items()),
    "npm_summary": NODES + " SELECT count(*) AS packages, " + ", ".join(f'count(*) FILTER ({t}) AS "{k}"' for k, t in COUNTS.items()) + """, (SELECT count(*) FROM ne) AS dependencies,
      2 * count(*) FILTER (k % 10 = 0) + (SELECT count(*) FROM ne WHERE peer) AS "peerDependencyWarnings" FROM n""",
    "resolution_conflicts": "SELECT p_brand AS dependency, string_agg(DISTINCT p_size % 4, ',' ORDER BY p_size % 4) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 4) > 1",
    "peer_warnings": """SELECT p_partkey::VARCHAR AS src, p_brand AS peer, 'edge' AS "from" FROM part WHERE p_size % 2 = 0
      UNION ALL SELECT p_partkey::VARCHAR, unnest([p_brand, 'other']), 'declared' FROM part WHERE p_partkey % 3 = 0""",
    "json_values": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('{"A":{},"props":{"k":', json_extract_string(props, '$.k'), '},"z":[1,null,"a b"]}') END AS value FROM events""",
    "timing_steps": """WITH k AS (SELECT event_type, json_extract_string(props, '$.k')::INT % 60 AS k FROM events),
      s AS (SELECT concat(event_type, '.inner') AS step, k + 0.5::DOUBLE AS seconds FROM k UNION ALL SELECT 'total', k::DOUBLE FROM k)
      SELECT step, round_even(sum(seconds), 6) AS total, round_even(max(seconds), 6) AS longest, count(*) AS tasks FROM s GROUP BY step""",
    "coverage_diff": """WITH s AS (SELECT p_brand AS kind, p_partkey % 2 AS k, count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS public FROM part GROUP BY 1, 2)
      SELECT coalesce(l.kind, r.kind) AS kind, CASE WHEN l.kind IS NULL THEN 'added' WHEN r.kind IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN l.kind IS NULL OR r.kind IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.total <> r.total THEN 'total' END, CASE WHEN l.public <> r.public THEN 'public' END) END AS fields
      FROM (SELECT * FROM s WHERE k = 0) l FULL JOIN (SELECT * FROM s WHERE k = 1) r ON l.kind = r.kind WHERE l.kind IS NULL OR r.kind IS NULL OR l.total <> r.total OR l.public <> r.public""",
    "plan_enrichment": "SELECT n_name AS name, count(s_suppkey) AS files FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
}
