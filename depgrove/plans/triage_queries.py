"""Registered queries for the triage of mixed reports: each event is a report in JSON, of one of fourteen kinds or none."""

from __future__ import annotations

from ..operators import diff as D
from ..operators import triage as T
from .derive import table

#: The kinds by event_id % 15 (the last is none), each with its JSON behind the schema; n is event_id % 5, m is event_id % 7.
REPORTS = {
    "graph.snapshot": """ '"stats":{"nodes":' || n || ',"edges":' || m || '}' """,
    "impact.report": """ '"summary":{"nodes":' || n || '}' """,
    "advisory.report": """ '"summary":{"findings":' || n % 2 || '},"findings":[' || CASE WHEN n % 2 = 1 THEN '{"advisory":{"id":"A-' || id || '","severity":"high"},"package":"p' || m || '"}' ELSE '' END || ']' """,
    "license.report": """ '"summary":{"deniedFindings":' || n || ',"missingLicenses":' || m || '},"findings":[7,{"package":"p' || id || '","license":null}]' """,
    "npm.diagnostics": """ '"root":"r' || m || '","summary":{"duplicatePackageNames":' || n || ',"nestedResolutionConflicts":0,"unresolvedDependencies":' || m || '}' """,
    "graph.diff": """ '"leftRoot":"l","rightRoot":"r' || id || '","summary":{"policyFailures":9}' || CASE WHEN m > 2 THEN ',"policy":{"status":"' || CASE WHEN n = 0 THEN 'fail' ELSE 'pass' END || '","matchedKinds":["k' || n || '"],"exitCode":' || m || '}' ELSE '' END """,
    "graph.diff_tree": """ '"depth":' || m || ',"summary":{"nodeChurn":' || n || ',"edgeChurn":null,"nodeDelta":-' || m || '},"policy":{"status":"' || CASE WHEN n = 1 THEN 'fail' ELSE 'pass' END || '"}' """,
    "real_data.coverage": """ '"summary":{},"policy":{"status":"' || CASE WHEN n = 2 THEN 'fail' ELSE 'pass' END || '","failOnPriority":"high","matchedReplacementGroups":' || m || '}' """,
    "real_data.coverage_diff": """ '"summary":{},"policy":{"status":"fail","failOnRegression":true,"failures":["f' || id || '"],"exitCode":2}' """,
    "real_data.replacement_plan": """ '"stats":{"policyFailures":' || n || '},"policy":[]' """,
    "real_data.replacement_plan_diff": """ '"summary":{},"policy":{"failOnRegression":false}' """,
    "bundle.catalog": """ '"summary":{"bundles":' || m || ',"failures":' || CASE WHEN n = 0 THEN 1 ELSE 0 END || ',"triageWarn":' || n || ',"performanceMaxNodes":' || id || '},"bundles":[{"path":"b' || id || '","ok":true},{"path":"w' || id || '","ok":true,"triageStatus":"warn"}]' """,
    "performance.report": """ '"summary":{"scenarios":' || n || ',"maxNodes":' || id || ',"allContiguous":' || CASE WHEN m = 0 THEN 'true' ELSE 'false' END || '}' """,
    "parallel.query.report": """ '"summary":{"queries":2,"memoryMapped":true},"results":[{"count":' || n || ',"resultKind":"path"},{"count":' || m || '},3]' """,
}
KIND = "CASE event_id % 15 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(REPORTS)) + " ELSE '' END"
TEXT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{{\"schema\":\"x.{k}.v1\",' || {body.strip()} || '}}'" for k, body in REPORTS.items()) + " ELSE 'none' END"


def _reports(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id AS id", "event_id % 5 AS n", "event_id % 7 AS m", f"{KIND} AS kind")
    return T.parsed(rows.selectExpr("id AS ord", f"{TEXT} AS text"))


QUERIES = {
    "report_counters": lambda s, d: T.rollup(_reports(s, d)),
    "report_status": lambda s, d: D.triage_status(T.rollup(_reports(s, d))),
    "report_checks": lambda s, d: T.checks(_reports(s, d)),
    "report_findings": lambda s, d: T.findings(_reports(s, d)).select("category", "place", "finding"),
}

E = f"WITH e AS (SELECT event_id AS id, event_id % 5 AS n, event_id % 7 AS m, {KIND} AS kind FROM events)"
#: What each kind adds to the counters.
ADDED = {
    "graph.snapshot": {"graphSnapshots": "1", "nodes": "n", "edges": "m"},
    "impact.report": {"impactReports": "1"},
    "advisory.report": {"advisoryReports": "1", "advisoryFindings": "n % 2", "failedChecks": "n % 2"},
    "license.report": {"licenseReports": "1", "deniedLicenseFindings": "n", "missingLicenses": "m", "failedChecks": "(n > 0)::INT"},
    "npm.diagnostics": {"npmDiagnosticsReports": "1", "npmDuplicatePackageNames": "n", "npmNestedResolutionConflicts": "0", "npmUnresolvedDependencies": "m"},
    "graph.diff": {"graphDiffReports": "1", "graphDiffPolicyFailures": "(m > 2 AND n = 0)::INT", "failedChecks": "(m > 2 AND n = 0)::INT"},
    "graph.diff_tree": {"diffTreeReports": "1", "diffTreePolicyFailures": "(n = 1)::INT", "failedChecks": "(n = 1)::INT", "diffTreeNodeChurn": "n", "diffTreeEdgeChurn": "0", "diffTreeNetNodeDelta": "-m", "diffTreeNetEdgeDelta": "0"},
    "real_data.coverage": {"realDataCoverageReports": "1", "realDataCoveragePolicyFailures": "(n = 2)::INT", "failedChecks": "(n = 2)::INT"},
    "real_data.coverage_diff": {"realDataCoverageDiffReports": "1", "realDataCoverageDiffPolicyFailures": "1", "failedChecks": "1"},
    "real_data.replacement_plan": {"realDataReplacementPlanReports": "1", "realDataReplacementPlanPolicyFailures": "n"},
    "real_data.replacement_plan_diff": {"realDataReplacementPlanDiffReports": "1", "realDataReplacementPlanDiffPolicyFailures": "0"},
    "bundle.catalog": {"bundleCatalogReports": "1", "catalogBundles": "m", "catalogFailedBundles": "0", "catalogFailures": "(n = 0)::INT", "failedChecks": "(n = 0)::INT", "catalogTriageWarn": "n", "catalogTriageFail": "0"} | {c: "0" for c in T.POLICIES + T.CHURN + T.PARALLEL + T.PERFORMANCE} | {"performanceMaxNodes": "id"},
    "performance.report": {"performanceReports": "1", "performanceScenarios": "n", "performanceMaxNodes": "id", "performanceMaxEdges": "0", "performanceContiguousReports": "(m = 0)::INT"},
    "parallel.query.report": {"parallelQueryReports": "1", "parallelQueryQueries": "2", "parallelQueryNodeQueries": "0", "parallelQueryPathQueries": "0", "parallelQueryResultNodes": "n + m", "parallelQueryPathResultNodes": "n", "parallelQueryMemoryMappedReports": "1"},
}
ROLLUP = (
    E + ", added AS (SELECT 'reports' AS counter, 1 AS value FROM e"
    + "".join(f" UNION ALL SELECT '{c}', {v} FROM e WHERE kind = '{k}'" for k, of in ADDED.items() for c, v in of.items())
    + "), rollup AS (SELECT counter, (CASE WHEN counter LIKE 'performanceMax%' THEN max(value) ELSE sum(value) END)::BIGINT AS value FROM added GROUP BY counter)"
)
FIRST = " QUALIFY row_number() OVER (PARTITION BY category ORDER BY ord, pos) <= 10"
ZEROS = ",".join(f'"{f}":0' for f in T.BUNDLE[6:23])
EMPTY = ",".join(f'"{f}":[]' for f in T.BUNDLE[23:])
SQL = {
    "report_counters": ROLLUP + " SELECT * FROM rollup",
    "report_status": ROLLUP + " SELECT CASE WHEN count(*) FILTER (value <> 0 AND (counter LIKE '%PolicyFailures' OR counter IN ('advisoryFindings', 'deniedLicenseFindings', 'catalogFailedBundles', 'catalogFailures', 'catalogTriageFail'))) > 0 THEN 'fail' WHEN count(*) FILTER (value <> 0 AND (counter LIKE 'npm%s' AND counter <> 'npmDiagnosticsReports' OR counter IN ('missingLicenses', 'catalogTriageWarn'))) > 0 THEN 'warn' ELSE 'pass' END AS status FROM rollup",
    "report_checks": E + """ SELECT id AS ord, 'advisory' AS "check", CASE WHEN n % 2 > 0 THEN 'fail' ELSE 'pass' END AS status, '{"findings":' || n % 2 || '}' AS detail FROM e WHERE kind = 'advisory.report'
      UNION ALL SELECT id, 'license', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END, '{"deniedFindings":' || n || '}' FROM e WHERE kind = 'license.report'
      UNION ALL SELECT id, 'graph-diff-policy', CASE WHEN n = 0 THEN 'fail' ELSE 'pass' END, '{"failOnChange":[],"matchedChanges":[],"failOnKind":[],"matchedKinds":["k' || n || '"],"exitCode":' || m || '}' FROM e WHERE kind = 'graph.diff' AND m > 2
      UNION ALL SELECT id, 'diff-tree-policy', CASE WHEN n = 1 THEN 'fail' ELSE 'pass' END, '{"failOnKind":[],"matchedKinds":[],"exitCode":0}' FROM e WHERE kind = 'graph.diff_tree'
      UNION ALL SELECT id, 'real-data-coverage-policy', CASE WHEN n = 2 THEN 'fail' ELSE 'pass' END, '{"minPublicEvidenceCoveragePercent":null,"failOnPriority":"high","matchedReplacementGroups":' || m || ',"exitCode":0}' FROM e WHERE kind = 'real_data.coverage'
      UNION ALL SELECT id, 'real-data-coverage-diff-policy', 'fail', '{"failOnRegression":true,"exitCode":2}' FROM e WHERE kind = 'real_data.coverage_diff'
      UNION ALL SELECT id, 'real-data-replacement-plan-diff-policy', 'pass', '{"failOnRegression":false,"exitCode":0}' FROM e WHERE kind = 'real_data.replacement_plan_diff'
      UNION ALL SELECT id, 'bundle-catalog', CASE WHEN n = 0 THEN 'fail' ELSE 'warn' END, '{"failedBundles":0,"failures":' || (n = 0)::INT || ',""" + ",".join(f'"{c}":0' for c in T.POLICIES) + ""","triageWarn":' || n || ',"triageFail":0}' FROM e WHERE kind = 'bundle.catalog'""",
    "report_findings": E + """, f AS (SELECT 'advisories' AS category, id AS ord, 0 AS pos, '{"id":"A-' || id || '","severity":"high","package":"p' || m || '","summary":null}' AS finding FROM e WHERE kind = 'advisory.report' AND n % 2 = 1
      UNION ALL SELECT 'licenses', id, 0, '{"package":"p' || id || '","license":null,"matchedDeniedLicenses":[]}' FROM e WHERE kind = 'license.report'
      UNION ALL SELECT 'npm', id, 0, '{"kind":"duplicatePackageNames","count":' || n || ',"root":"r' || m || '"}' FROM e WHERE kind = 'npm.diagnostics' AND n > 0
      UNION ALL SELECT 'npm', id, 1, '{"kind":"unresolvedDependencies","count":' || m || ',"root":"r' || m || '"}' FROM e WHERE kind = 'npm.diagnostics' AND m > 0
      UNION ALL SELECT 'bundleCatalog', id, 0, '{"path":"w' || id || '","sourceKind":null,"ok":true,"failureCount":null,"failureCodes":[],"triageStatus":"warn",""" + ZEROS + "," + EMPTY + """}' FROM e WHERE kind = 'bundle.catalog'
      UNION ALL SELECT 'graphDiffPolicies', id, 0, '{"leftRoot":"l","rightRoot":"r' || id || '","failOnChange":[],"matchedChanges":[],"failOnKind":[],"matchedKinds":["k0"],"exitCode":' || m || '}' FROM e WHERE kind = 'graph.diff' AND m > 2 AND n = 0
      UNION ALL SELECT 'diffTreePolicies', id, 0, '{"selector":null,"direction":null,"depth":' || m || ',"failOnKind":[],"matchedKinds":[],"exitCode":0}' FROM e WHERE kind = 'graph.diff_tree' AND n = 1
      UNION ALL SELECT 'realDataCoverage', id, 0, '{"fixtureRoot":null,"minPublicEvidenceCoveragePercent":null,"failOnPriority":"high","matchedReplacementGroups":' || m || ',"failures":[],"exitCode":0}' FROM e WHERE kind = 'real_data.coverage' AND n = 2
      UNION ALL SELECT 'realDataCoverageDiff', id, 0, '{"left":null,"right":null,"failOnRegression":true,"failures":["f' || id || '"],"exitCode":2}' FROM e WHERE kind = 'real_data.coverage_diff')
      SELECT category, row_number() OVER (PARTITION BY category ORDER BY ord, pos) AS place, finding FROM f""" + FIRST,
}
