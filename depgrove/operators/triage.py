"""Triage of mixed reports: each report's JSON, of whatever kind, becomes its share of the counters, its check and its findings.

A report is parsed once, as a variant, and told by the middle of its schema (what stands between the first part and the version). All
counters are one aggregation, so a partition sends one row; findings are cut to the first of each category before they are shuffled. Defined results: a text that is no JSON object is a report of no kind; what is missing, null or no number counts as 0; a
report with neither summary nor stats has zeros; an empty table gives the counters that are always there, at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col

# The counter of each kind's reports, and the counters filled from its summary with the field's name there.
POLICIES = ("graphDiffPolicyFailures", "diffTreePolicyFailures", "realDataCoveragePolicyFailures", "realDataCoverageDiffPolicyFailures", "realDataReplacementPlanPolicyFailures", "realDataReplacementPlanDiffPolicyFailures")
CHURN = ("diffTreeNodeChurn", "diffTreeEdgeChurn", "diffTreeNetNodeDelta", "diffTreeNetEdgeDelta")
PARALLEL = ("parallelQueryReports", "parallelQueryQueries", "parallelQueryNodeQueries", "parallelQueryPathQueries", "parallelQueryResultNodes", "parallelQueryPathResultNodes", "parallelQueryMemoryMappedReports")
PERFORMANCE = ("performanceReports", "performanceScenarios", "performanceMaxNodes", "performanceMaxEdges", "performanceContiguousReports")
COUNTERS = {
    "graph.snapshot": ("graphSnapshots", {"nodes": "nodes", "edges": "edges"}),
    "impact.report": ("impactReports", {}),
    "advisory.report": ("advisoryReports", {"advisoryFindings": "findings"}),
    "license.report": ("licenseReports", {"deniedLicenseFindings": "deniedFindings", "missingLicenses": "missingLicenses"}),
    "npm.diagnostics": ("npmDiagnosticsReports", {"npmDuplicatePackageNames": "duplicatePackageNames", "npmNestedResolutionConflicts": "nestedResolutionConflicts", "npmUnresolvedDependencies": "unresolvedDependencies"}),
    "graph.diff": ("graphDiffReports", {"graphDiffPolicyFailures": "policyFailures"}),
    "graph.diff_tree": ("diffTreeReports", {"diffTreePolicyFailures": "policyFailures", "diffTreeNodeChurn": "nodeChurn", "diffTreeEdgeChurn": "edgeChurn", "diffTreeNetNodeDelta": "nodeDelta", "diffTreeNetEdgeDelta": "edgeDelta"}),
    "real_data.coverage": ("realDataCoverageReports", {"realDataCoveragePolicyFailures": "policyFailures"}),
    "real_data.coverage_diff": ("realDataCoverageDiffReports", {"realDataCoverageDiffPolicyFailures": "policyFailures"}),
    "real_data.replacement_plan": ("realDataReplacementPlanReports", {"realDataReplacementPlanPolicyFailures": "policyFailures"}),
    "real_data.replacement_plan_diff": ("realDataReplacementPlanDiffReports", {"realDataReplacementPlanDiffPolicyFailures": "policyFailures"}),
    "bundle.catalog": ("bundleCatalogReports", {"catalogBundles": "bundles", "catalogFailedBundles": "failedBundles", "catalogFailures": "failures", "catalogTriageWarn": "triageWarn", "catalogTriageFail": "triageFail"} | {c: c for c in POLICIES + CHURN + PARALLEL + PERFORMANCE}),
    "performance.report": ("performanceReports", {"performanceScenarios": "scenarios", "performanceMaxNodes": "maxNodes", "performanceMaxEdges": "maxEdges"}),
    "parallel.query.report": ("parallelQueryReports", {"parallelQueryQueries": "queries", "parallelQueryNodeQueries": "nodeQueries", "parallelQueryPathQueries": "pathQueries"}),
}
#: The kinds whose counters are there at 0 when no such report is.
ALWAYS = ("graph.snapshot", "impact.report", "advisory.report", "license.report", "npm.diagnostics", "graph.diff", "graph.diff_tree")
ALWAYS_CATALOG = ("bundleCatalogReports", "catalogBundles", "catalogFailedBundles", "catalogFailures", "catalogTriageWarn", "catalogTriageFail")
#: For each kind with a policy its check, its category of findings, what a finding names of the report, and the policy's fields.
POLICY = {
    "graph.diff": ("graph-diff-policy", "graphDiffPolicies", ("leftRoot", "rightRoot"), ("failOnChange", "matchedChanges", "failOnKind", "matchedKinds"), False),
    "graph.diff_tree": ("diff-tree-policy", "diffTreePolicies", ("selector", "direction", "depth"), ("failOnKind", "matchedKinds"), False),
    "real_data.coverage": ("real-data-coverage-policy", "realDataCoverage", ("fixtureRoot",), ("minPublicEvidenceCoveragePercent", "failOnPriority", "matchedReplacementGroups"), True),
    "real_data.coverage_diff": ("real-data-coverage-diff-policy", "realDataCoverageDiff", ("left", "right"), ("failOnRegression",), True),
    "real_data.replacement_plan": ("real-data-replacement-plan-policy", "realDataReplacementPlan", ("fixtureRoot",), ("failOnPriority", "matchedReplacementGroups"), True),
    "real_data.replacement_plan_diff": ("real-data-replacement-plan-diff-policy", "realDataReplacementPlanDiff", ("left", "right"), ("failOnRegression",), True),
}
LISTS = ("failOnChange", "matchedChanges", "failOnKind", "matchedKinds", "failureCodes", "realDataCoverageFailureCodes", "realDataCoverageDiffFailureCodes", "realDataReplacementPlanFailureCodes", "realDataReplacementPlanDiffFailureCodes", "graphDiffFailOnChanges", "graphDiffMatchedChanges", "graphDiffFailOnKinds", "graphDiffMatchedKinds", "diffTreeFailOnKinds", "diffTreeMatchedKinds")
BUNDLE = ("path", "sourceKind", "ok", "failureCount", "failureCodes", "triageStatus", *POLICIES[:2], *CHURN, *PARALLEL, *POLICIES[2:], *LISTS[5:])
NPM = ("duplicatePackageNames", "nestedResolutionConflicts", "unresolvedDependencies")


def _number(value: Column | str, field: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "long"), F.lit(0).cast("long"))


def _flag(value: Column | str, field: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "boolean"), F.lit(False))


def _strings(value: Column | str, field: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "array<string>"), F.array().cast("array<string>"))


def _any(value: Column | str, field: str, default: str | None = None) -> Column:
    found = F.try_variant_get(value, f"$.{field}", "variant")
    return found if default is None else F.coalesce(found, F.parse_json(F.lit(default)))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")), F.lit(False))


def _objects(value: Column | str, field: str) -> Column:
    return F.filter(F.coalesce(F.try_variant_get(value, f"$.{field}", "array<variant>"), F.array().cast("array<variant>")), _is_object)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _by_kind(branches: dict[str, Column]) -> Column:
    """Each kind's own value; null for other kinds."""
    found = F
    for kind, value in branches.items():
        found = found.when(C("kind") == kind, value)
    return found


def parsed(texts: DataFrame) -> DataFrame:
    """texts: ord, text (a report's JSON). ord, kind, report, body (its summary, else its stats), policy (null if it is no object), has_summary."""
    rows = texts.select("ord", F.try_parse_json("text").alias("report"))
    rows = rows.select(
        "ord", "report", F.regexp_extract(F.coalesce(F.try_variant_get("report", "$.schema", "string"), F.lit("")), r"^[^.]+\.(.+)\.v1$", 1).alias("kind"),
        *[F.try_variant_get("report", f"$.{f}", "variant").alias(f) for f in ("summary", "stats", "policy")],
    )
    given = _is_object(C("summary"))
    body = F.when(given, C("summary")).when(_is_object(C("stats")), C("stats"))
    return rows.select("ord", "kind", "report", body.alias("body"), F.when(_is_object(C("policy")), C("policy")).alias("policy"), given.alias("has_summary"))


def _failing() -> Column:
    return F.coalesce(F.try_variant_get("policy", "$.status", "string") == "fail", F.lit(False))


def _status() -> Column:
    """The status of a report's check; null if it has none."""
    n = lambda f: _number("body", f)
    any_of = lambda *fields: F.greatest(*[n(f) for f in fields], F.lit(0)) > 0
    found = {
        "advisory.report": F.when(n("findings") != 0, "fail").otherwise("pass"),
        "license.report": F.when(n("deniedFindings") != 0, "fail").otherwise("pass"),
        "bundle.catalog": F.when(any_of("failedBundles", "failures", "triageFail", *POLICIES[2:]), "fail").when(n("triageWarn") != 0, "warn").otherwise("pass"),
    }
    return _by_kind(found | {k: F.when(C("policy").isNotNull(), F.when(_failing(), "fail").otherwise("pass")) for k in POLICY})


def checks(reports: DataFrame) -> DataFrame:
    """Of the rows of `parsed`: ord, check, status (pass, warn or fail) and detail, the fields that the check goes by, as JSON. Advisory,
    licence and catalog reports always have a check, those with a policy have one if there is an object of that name."""
    n = lambda f: _number("body", f)
    shown = {"advisory.report": "advisory", "license.report": "license", "bundle.catalog": "bundle-catalog"} | {k: of[0] for k, of in POLICY.items()}
    details = {"advisory.report": _json(findings=n("findings")), "license.report": _json(deniedFindings=n("deniedFindings"))}
    for kind, (_, _, _, fields, _) in POLICY.items():
        how = lambda f: _strings("policy", f) if f in LISTS else _number("policy", f) if f == "matchedReplacementGroups" else _flag("policy", f) if f == "failOnRegression" else _any("policy", f)
        details[kind] = _json(**{f: how(f) for f in fields}, exitCode=_number("policy", "exitCode"))
    base = ("failedBundles", "failures", *POLICIES, "triageWarn", "triageFail")
    inner = lambda names: F.regexp_extract(_json(**{f: n(f) for f in names}), r"^\{(.*)\}$", 1)
    added = lambda names: F.when(n(names[0]) != 0, inner(names))
    details["bundle.catalog"] = F.concat(F.lit("{"), F.concat_ws(",", inner(base), added(PARALLEL), added(PERFORMANCE)), F.lit("}"))
    has = C("kind").isin(*shown) & (~C("kind").isin(*POLICY) | C("policy").isNotNull())
    return reports.where(has).select("ord", _by_kind({k: F.lit(c) for k, c in shown.items()}).alias("check"), _status().alias("status"), _by_kind(details).alias("detail"))


def _results(kind: str | None = None) -> Column:
    keep = lambda x: F.lit(True) if kind is None else F.coalesce(F.try_variant_get(x, "$.resultKind", "string") == kind, F.lit(False))
    return F.aggregate(F.filter(_objects("report", "results"), keep), F.lit(0).cast("long"), lambda total, x: total + _number(x, "count"))


def rollup(reports: DataFrame) -> DataFrame:
    """Of the rows of `parsed`: counter and value over all reports, summed, but the largest of those that measure a size
    (performanceMax...). Counters of rarer kinds are there if such a report is; `reports` and `failedChecks` count the reports and the
    checks that fail. diff.triage_status gives the overall status of these rows."""
    special = {
        "performance.report": {"performanceContiguousReports": _flag("body", "allContiguous")},
        "parallel.query.report": {"parallelQueryResultNodes": _results(), "parallelQueryPathResultNodes": _results("path"), "parallelQueryMemoryMappedReports": _flag("body", "memoryMapped")},
    }
    values: dict[str, dict[str, Column]] = {}
    for kind, (of, fields) in COUNTERS.items():
        values.setdefault(of, {})[kind] = F.lit(1)
        for counter, f in fields.items():
            value = _number("body", f)
            if kind in POLICY and f == "policyFailures":
                value = F.when(C("has_summary"), _failing().cast("long")).otherwise(value)
            values.setdefault(counter, {})[kind] = value
        for counter, value in special.get(kind, {}).items():
            values.setdefault(counter, {})[kind] = value
    always = {c for k in ALWAYS for c in (COUNTERS[k][0], *COUNTERS[k][1])} | set(ALWAYS_CATALOG)
    sums = [F.count("*").alias("reports"), F.count_if(F.coalesce(_status() == "fail", F.lit(False))).alias("failedChecks")]
    for counter, by_kind in values.items():
        value = _by_kind({k: v.cast("long") for k, v in by_kind.items()})  # null where the kind has no such counter
        total = F.greatest(F.max(value), F.lit(0)) if counter.startswith("performanceMax") else F.sum(value)
        if counter.startswith("performanceMax"):
            total = F.when(F.max(value).isNotNull(), total)
        sums.append((F.coalesce(total, F.lit(0)) if counter in always else total).cast("long").alias(counter))
    names = ["reports", "failedChecks", *values]
    return reports.agg(*sums).select(F.stack(F.lit(len(names)), *[x for c in names for x in (F.lit(c), C(c))]).alias("counter", "value")).where("value IS NOT NULL")


def findings(reports: DataFrame, limit: int = 10) -> DataFrame:
    """Of the rows of `parsed`: category, place and finding (JSON) of the first findings of each category, in the order of the reports and,
    within one, of its list. A policy gives one finding, if it fails; npm diagnostics one for each kind that is counted; a catalog one for
    each bundle that is not ok, or whose triage warns or fails."""

    def listed(category: str, items: Column, as_json) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(category).alias("category"), as_json(x).alias("finding")))

    def advisory(x: Column) -> Column:
        return _json(id=_any(x, "advisory.id"), severity=_any(x, "advisory.severity"), package=_any(x, "package"), summary=_any(x, "advisory.summary"))

    def bundle(x: Column) -> Column:
        how = lambda f: _any(x, f, "[]") if f == "failureCodes" else _strings(x, f) if f in LISTS else _any(x, f, None if f in BUNDLE[:6] else "0")
        return _json(**{f: how(f) for f in BUNDLE})

    def bad(x: Column) -> Column:
        ok = (F.schema_of_variant(_any(x, "ok")) == "BOOLEAN") & _flag(x, "ok")
        return ~F.coalesce(ok, F.lit(False)) | F.coalesce(F.try_variant_get(x, "$.triageStatus", "string").isin("warn", "fail"), F.lit(False))

    npm = [F.when(_number("body", k) != 0, F.struct(F.lit("npm").alias("category"), _json(kind=F.lit(k), count=_number("body", k), root=_any("report", "root")).alias("finding"))) for k in NPM]
    found = {
        "advisory.report": listed("advisories", _objects("report", "findings"), advisory),
        "license.report": listed("licenses", _objects("report", "findings"), lambda x: _json(package=_any(x, "package"), license=_any(x, "license"), matchedDeniedLicenses=_any(x, "matchedDeniedLicenses", "[]"))),
        "npm.diagnostics": F.array_compact(F.array(*npm)),
        "bundle.catalog": listed("bundleCatalog", F.filter(_objects("report", "bundles"), bad), bundle),
    }
    for kind, (_, category, names, fields, failures) in POLICY.items():
        how = lambda f: _strings("policy", f) if f in LISTS else _any("policy", f, "0" if f == "matchedReplacementGroups" else None)
        last = {"failures": F.coalesce(F.try_variant_get("policy", "$.failures", "array<variant>"), F.array().cast("array<variant>"))} if failures else {}
        one = _json(**{f: _any("report", f) for f in names}, **{f: how(f) for f in fields}, **last, exitCode=_number("policy", "exitCode"))
        found[kind] = F.when(_failing(), F.array(F.struct(F.lit(category).alias("category"), one.alias("finding"))))
    rows = reports.where(C("kind").isin(*found)).select("ord", F.posexplode_outer(_by_kind(found)).alias("at", "x")).select("ord", "at", "x.*").where("category IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("category").orderBy("ord", "at")).cast("long")
    return rows.withColumn("place", place).where(C("place") <= limit).select("category", "place", "finding")
