"""Snapshot diffs, their classification, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import versions as V
from . import graph as G
from . import joins as J
from . import reports as R

C = F.col

#: The order in which kinds of change are reported.
KIND_ORDER = ("downgrade", "replacement", "upgrade", "removed", "added", "metadataChange")


def classified(left: DataFrame, right: DataFrame, fields: tuple[str, ...] = ("license", "ecosystem")) -> DataFrame:
    """kind, name, old, new: changes of snapshots with columns id, name, version. Removed and added ids of a name are paired in order
    and classified by version; the rest are added or removed; ids on both sides whose fields differ are metadata changes, named by their id.

    Both sides meet by id in one grouping, those of one side only are placed within their name and side, and meet by name and place."""
    side = lambda df, n: df.select("id", F.struct("name", "version", *fields).alias("row"), F.lit(n).alias("side"))
    of = lambda n: F.max(F.when(C("side") == n, C("row")))
    both = side(left, 0).unionByName(side(right, 1)).groupBy("id").agg(of(0).alias("l"), of(1).alias("r"))
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.equal_null(C(f"l.{f}"), C(f"r.{f}"))
    here = F.coalesce("l", "r")
    rows = both.select("id", C("l").isNotNull().alias("in_l"), C("r").isNotNull().alias("in_r"), differ.alias("differ"), F.coalesce(F.nullif(here["name"], F.lit("")), C("id")).alias("name"), here["version"].alias("version"))
    place = F.row_number().over(Window.partitionBy("name", "in_l").orderBy("id"))
    alone = rows.where("NOT (in_l AND in_r)").withColumn("place", place)
    sides = lambda c: (F.max(F.when(C("in_l"), C(c))), F.max(F.when(C("in_r"), C(c))))
    old, new = sides("id")
    a, b = sides("version")
    pairs = alone.groupBy("name", "place").agg(old.alias("old"), new.alias("new"), a.alias("a"), b.alias("b"))
    kind = F.when(C("new").isNull(), "removed").when(C("old").isNull(), "added").otherwise(V.change_kind(C("a"), C("b")))
    meta = rows.where("in_l AND in_r AND differ").select(F.lit("metadataChange").alias("kind"), C("id").alias("name"), C("id").alias("old"), C("id").alias("new"))
    return pairs.select(kind.alias("kind"), "name", "old", "new").unionByName(meta)


def kind_rank(kind: str = "kind"):
    return F.array_position(F.array(*map(F.lit, KIND_ORDER)), C(kind))


#: Fixed value: the distance of a change whose nodes have none.
NO_DISTANCE = 1_000_000


def top_findings(changes: DataFrame, limit: int = 10) -> DataFrame:
    """The first changes: by kind, then the smaller of left_distance and right_distance, then name, then old, else new node; columns that
    are not there count as null."""
    given = [C(c) for c in ("left_distance", "right_distance") if c in changes.columns]
    near = F.coalesce(*([F.least(*given)] if len(given) > 1 else []), *given, F.lit(NO_DISTANCE).cast("long"))
    return changes.orderBy(kind_rank(), near, "name", F.coalesce("old", "new")).limit(limit)


def ordered(changes: DataFrame) -> DataFrame:
    """All changes in the order of a report: kind, name, old node, new node."""
    return changes.orderBy("kind", "name", F.coalesce("old", F.lit("")), F.coalesce("new", F.lit("")))


def kind_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("changes"))


def ranked_changes(changed: DataFrame, *order: str, limit: int = 10) -> DataFrame:
    """Of the rows of joins.keyed_diff the changed ones first, those with the most fields first, then the others; each kind by `order` and
    cut at the limit, which is the report's. change, rank and the key."""
    n = F.size(F.filter(F.split("fields", ","), lambda x: x != ""))
    rank = F.row_number().over(Window.partitionBy("change").orderBy(F.when(C("change") == "changed", n).otherwise(0).desc(), *order)).cast("long")
    return changed.withColumn("rank", rank).where(C("rank") <= limit)


def neighbourhood_diff(nodes: DataFrame, left: DataFrame, right: DataFrame, id_: str, direction: str = "dependencies", depth: int = 3) -> DataFrame:
    """package, change (added, removed or both), and distance and path (ids with > between) on each side, within so many steps of a node."""

    def near(edges: DataFrame, side: str) -> DataFrame:
        found = G.named_paths(G.levels(edges, G.starts_at(nodes, id_), direction, depth, paths=True), nodes)
        return found.join(nodes, "vid").where("distance > 0").select(C("id").alias("package"), C("distance").alias(f"{side}_distance"), C("path").alias(f"{side}_path"))

    both = near(left, "left").join(near(right, "right"), "package", "full_outer")
    change = F.when(C("left_distance").isNull(), "added").when(C("right_distance").isNull(), "removed").otherwise("both")
    return both.select("package", change.alias("change"), "left_distance", "right_distance", "left_path", "right_path")


def neighbourhood_edge_diff(nodes: DataFrame, left: DataFrame, right: DataFrame, id_: str, direction: str = "dependencies", depth: int = 3) -> DataFrame:
    """src, dst and change (added, removed or both) of the edges that the two neighbourhoods were expanded along."""

    def near(edges: DataFrame, side: str) -> DataFrame:
        found = G.levels(edges, G.starts_at(nodes, id_), direction, depth)
        return G.neighbourhood_edges(edges, found, direction, depth).distinct().withColumn(side, F.lit(True))

    both = near(left, "left").join(near(right, "right"), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.when(C("left").isNull(), "added").when(C("right").isNull(), "removed").otherwise("both").alias("change"))


def churn(rows: DataFrame) -> DataFrame:
    """Of the rows of a neighbourhood diff: added, removed and unchanged, their churn (added and removed) and delta (added less removed)."""
    out = rows.agg(*[F.count_if(C("change") == k).alias(k) for k in ("added", "removed", "both")])
    return out.withColumn("churn", C("added") + C("removed")).withColumn("delta", C("added") - C("removed"))


def timing_deltas(left: DataFrame, right: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, before, after, delta of the metrics that differ; left and right: a row each. A metric that a side does not have has no
    delta."""
    pairs = ", ".join(f"'{m}', l_{m}, r_{m}" for m in metrics)
    both = left.select(*[C(m).cast("double").alias(f"l_{m}") for m in metrics]).join(right.select(*[C(m).cast("double").alias(f"r_{m}") for m in metrics]))
    rows = both.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, before, after)").withColumn("delta", F.bround(C("after") - C("before"), 6))
    return rows.where("delta <> 0")


def commit_findings(left: DataFrame, right: DataFrame) -> DataFrame:
    """before and after: the commits of two builds (commit), in order, if they are not the same; else no row."""
    listed = lambda df, c: df.where("commit <> ''").agg(F.array_join(F.array_sort(F.collect_set("commit")), ",").alias(c))
    return listed(left, "before").join(listed(right, "after")).where("before <> after")


def verdict(changes: DataFrame, fail_on: tuple[str, ...]) -> DataFrame:
    """status and exit_code: fails (2) if any change is of a kind listed."""
    seen = F.coalesce(F.collect_set("kind"), F.array())
    hit = F.array_sort(F.array_intersect(seen, F.array(*map(F.lit, fail_on)).cast("array<string>")))
    return changes.agg(hit.alias("hit")).select(F.array_join("hit", ",").alias("violations"), F.when(F.size("hit") > 0, "fail").otherwise("pass").alias("status"), F.when(F.size("hit") > 0, 2).otherwise(0).alias("exit_code"))


def gate(rows: DataFrame, broken: Column) -> DataFrame:
    """status, exit_code (2 if it fails) and violations, the number of rows that break a rule."""
    n = F.count_if(F.coalesce(broken, F.lit(False)))
    return rows.agg(n.alias("violations")).select("violations", F.when(C("violations") > 0, "fail").otherwise("pass").alias("status"), F.when(C("violations") > 0, 2).otherwise(0).alias("exit_code"))


def advisory_gate(findings: DataFrame, least: str = "unknown") -> DataFrame:
    """Fails if a finding is as severe as the word given, or more; by default any finding fails. findings: severity."""
    return gate(findings, N.severity_rank(C("severity")) >= N.severity_rank(F.lit(least)))


def license_gate(rows: DataFrame) -> DataFrame:
    """Fails if a licence is denied; of the rows of reports.license_rows."""
    return gate(rows, C("denied"))


def coverage_gate(summary: DataFrame, plan: DataFrame, least_percent: float | None = None, fail_on: str | None = None) -> DataFrame:
    """code, actual and expected of each broken rule: the share (summary: percent, a row) below the least, and groups of a plan (priority)
    that are of the priority given or a higher one."""
    low = summary.select(F.lit("publicEvidenceCoverageBelowThreshold").alias("code"), C("percent").cast("double").alias("actual"), F.lit(least_percent).cast("double").alias("expected"))
    low = low.where(C("actual") < C("expected"))
    hit = plan.agg(F.count_if(R.priority_rank(C("priority")) >= R.PRIORITIES[fail_on] if fail_on else F.lit(False)).cast("double").alias("actual"))
    return low.unionByName(hit.where("actual > 0").select(F.lit("replacementPriorityMatched").alias("code"), "actual", F.lit(0.0).alias("expected")))


def plan_gate(plan: DataFrame, fail_on: str) -> DataFrame:
    """The candidates of reports.replacement_plan of the priority given or a higher one: group, priority, decision, rank."""
    return plan.where(C("candidate") & (R.priority_rank(C("priority")) >= R.PRIORITIES[fail_on])).select("group", "priority", "decision", "rank")


#: Counters that make a triage fail, and those that make it warn.
TRIAGE_FAIL = (
    "advisoryFindings", "deniedLicenseFindings", "graphDiffPolicyFailures", "diffTreePolicyFailures", "realDataCoveragePolicyFailures",
    "realDataCoverageDiffPolicyFailures", "realDataReplacementPlanPolicyFailures", "realDataReplacementPlanDiffPolicyFailures",
    "catalogFailedBundles", "catalogFailures", "catalogTriageFail",
)
TRIAGE_WARN = ("missingLicenses", "npmDuplicatePackageNames", "npmNestedResolutionConflicts", "npmUnresolvedDependencies", "catalogTriageWarn")


def triage(reports: DataFrame) -> DataFrame:
    """reports: schema, ord, counters (map of a counter's name to a number). All counters over all reports, in one row per counter: summed,
    but the largest of those that measure a size (performanceMax...); counter and value."""
    rows = reports.select(F.explode("counters").alias("counter", "n"))
    size = F.startswith("counter", F.lit("performanceMax"))
    return rows.groupBy("counter").agg(F.when(F.first(size), F.max("n")).otherwise(F.sum("n")).cast("long").alias("value"))


def triage_status(counters: DataFrame) -> DataFrame:
    """status of the rows of `triage`, as a row."""
    hit = lambda names: F.max((C("counter").isin(*names) & (C("value") != 0)).cast("int")) == 1
    return counters.agg(F.when(hit(TRIAGE_FAIL), "fail").when(hit(TRIAGE_WARN), "warn").otherwise("pass").alias("status"))


#: The check that each kind of report gets, and the counters that decide it.
CHECKS = {
    "advisory.report": ("advisory", ("findings",)),
    "license.report": ("license", ("deniedFindings",)),
    "graph.diff": ("graph-diff-policy", ("policyFailures",)),
    "graph.diff_tree": ("diff-tree-policy", ("policyFailures",)),
    "real_data.coverage": ("real-data-coverage-policy", ("policyFailures",)),
    "real_data.coverage_diff": ("real-data-coverage-diff-policy", ("policyFailures",)),
    "real_data.replacement_plan": ("real-data-replacement-plan-policy", ("policyFailures",)),
    "real_data.replacement_plan_diff": ("real-data-replacement-plan-diff-policy", ("policyFailures",)),
    "bundle.catalog": ("bundle-catalog", ("failedBundles", "failures", "triageFail")),
}


def triage_checks(reports: DataFrame) -> DataFrame:
    """ord, kind and status of the checks: reports: ord, kind (the middle of its schema), counters (map). Other kinds have none. A catalog
    warns where its own triage does."""
    of = lambda k: F.coalesce(F.try_element_at("counters", F.lit(k)), F.lit(0))
    name, status = F.lit(None).cast("string"), F.lit("pass")
    for kind, (check, counters) in CHECKS.items():
        broken = F.greatest(*[of(c) for c in counters], F.lit(0)) > 0
        name = F.when(C("kind") == kind, check).otherwise(name)
        status = F.when((C("kind") == kind) & broken, "fail").otherwise(status)
    status = F.when((status == "pass") & (C("kind") == "bundle.catalog") & (of("triageWarn") > 0), "warn").otherwise(status)
    return reports.select("ord", name.alias("check"), status.alias("status")).where("check IS NOT NULL")


def first_findings(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The first findings of each category, in the order of the reports. findings: category, ord."""
    at = F.row_number().over(Window.partitionBy("category").orderBy("ord")).cast("long")
    return findings.withColumn("place", at).where(C("place") <= limit)


def regressions(left: DataFrame, right: DataFrame, key: str, better: dict[str, int]) -> DataFrame:
    """Metrics of a key that moved the wrong way; better: 1 if more is better, -1 if less is."""
    pairs = ", ".join(f"'{m}', l_{m}, r_{m}, {sign}" for m, sign in better.items())
    both = left.select(key, *[C(m).cast("double").alias(f"l_{m}") for m in better]).join(right.select(key, *[C(m).cast("double").alias(f"r_{m}") for m in better]), key)
    rows = both.selectExpr(key, f"stack({len(better)}, {pairs}) AS (metric, before, after, sign)")
    return rows.where("(after - before) * sign < 0").select(key, "metric", "before", "after")
