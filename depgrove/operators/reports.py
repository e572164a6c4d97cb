"""Aggregates that reports are made of: licences, repositories, builds, logs, npm packages, findings and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

C = F.col


def licensable(nodes: DataFrame) -> DataFrame:
    """The nodes that can have a licence: no root, no requirement that nothing meets, no capability. nodes: id, meta."""
    kind = F.coalesce(F.try_element_at("meta", F.lit("node_type")), F.lit(""))
    return nodes.where(~kind.isin("root", "unresolved_requirement") & ~F.startswith("id", F.lit("rpm-capability:")))


def license_rows(packages: DataFrame, denied: tuple[str, ...]) -> DataFrame:
    """id, text (null: missing) and denied of each package with columns id, license."""
    text = N.license_text(C("license"))
    hit = F.arrays_overlap(N.license_tokens(text), F.array(*[F.lit(d.lower()) for d in denied])) | F.lower(text).isin(*[d.lower() for d in denied])
    return packages.select("id", text.alias("text"), F.coalesce(hit, F.lit(False)).alias("denied"))


def license_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("packages"))


def license_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("packages"), F.count("text").alias("licensed"), F.count_if(C("text").isNull()).alias("missing"),
        F.countDistinct("text").alias("distinct_licenses"), F.count_if("denied").alias("denied"),
    )


def top_counts(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The most frequent values: by count, then value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def inventory(artifacts: DataFrame) -> DataFrame:
    """Counts by kind; noarch and debug packages are not among the binary ones."""
    kind = N.artifact_kind(C("filename"))
    return artifacts.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("artifacts"), F.countDistinct("name").alias("names"))


def inventory_by_arch(artifacts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    rows = artifacts.groupBy("arch").agg(F.count("*").alias("artifacts"))
    return rows.select("arch", "artifacts", F.row_number().over(Window.orderBy(N.arch_rank(C("arch"), order), "arch")).cast("long").alias("position"))


def step_totals(steps: DataFrame) -> DataFrame:
    """steps: step, seconds. Sums and maxima, rounded half to even."""
    return steps.groupBy("step").agg(F.bround(F.sum("seconds"), 6).alias("total"), F.bround(F.max("seconds"), 6).alias("longest"), F.count("*").alias("tasks"))


#: Statuses of tasks that went well.
SUCCESSFUL = ("2", "3", "done", "finished", "success", "completed")


def completeness(builds: DataFrame, tasks: DataFrame) -> DataFrame:
    """builds: build, released, sign_tasks, test_tasks (counts); tasks: build, arch, status, arch_list (array). What each build lacks: the
    architectures that its platforms list and no task has, failed tasks, signatures, tests."""
    arch = F.coalesce(F.nullif(C("arch"), F.lit("")), F.lit("unknown"))
    good = F.coalesce(F.lower(C("status").cast("string")).isin(*SUCCESSFUL), F.lit(False))
    wanted = F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce("arch_list", F.array().cast("array<string>")), lambda x: x != ""))))
    found = tasks.groupBy("build").agg(F.count("*").alias("build_tasks"), F.count_if(~good).alias("failed"), F.collect_set(arch).alias("observed"), wanted.alias("expected"))
    rank = lambda x: F.struct(N.arch_rank(x, N.INVENTORY_ORDER).alias("at"), x.alias("arch"))
    inorder = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, rank)), lambda x: x["arch"]), ",")
    none = F.array().cast("array<string>")
    both = builds.join(found, "build", "left").withColumn("gap", F.array_except(F.coalesce("expected", none), F.coalesce("observed", none)))
    return both.select(
        "build", "released", inorder(F.coalesce("expected", none)).alias("expected"), inorder("gap").alias("missing"), F.size("gap").cast("long").alias("n_missing"),
        F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("build_tasks", F.lit(0)).alias("build_tasks"), (C("sign_tasks") == 0).alias("unsigned"), (C("test_tasks") == 0).alias("untested"),
    )


def completeness_summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("builds"), F.count_if("released").alias("released"), F.count_if(C("n_missing") > 0).alias("with_missing"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.count_if("unsigned").alias("unsigned"), F.count_if("untested").alias("untested"),
    )


#: What log lines are counted for.
SIGNALS = {
    "error": r"\berror\b|error:",
    "failed": r"\bfailed\b|\bfailure\b",
    "fatal": r"\bfatal\b|fatal:",
    "missing": r"\bmissing\b|no matching package|not found",
    "warning": r"\bwarning\b|warning:",
}
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def log_lines(text: Column) -> Column:
    """The lines of a text; an end at the end begins no further line."""
    found = F.split(text, LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def log_content(*keys: Column) -> Column:
    """The first of several fields that holds more than spaces; an empty text without one."""
    return F.coalesce(*[F.when(F.length(F.trim(F.regexp_replace(k, r"\s", " "))) > 0, k) for k in keys], F.lit(""))


def log_signals(logs: DataFrame, text: str = "text") -> DataFrame:
    """How often each signal occurs in a text, without regard to case, and its lines."""
    counts = {k: F.regexp_count(C(text), F.lit("(?i)" + p)) for k, p in SIGNALS.items()}
    return logs.withColumns(counts).withColumn("lines", F.when(C(text) == "", 0).otherwise(F.size(log_lines(C(text)))))


def log_sample(text: Column, lines: int = 3, most: int = 500) -> Column:
    """The first lines with a signal, else the first that are not blank, joined and cut to a length."""
    trimmed = F.transform(log_lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    found = F.filter(trimmed, lambda x: F.regexp_like(x, F.lit("(?i)" + "|".join(SIGNALS.values()))))
    shown = F.when(F.size(found) > 0, found).otherwise(F.filter(trimmed, lambda x: x != ""))
    return F.left(F.array_join(F.slice(shown, 1, lines), " | "), F.lit(most))


def timing_summary(builds: DataFrame, tasks: DataFrame, signs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A row per build. builds: build, created, finished; tasks: build, started, finished; signs: the same; artifacts: build. Seconds are
    rounded half to even; a build that has no readable stamps has null as its own."""
    wall = N.wall_seconds(C("started"), C("finished"))
    total = lambda df, p: df.groupBy("build").agg(
        F.count("*").alias(f"{p}_tasks"), F.bround(F.coalesce(F.sum(wall), F.lit(0.0)), 6).alias(f"{p}_seconds"), F.bround(F.greatest(F.coalesce(F.max(wall), F.lit(0.0)), F.lit(0.0)), 6).alias(f"{p}_longest")
    )
    rows = builds.select("build", N.wall_seconds(C("created"), C("finished")).alias("seconds"))
    rows = rows.join(total(tasks, "build"), "build", "left").join(total(signs, "sign").drop("sign_longest"), "build", "left")
    rows = rows.join(artifacts.groupBy("build").agg(F.count("*").alias("artifacts")), "build", "left")
    return rows.fillna(0, ["build_tasks", "sign_tasks", "artifacts"]).fillna(0.0, ["build_seconds", "build_longest", "sign_seconds"])


def timing_histograms(artifacts: DataFrame) -> DataFrame:
    """build, by (type or arch), value and artifacts; artifacts: build, type, name. Architectures as timings count them."""
    kind = F.coalesce(F.nullif(C("type"), F.lit("")), F.lit("unknown"))
    rows = artifacts.select("build", F.explode(F.array(F.struct(F.lit("type").alias("by"), kind.alias("value")), F.struct(F.lit("arch").alias("by"), N.timing_file(F.coalesce("name", F.lit("")))["arch"].alias("value")))).alias("x"))
    return rows.groupBy("build", C("x.by").alias("by"), C("x.value").alias("value")).agg(F.count("*").alias("artifacts"))


def duplicate_names(packages: DataFrame) -> DataFrame:
    """Names with more than one version, with the paths of each version, in order. packages: name, version, path."""
    of = packages.groupBy("name", "version").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))
    found = of.groupBy("name").agg(F.count("*").alias("versions"), F.array_sort(F.collect_list(F.struct("version", "paths"))).alias("all")).where("versions > 1")
    return found.select("name", "versions", F.array_join(F.transform("all", lambda x: F.concat(x["version"], F.lit("@"), x["paths"])), ",").alias("list"))


def _summed(sums: tuple[str, ...], largest: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums] + [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in largest]


def rollup(reports: DataFrame, *keys: str, sums: tuple[str, ...] = ("findings", "failures"), largest: tuple[str, ...] = ("largest",)) -> DataFrame:
    """reports: counters by name. Over all reports of a key the sums of most counters and the largest of sizes; a counter that a kind of
    report does not have is null and counts as 0."""
    return reports.groupBy(*keys).agg(F.count("*").alias("reports"), *_summed(sums, largest))


def catalog(bundles: DataFrame) -> DataFrame:
    """bundles: kind, ord, reports, codes (array). Sums, and the codes of all bundles, each once, in order of first appearance."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "codes"))), lambda x: x["codes"])
    return bundles.groupBy("kind").agg(F.count("*").alias("bundles"), F.sum("reports").alias("reports"), F.max("reports").alias("most"), F.array_join(F.array_distinct(F.flatten(lists)), ",").alias("codes"))


def catalog_status(bundles: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """bundles: ok, reports, failures, triage (pass, warn, fail or not-present) and a count for each policy. Counts over all of them and
    the status: fail if a bundle or a triage failed or a policy was broken, warn if a triage warns, else pass."""
    triage = lambda v: F.count_if(F.coalesce("triage", F.lit("unknown")) == v)
    ok = F.coalesce(C("ok"), F.lit(False))
    out = bundles.agg(
        F.count("*").alias("bundles"), F.count_if(ok).alias("ok_bundles"), F.count_if(~ok).alias("failed_bundles"), *_summed(("reports", "failures", *policies), ()),
        triage("pass").alias("triage_pass"), triage("warn").alias("triage_warn"), triage("fail").alias("triage_fail"), triage("not-present").alias("without_triage"),
    )
    broken = F.greatest("failed_bundles", "failures", "triage_fail", *policies) > 0
    return out.withColumn("status", F.when(broken, "fail").when(C("triage_warn") > 0, "warn").otherwise("pass"))


def coverage(groups: DataFrame) -> DataFrame:
    """groups: kind, public (boolean). The share of public ones in percent; 0 without any."""
    n = F.count("*")
    return groups.groupBy("kind").agg(n.alias("total"), F.count_if("public").alias("public"), F.bround(F.when(n > 0, 100.0 * F.count_if("public") / n).otherwise(0.0), 2).alias("percent"))


#: Ranks of priorities, and decisions that make a group a candidate.
PRIORITIES = {"low": 1, "medium": 2, "high": 3}
CANDIDATE_DECISIONS = ("hybrid", "replace-where-practical", "review")


def priority_rank(priority: Column) -> Column:
    out = F.lit(0)
    for k, v in PRIORITIES.items():
        out = F.when(priority == k, v).otherwise(out)
    return out


def replacement_plan(groups: DataFrame) -> DataFrame:
    """groups: group, priority, decision, files (count). Candidates are of high or medium priority and a decision to replace; they are
    ranked by priority, then files, then group, and the others have no rank. A table of groups, not of files: one window over all."""
    wanted = C("decision").isin(*CANDIDATE_DECISIONS) & C("priority").isin("high", "medium")
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(priority_rank(C("priority")).desc(), F.desc("files"), "group")).cast("long")
    return groups.withColumn("candidate", wanted).withColumn("rank", F.when(C("candidate"), rank))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Of the rows of replacement_plan."""
    return plan.agg(
        F.count("*").alias("groups"), F.count_if("candidate").alias("candidates"), F.coalesce(F.sum(F.when(C("candidate"), C("files"))), F.lit(0)).alias("candidate_files"),
        F.count_if(~C("candidate")).alias("deferred"), *[F.count_if(C("priority") == p).alias(p) for p in PRIORITIES],
    )


def feed_summary(records: DataFrame) -> DataFrame:
    """Of an advisory feed: records, their packages and severities, in order. records: id, package, severity."""
    return records.agg(
        F.count("*").alias("advisories"), F.countDistinct("package").alias("packages"), F.array_join(F.array_sort(F.collect_set(F.coalesce("severity", F.lit("unknown")))), ",").alias("severities")
    )


def repository_summary(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Of a repository's graph: nodes: id, node_type, arch, source_rpm; edges: src, dst (ids). Edges of the root are no requirements."""
    package = C("node_type") == "package"
    counts = nodes.agg(F.count_if(package).alias("packages"), F.countDistinct(F.when(package, F.nullif(C("source_rpm"), F.lit("")))).alias("source_rpms"), F.countDistinct(F.when(package, F.coalesce("arch", F.lit("unknown")))).alias("arches"))
    wants = edges.where((C("src") != root) & (C("dst") != root))
    open_ = wants.join(nodes.where("node_type = 'unresolved_requirement'").select(C("id").alias("dst")), "dst", "left_semi")
    return counts.withColumn("requirements", wants.agg(F.count("*")).scalar()).withColumn("unresolved", open_.agg(F.count("*")).scalar())


def unresolved_rows(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """The first requirements that nothing meets: package and capability, by package, then node."""
    open_ = nodes.where("node_type = 'unresolved_requirement'").select(C("id").alias("dst"), F.coalesce("capability", "id").alias("capability"))
    return edges.join(open_, "dst").orderBy("src", "dst").limit(limit).select(C("src").alias("package"), "capability")


def range_intervals(events: Column) -> Column:
    """Intervals of a row of (introduced, fixed, last_affected) events: a bound closes the interval that is open, and one that stays
    open ends without a bound."""
    kind = "struct<done:array<struct<introduced:string,fixed:string,last_affected:string>>,open:string>"
    begin = F.struct(F.array().alias("done"), F.lit(None).cast("string").alias("open")).cast(kind)
    row = lambda i, f, l: F.struct(i.alias("introduced"), f.alias("fixed"), l.alias("last_affected"))

    def step(acc: Column, e: Column) -> Column:
        closed = F.struct(F.concat(acc["done"], F.array(row(F.coalesce(acc["open"], F.lit("0")), e["fixed"], e["last_affected"]))).alias("done"), F.lit(None).cast("string").alias("open")).cast(kind)
        opened = F.struct(acc["done"].alias("done"), e["introduced"].alias("open")).cast(kind)
        return F.when(e["introduced"].isNotNull(), opened).otherwise(closed)

    def end(acc: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(row(acc["open"], none, none)))).otherwise(acc["done"])

    return F.aggregate(events, begin, step, end)
