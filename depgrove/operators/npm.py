"""Findings about npm packages, and steps of timing reports.

Packages are nodes (id, meta): what a lock file says of a package is in the map meta, its values as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .tables import counted

C = F.col

#: Fixed value: the registry from which a name without a scope can be taken by anyone.
PUBLIC = ("registry.npmjs.org",)


def domain(url: Column) -> Column:
    """Host and port of a web address, with what stands before an @; null for other addresses."""
    return N.nonempty(F.regexp_extract(url, r"^(?i:https?)://([^/?#]+)", 1))


def is_git(*texts: Column) -> Column:
    """Whether one of an entry's address and version names a git repository."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.startswith(t, F.lit("git+")) | F.startswith(t, F.lit("git:")) | F.endswith(t, F.lit(".git")), F.lit(False)) for t in texts])


def is_file(*texts: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.startswith(t, F.lit("file:")), F.lit(False)) for t in texts])


def domains(packages: DataFrame) -> DataFrame:
    """packages: resolved. Packages by domain."""
    return packages.select(domain(C("resolved")).alias("domain")).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("packages"))


def package_rows(nodes: DataFrame) -> DataFrame:
    """A row per node with what reports show of it: name and version of the metadata, else of the id, and the source's address."""
    of = lambda k: F.try_element_at("meta", F.lit(k))
    name, version = N.split_id(C("id"))
    text = lambda k: F.coalesce(of(k), F.lit("")).alias(k)
    return nodes.select(
        "id", F.coalesce(of("name"), name).alias("name"), F.coalesce(of("version"), version).alias("version"), text("purl"), text("classification"),
        F.coalesce(of("dependency_scope"), F.lit("")).alias("scope"), F.coalesce(F.nullif(of("source_url"), F.lit("")), of("resolved"), F.lit("")).alias("source_url"),
        text("integrity"), text("license"), "meta",
    )


def npm_packages(nodes: DataFrame) -> DataFrame:
    """The rows of the npm packages, without roots."""
    of = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return package_rows(nodes.where((of("ecosystem") == "npm") & (of("node_type") != "root")))


def confusable(packages: DataFrame, public: tuple[str, ...] = PUBLIC) -> DataFrame:
    """Packages without a scope that come from a public registry. packages: id, name, domain."""
    return packages.where(~C("name").startswith("@") & C("domain").isin(*public)).select("id", "domain")


def peer_warnings(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """src, peer and from: edges of scope peer, and declared peers (id, peers: names with commas between), each of which counts."""
    peers = edges.where("scope = 'peer'").select("src", C("dst_name").alias("peer"), F.lit("edge").alias("from"))
    names = declared.select(C("id").alias("src"), F.explode(F.split("peers", ",")).alias("peer")).where("peer <> ''")
    return peers.unionByName(names.withColumn("from", F.lit("declared")))


#: The kinds of findings in their order, each a list of packages.
SURFACE = (
    "packagesWithoutIntegrity", "gitBasedDependencies", "localFileDependencies", "lifecycleScriptPackages", "installScriptPackages",
    "dependencyConfusionRiskIndicators", "typosquattingFriendlyNames",
)


def _tests(public: tuple[str, ...]) -> dict[str, Column]:
    """What makes a row of npm_packages a finding of each kind, and further counters."""
    of = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    local = N.truthy(of("local_file_dependency"))
    return {
        "packagesWithoutIntegrity": (of("integrity") == "") & (of("node_type") == "package") & ~local,
        "gitBasedDependencies": N.truthy(of("git_dependency")),
        "localFileDependencies": local,
        "lifecycleScriptPackages": of("lifecycle_scripts") != "",
        "installScriptPackages": N.truthy(of("has_install_script")) | (of("install_scripts") != ""),
        "dependencyConfusionRiskIndicators": ~F.startswith("name", F.lit("@")) & of("remote_tarball_domain").isin(*public),
        "typosquattingFriendlyNames": N.lookalike(C("name")).isNotNull(),
        "directDependencies": C("classification") == "direct",
        "transitiveDependencies": C("classification") == "transitive",
        "packagesWithRemoteTarballUrls": of("remote_tarball_url") != "",
        "devOnlyPackages": C("scope") == "dev",
        "optionalPackages": (C("scope") == "optional") | N.truthy(of("optional")),
    }


def surface(nodes: DataFrame, public: tuple[str, ...] = PUBLIC) -> DataFrame:
    """finding, id and purl of everything worth a look, one pass over the packages; a package has a row for each kind that it is of."""
    tests = _tests(public)
    kinds = F.array_compact(F.array(*[F.when(tests[k], F.lit(k)) for k in SURFACE]))
    return npm_packages(nodes).select(F.explode(kinds).alias("finding"), "id", "purl")


def summary(nodes: DataFrame, edges: DataFrame, public: tuple[str, ...] = PUBLIC) -> DataFrame:
    """The counters of a graph's npm packages, in one pass over nodes and one over edges. edges: src, dst (ids), scope."""
    rows = npm_packages(nodes)
    counted = rows.agg(
        F.count("*").alias("packages"), *[F.count_if(t).alias(k) for k, t in _tests(public).items()],
        F.coalesce(F.sum(F.size(F.filter(F.split(F.coalesce(F.try_element_at("meta", F.lit("peer_dependencies")), F.lit("")), ","), lambda x: x != ""))), F.lit(0)).alias("declared"),
    )
    own = nodes.where(F.try_element_at("meta", F.lit("ecosystem")) == "npm").select(C("id").alias("own"))
    ends = edges.select("scope", F.posexplode(F.array("src", "dst")).alias("side", "own"), F.struct("src", "dst").alias("edge"))
    of_edges = ends.join(own, "own").groupBy("edge").agg(F.first("scope").alias("scope")).agg(F.count("*").alias("edges"), F.count_if(C("scope") == "peer").alias("peers"))
    out = counted.withColumn("dependencies", of_edges.select("edges").scalar()).withColumn("peerDependencyWarnings", C("declared") + of_edges.select("peers").scalar())
    return out.drop("declared")


def conflicts(resolutions: DataFrame) -> DataFrame:
    """Dependencies that resolve to more than one version. resolutions: dependency, resolved (id)."""
    versions = resolutions.where(F.contains("resolved", F.lit("=="))).groupBy("dependency").agg(F.array_sort(F.collect_set(N.split_id(C("resolved"))[1])).alias("versions"))
    return versions.where(F.size("versions") > 1).select("dependency", F.array_join("versions", ",").alias("versions"))


def diagnostics(rows: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """The counters of lock files, a row per file: of what tables.locked_packages and tables.package_lock give. A package counts at each path."""
    several = rows.groupBy("graph", "name").agg(F.countDistinct("version").alias("n")).where("n > 1").groupBy("graph").agg(F.count("*").alias("duplicates"))
    name = F.element_at(F.split("target_path", "node_modules/"), -1)
    apart = edges.groupBy("graph", name.alias("dependency")).agg(F.countDistinct(N.split_id(C("dst"))[1]).alias("n")).where("n > 1").groupBy("graph").agg(F.count("*").alias("conflicts"))
    open_ = missing.groupBy("graph").agg(F.count("*").alias("unresolved"))
    found = rows.groupBy("graph").agg(F.count("*").alias("packages")).join(several, "graph", "left").join(apart, "graph", "left").join(open_, "graph", "left")
    return found.fillna(0, ["duplicates", "conflicts", "unresolved"])


def searched_paths(missing: DataFrame) -> DataFrame:
    """missing: path, dep. The folders in which a dependency was looked for, from the package's own up to the root's, in `searched`."""
    depth = F.size(F.split("path", "node_modules/")) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda up: F.ltrim(F.call_function("substring_index", F.concat(F.lit("/"), "path"), F.lit("/node_modules/"), depth + 1 - up), F.lit("/")))
    return missing.withColumn("searched", F.array_distinct(F.transform(above, lambda a: F.ltrim(F.concat(a, F.lit("/node_modules/"), C("dep")), F.lit("/")))))


def flat_steps(reports: DataFrame) -> DataFrame:
    """reports: key, json (nested objects). A row per step: its dotted name and its seconds. An object with a readable delta is a step
    and is not looked into; the others are, level by level until none is left.

    The text is read once, as a variant; each level is one pass over the level before, which tells while it is written whether objects are left."""
    level, left, found = reports.select("key", F.lit("").alias("step"), F.try_parse_json("json").alias("value")), 1, []
    while left:
        parts = level.lateralJoin(reports.sparkSession.tvf.variant_explode(C("value").outer()).select(C("key").alias("name"), C("value").alias("inner")))
        step = F.concat("step", F.when(C("step") == "", "").otherwise("."), "name")
        delta = N.seconds(F.try_variant_get("inner", "$.delta", "string"))
        rows = parts.select("key", step.alias("step"), C("inner").alias("value"), delta.alias("seconds")).where("step IS NOT NULL")
        open_ = C("seconds").isNull() & F.startswith(F.schema_of_variant("value"), F.lit("OBJECT<"))
        table, n = counted(rows, "steps", left=F.count_if(open_))
        found.append(table.where("seconds IS NOT NULL").select("key", "step", "seconds"))
        level, left = table.where(open_).select("key", "step", "value"), n["left"]
    return reduce(DataFrame.unionByName, found)


def json_value(text: Column) -> Column:
    """A JSON text as a metadata value: compact, with the keys of objects in order; empty for null, an empty text, list or object, and for what is no
    JSON."""
    plain = F.to_json(F.try_parse_json(text))
    return F.when(plain.isNull() | plain.isin("null", '""', "[]", "{}"), "").otherwise(plain)
